"""Written intermediate tables in the folder that all executors share."""

import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_base: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's own folder below ``spark.checkpoint.dir``, or below the warehouse if unset.

    Without the setting, a cluster's warehouse must not be a folder of the driver's machine.
    """
    app = spark.sparkContext.applicationId
    if app not in _base:
        given, warehouse = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir")
        if not given and not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = given or warehouse
        _base[app] = f"{top.rstrip('/')}/logsieve-{uuid.uuid4().hex[:12]}"
    return _base[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write once, read many times: cuts the lineage without losing it to an executor.

    ``options`` are the writer's. The write's own shuffle files go when it ends; nothing reads them afterwards.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete one written table or folder, wherever Spark's file systems keep it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            remove(df.sparkSession, path)


def close(spark: SparkSession) -> None:
    """Delete everything this session has written here."""
    app = spark.sparkContext.applicationId
    _written.pop(app, None)
    if base := _base.pop(app, None):
        remove(spark, base)
