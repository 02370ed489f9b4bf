"""Batches that become visible as a whole.

A batch writes its tables in folders named by its id. When all are written, a note named by the id is put
into ``_commits`` by renaming a finished file. Spark runs batch ids in order, so everything up to the highest
note is complete; what lies beyond it is a batch under way, or one that failed and will be written again.
"""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTES = "_commits"


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit(spark: SparkSession, path: str, batch_id: int, note: dict) -> None:
    """Make all tables of a batch visible."""
    jvm, _, fs = _folder(spark, path)
    started = jvm.org.apache.hadoop.fs.Path(f"{path}/{NOTES}/.{batch_id}")
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/{NOTES}/{batch_id}")
    out = fs.create(started, True)
    try:
        out.write(bytearray(json.dumps(note).encode()))
    finally:
        out.close()
    if fs.exists(done):  # the same batch again, after a failure between its note and Spark's own
        fs.delete(done, False)
    if not fs.rename(started, done):
        raise OSError(f"batch {batch_id} could not be committed in {path}")


def last_commit(spark: SparkSession, path: str, below: int | None = None) -> tuple[int, dict] | None:
    """Highest committed batch id (below another) and its note."""
    jvm, notes, fs = _folder(spark, f"{path}/{NOTES}")
    if not fs.exists(notes):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(notes)]
    ids = [int(n) for n in names if n.isdigit() and (below is None or int(n) < below)]
    if not ids:
        return None
    text = spark.read.text(f"{path}/{NOTES}/{max(ids)}", wholetext=True).first()[0]
    return max(ids), json.loads(text)


def read_committed(spark: SparkSession, path: str, table: str | None = None, schema=None) -> DataFrame:
    """The rows of all committed batches. Without any, an empty table of ``schema``."""
    last = last_commit(spark, path)
    if last is None:
        if schema is None:
            raise ValueError(f"no batch is committed in {path}")
        return spark.createDataFrame([], schema)
    rows = spark.read.parquet(f"{path}/{table}" if table else path)
    return rows.where(F.col("batch_id") <= last[0]).drop("batch_id")
