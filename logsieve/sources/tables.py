"""Slices of stored log tables, and the export document."""

import json
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve import rules

c = F.col


def scan_range(df: DataFrame, start, end, limit: int | None = None) -> DataFrame:
    """Rows with ``start <= log_time < end``, oldest first. The predicate reaches the scan."""
    out = df.where((c("log_time") >= F.lit(start)) & (c("log_time") < F.lit(end)))
    out = out.orderBy("log_time", "id")
    return out.limit(limit) if limit is not None else out


def local_range(
    date: str | None = None,
    start: str | None = None,
    end: str | None = None,
    today: bool = False,
    now: datetime | None = None,
    zone: str = rules.LOCAL_ZONE,
) -> tuple[datetime, datetime]:
    """UTC bounds of a local day or a local span. Exactly one way must be chosen."""
    if sum([bool(today), bool(date), bool(start or end)]) != 1:
        raise ValueError("choose exactly one of today, date, start/end")
    tz = ZoneInfo(zone)
    if today or date:
        day = (now or datetime.now(tz)).astimezone(tz) if today else datetime.strptime(
            date.strip(), "%Y-%m-%d"
        )
        first = datetime(day.year, day.month, day.day, tzinfo=tz)
        last = first + timedelta(days=1)
    else:
        if not (start and end):
            raise ValueError("start and end go together")
        first, last = (_local(t, tz) for t in (start, end))
        if first >= last:
            raise ValueError("start must be before end")
    utc = ZoneInfo("UTC")
    return first.astimezone(utc), last.astimezone(utc)


def _local(text: str, tz: ZoneInfo) -> datetime:
    t = datetime.fromisoformat(text.strip())
    return t.replace(tzinfo=tz) if t.tzinfo is None else t.astimezone(tz)


def write_log(df: DataFrame, path: str, files: int = 32) -> None:
    """A log stored for time ranges: folders by local day, files and row groups of neighbouring times within.

    Rows are dealt by time, so a busy day has many files and a quiet one few; ``files`` is how many ranges there are.
    Rows without a time have a folder of their own.
    """
    day = F.to_date(F.from_utc_timestamp("log_time", rules.LOCAL_ZONE))
    rows = df.withColumn("local_day", day).repartitionByRange(files, "local_day", "log_time", "id")
    rows.sortWithinPartitions("local_day", "log_time", "id").write.mode("overwrite").partitionBy("local_day").parquet(path)


def read_log(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """``start <= log_time < end`` of a log stored by ``write_log``. Days outside are not opened, and the time bounds reach the
    files' row groups. Bounds are UTC."""
    rows = spark.read.parquet(path)

    def day(t) -> Column:
        return F.to_date(F.from_utc_timestamp(F.lit(t).cast("timestamp"), rules.LOCAL_ZONE))

    if start is not None:
        rows = rows.where((c("local_day") >= day(start)) & (c("log_time") >= F.lit(start).cast("timestamp")))
    if end is not None:
        rows = rows.where((c("local_day") <= day(end)) & (c("log_time") < F.lit(end).cast("timestamp")))
    return rows.drop("local_day")


def scan_recent(
    df: DataFrame, as_of, hours: int = 24, limit: int | None = None
) -> DataFrame:
    """The last hours before ``as_of``, newest first, with the columns risk scoring needs."""
    names = [
        "id", "log_time", "src_ip", "method", "raw_request", "uri", "query_string",
        "status_code", "duration_us", "ttfb_us", "req_content_type",
    ]
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
    out = df.where(c("log_time") >= since).select(*names)
    return out.orderBy(c("log_time").desc(), "id").limit(limit) if limit else out


def local_iso(ts: Column) -> Column:
    """Timestamp to local ISO text with milliseconds."""
    text = F.date_format(
        F.from_utc_timestamp(ts, rules.LOCAL_ZONE), "yyyy-MM-dd'T'HH:mm:ss.SSS"
    )
    return F.concat(text, F.lit(rules.LOCAL_OFFSET))


def export_rows(df: DataFrame) -> DataFrame:
    """Timestamps as local ISO text; everything else unchanged."""
    times = [n for n in ("log_time", "created_at") if n in df.columns]
    return df.withColumns({n: local_iso(c(n)) for n in times})


def export_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and in total. Each table sends one row per task."""
    parts = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("table"))
        parts = part if parts is None else parts.unionByName(part)
    return (
        parts.rollup("table").agg(F.count("*").alias("count"))
        .withColumn("table", F.coalesce("table", F.lit("total")))
    )


class DamagedParts(ValueError):
    """Parts of a stored document that are missing, unknown or not as they were written."""

    def __init__(self, path: str, parts: list[str]):
        super().__init__(f"damaged parts in {path}: {', '.join(parts)}")
        self.parts = parts


def part_sums(spark: SparkSession, path: str, names, fmt: str = "json") -> DataFrame:
    """table, part, rows, checksum of every file of the tables below a path; rows may stand in any order.

    The checksum adds up hashes of lines (JSON), or of all columns (Parquet).
    """
    out = None
    for name in names:
        rows = spark.read.text(f"{path}/{name}") if fmt == "json" else spark.read.format(fmt).load(f"{path}/{name}")
        seen = rows.select(
            F.lit(name).alias("table"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("part"),
            F.pmod(F.xxhash64(*[c(f"`{n}`") for n in rows.columns]), F.lit(1 << 32)).alias("h"),
        )
        part = seen.groupBy("table", "part").agg(F.count("*").alias("rows"), F.sum("h").alias("checksum"))
        out = part if out is None else out.unionByName(part)
    return out


def write_manifest(spark: SparkSession, path: str, names, meta: dict, fmt: str = "json") -> None:
    """``path/manifest`` with one row for each part, and ``path/header`` with the meta data and the row counts."""
    part_sums(spark, path, names, fmt).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    rows = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    found = {r["table"]: r["rows"] for r in rows.groupBy("table").agg(F.sum("rows").alias("rows")).collect()}
    counts = {n: found.get(n, 0) for n in names}
    header = {"meta": {**meta, "total_count": sum(counts.values())}, "counts": counts}
    spark.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


MANIFEST = "table string, part string, rows bigint, checksum bigint"


def read_header(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/header").first()[0])


def verify_parts(spark: SparkSession, path: str, names, fmt: str = "json") -> None:
    """Raises DamagedParts with the names of the parts that differ from the manifest."""
    said = spark.read.schema(MANIFEST).json(f"{path}/manifest").where(c("table").isin(list(names)))
    found = part_sums(spark, path, names, fmt).select("table", "part", c("rows").alias("n"), c("checksum").alias("sum"))
    same = c("rows").eqNullSafe(c("n")) & c("checksum").eqNullSafe(c("sum"))
    bad = said.join(found, ["table", "part"], "full").where(~same).orderBy("table", "part").select("table", "part").collect()
    if bad:
        raise DamagedParts(path, [f"{r['table']}/{r['part']}" for r in bad])


def write_export(tables: dict[str, DataFrame], path: str, meta: dict | None = None) -> None:
    """The export document in parts: each table as JSON lines under ``path/<table>``, written in parallel, with a manifest."""
    for name, df in tables.items():
        export_rows(df).write.mode("overwrite").json(f"{path}/{name}")
    write_manifest(next(iter(tables.values())).sparkSession, path, list(tables), meta or {})


def read_export(spark: SparkSession, path: str, schemas: dict[str, str], verify: bool = True) -> dict[str, DataFrame]:
    """The tables of an export; ``verify`` compares every part with the manifest first."""
    if verify:
        verify_parts(spark, path, list(schemas))
    return {n: spark.read.schema(s).json(f"{path}/{n}") for n, s in schemas.items()}


def read_export_document(
    spark: SparkSession, path: str, schemas: dict[str, str]
) -> dict[str, DataFrame]:
    """The single nested document form: ``{meta, counts, data: {table: [rows]}}``.

    Kept for existing files. One document is one row, so a large export should use the
    line form of ``write_export`` instead.
    """
    data = ", ".join(f"{n}: array<struct<{s}>>" for n, s in schemas.items())
    doc = spark.read.schema(f"data struct<{data}>").json(path, multiLine=True)
    return {n: doc.select(F.inline(f"data.{n}")) for n in schemas}


def write_artifacts(frames: dict[str, DataFrame], path: str, fmt: str = "parquet", meta: dict | None = None) -> None:
    """The results of a run, one folder each, with a manifest of their parts."""
    for name, df in frames.items():
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")
    write_manifest(next(iter(frames.values())).sparkSession, path, list(frames), meta or {}, fmt)


def read_artifacts(spark: SparkSession, path: str, names, fmt: str = "parquet") -> dict[str, DataFrame]:
    verify_parts(spark, path, names, fmt)
    return {n: spark.read.format(fmt).load(f"{path}/{n}") for n in names}


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A stored table over JDBC. Range filters and column choices are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 100, **options) -> None:
    df.write.format("jdbc").options(
        url=url, dbtable=table, batchsize=batch_size, **options
    ).mode("append").save()
