"""Log files to tables as a stream, and the stateless operators on it."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logsieve.sources import logs, tail
from logsieve.streaming import commits


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New lines of the files in a folder.

    Progress is kept in the query's checkpoint. Rotated files are new files; a file that
    is still being written belongs outside the folder until it is closed, or is followed by ``follow``.
    """
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def stream_kinds(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New lines with their ``kind``, from folders ``kind=access``, ``kind=security``, ``kind=error``."""
    reader = spark.readStream.schema("value string, kind string")
    return reader.option("maxFilesPerTrigger", files_per_batch).text(path)


def follow(spark: SparkSession, path: str, **options) -> DataFrame:
    """Complete lines of growing files (``value``, ``kind``, ``file``); see ``logsieve.sources.tail``."""
    tail.register(spark)
    return spark.readStream.format("logtail").options(**options).load(path)


def stream_ingest(spark: SparkSession, source: str, path: str, growing: bool = False, **options) -> DataFrame:
    """Typed rows of one log kind from a folder of closed files, or from growing files named by a glob."""
    lines = follow(spark, path, **options).select("value") if growing else stream_lines(spark, path)
    return logs.PARSERS[source](lines)


def batch_writer(path: str, fmt: str = "parquet"):
    """Sink for ``foreachBatch`` that can repeat a batch without doubling it.

    Each batch owns the folder named by its id and overwrites it, so a batch run again
    after a failure or restart replaces what it left behind; readers see it once it is committed.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        rows = batch.observe(seen, F.count("*").alias("rows"))
        rows.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")
        commits.commit(batch.sparkSession, path, batch_id, {"rows": seen.get["rows"]})

    return write


def tables_writer(path: str, kinds=tuple(logs.PARSERS), fmt: str = "parquet"):
    """Sink that parses each kind's lines and writes its table. Readers see a batch's tables all at once, or none."""
    def write(batch: DataFrame, batch_id: int) -> None:
        note = {}
        for kind in kinds:
            seen = Observation()
            rows = logs.PARSERS[kind](batch.where(F.col("kind") == kind).select("value"))
            rows = rows.observe(seen, F.count("*").alias("rows"))
            rows.write.mode("overwrite").format(fmt).save(f"{path}/{kind}/batch_id={batch_id}")
            note[kind] = seen.get["rows"]
        commits.commit(batch.sparkSession, path, batch_id, note)

    return write


def start(
    rows: DataFrame, sink, checkpoint: str, once: bool = True, every: str = "2 seconds"
) -> StreamingQuery:
    """Run ``rows`` into ``sink``; ``once`` takes what is there and stops.

    Otherwise a batch begins every so often; followed files also wait for so many bytes, or for
    the oldest of them to have waited so long (``flushBytes``, ``flushSeconds``).
    """
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return (
        rows.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def read_sink(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """Rows of the committed batches of a sink's table."""
    return commits.read_committed(spark, path, table)


def watermarked(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests of a stream whose clock is the latest of all of them, whatever becomes of it later."""
    return requests.withWatermark("log_time", late) if requests.isStreaming else requests


def noise_windows(left_out: DataFrame) -> DataFrame:
    """Left-out rows per category and 120 s window. On a stream they come from ``watermarked`` requests: a clock of
    left-out rows alone would stand still while only candidates arrive, and their windows would never end."""
    return (
        left_out.groupBy(F.window("log_time", "120 seconds").alias("w"), "noise_category")
        .agg(F.count("*").alias("count"))
        .select(F.col("w.start").alias("window_start"), "noise_category", "count")
    )
