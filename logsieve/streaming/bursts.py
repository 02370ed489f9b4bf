"""Probing bursts of a stream, with the whole record of the batch operator.

Each micro-batch adds its probes to those that are still open, finds the starts of all of them with the batch operator
(a busy address in parallel chunks, see ``chains``), emits every burst that ended before the watermark and keeps the
rest. The watermark is the latest time of any request less the allowed lateness; probes behind it are dropped and
counted. A burst ends before the watermark only with its whole window, so no accepted probe can belong to it, and what
is kept goes on as if nothing had been cut.

State is one table of open probes for each batch id, in the shared folder, and becomes valid with the batch's note
(see ``commits``). A batch that is run again starts from the note before it and overwrites what it left, so bursts
are neither lost nor doubled. No key has its own state in one task.
"""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logsieve.operators import bursts
from logsieve.sources import store
from logsieve.streaming import commits

c = F.col


def tracker(path: str, late: str = "10 minutes"):
    """Sink for ``foreachBatch`` over canonical requests: bursts below ``path/bursts``, open probes below ``path/open``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = commits.last_commit(spark, path, below=batch_id)
        old, note = last or (None, {"watermark": None, "late_total": 0})
        mark = note["watermark"]
        clock, counted = Observation(), Observation()
        timed = batch.observe(clock, F.max(F.unix_millis("log_time")).alias("latest"))
        behind = F.lit(False) if mark is None else c("ms") < F.lit(mark)
        rows = bursts.probes(timed).observe(counted, F.count_if(behind).alias("late")).where(~behind)
        new = store.materialize(rows, "stream-probes")
        waiting = new if old is None else new.unionByName(spark.read.schema(new.schema).parquet(f"{path}/open/batch_id={old}"))
        latest = clock.get["latest"]
        reach = F.expr(f"interval {late}")
        since = None if latest is None else spark.range(1).select(F.unix_millis(F.timestamp_millis(F.lit(latest)) - reach)).first()[0]
        mark = max((x for x in (mark, since) if x is not None), default=None)
        assigned = store.materialize(bursts.with_starts(waiting), "stream-starts")
        closed = F.lit(False) if mark is None else c("start_ms") + bursts.GAP < F.lit(mark)
        found = bursts.summaries(assigned.where(closed))
        found.write.mode("overwrite").parquet(f"{path}/bursts/batch_id={batch_id}")
        assigned.where(~closed).drop("start_ms").write.mode("overwrite").parquet(f"{path}/open/batch_id={batch_id}")
        commits.commit(spark, path, batch_id, {"watermark": mark, "late": counted.get["late"], "late_total": note["late_total"] + counted.get["late"]})
        store.release(new, assigned)
        if old is not None:  # this batch is run again from the one before it at most
            earlier = commits.last_commit(spark, path, below=old)
            if earlier is not None:
                store.remove(spark, f"{path}/open/batch_id={earlier[0]}")

    return write


def read_bursts(spark: SparkSession, path: str) -> DataFrame:
    return commits.read_committed(spark, path, "bursts")
