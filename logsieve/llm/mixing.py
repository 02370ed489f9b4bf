"""Mixing sources to target weights by capped water-filling.

Every source asks for words in proportion to its weight. A source that would be read more
than ``max_epochs`` times is clamped, and what it could not take goes to the others by
weight, again and again until none is above its clamp. Each document is then repeated the
whole number of epochs, and the fraction left is filled with documents in a seeded order.

Null sources form one source. Texts that are null or without words have size 0: they take
nothing, and are repeated as the others of their source. Rows that repeat a document count
again. An empty table gives an empty mix. If all sources are clamped, the mix is shorter than
asked for. Columns of docs named as the added ones (size, source_size, target, epochs, taken, copy) are left out.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve.llm import columns, words
from logsieve.sources import store

#: Parts of the seeded order; one of them per source is sorted, the rest is decided by sums.
BUCKETS = 4096


def weights_by_rank(sources: DataFrame, cycle: Sequence[float]) -> DataFrame:
    """Adds ``weight``: the sources by code point, null last, take the weights of the cycle in turn."""
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), at % len(cycle) + 1))


def fill_level(sources: DataFrame, total: float, max_epochs: float) -> float | None:
    """Words for each unit of weight, where each takes ``least(clamp, level * weight)``. None: all are clamped."""
    cap, w = F.col("source_size") * F.lit(float(max_epochs)), F.col("weight")
    level, clamped = 0.0, None
    while True:
        over = F.lit(clamped is not None) & (cap < F.lit(level) * w)
        row = sources.agg(
            F.sum(F.when(over, cap).otherwise(0.0)).alias("fixed"), F.sum(F.when(over, 0.0).otherwise(w)).alias("open"),
            F.sum(over.cast("long")).alias("n"),
        ).first()
        if not row["open"]:
            return None
        if row["n"] == clamped:
            return level
        clamped, level = row["n"], (total - row["fixed"]) / row["open"]


def order_key(seed: int, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, cycle: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 0) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target, epochs (whole repetitions taken) and taken.

    ``share``: words of the mix, as a part of all words.
    """
    own = [n for n in docs.columns if n in ("size", "source_size", "target", "epochs", "taken")]
    names = [n for n in docs.columns if n not in own]
    docs = docs.select("doc_id", "text", "source", columns.pack(docs.drop(*own), "doc_id", "text", "source"))
    key = order_key(seed, F.col("doc_id"))
    sized = docs.withColumns({
        "size": words.count(F.col("text")), "_key": key, "_bucket": F.conv(F.substring(key, 1, 3), 16, 10).cast("int"),
    })
    parts = store.materialize(sized.groupBy("source", "_bucket").agg(F.sum("size").alias("n")), "mix-parts")
    sources = parts.groupBy("source").agg(F.sum("n").alias("source_size"))
    sources = store.materialize(weights_by_rank(sources, cycle), "mix-sources")
    total = float(share) * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = fill_level(sources, total, max_epochs)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    target = cap if level is None else F.least(cap, F.lit(level) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("target", target).withColumn("whole", whole)
    sources = sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sums = Window.partitionBy("source").orderBy("_bucket")
    cut = (
        parts.withColumn("before", F.sum("n").over(sums) - F.col("n"))
        .join(sources.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))
        .select("s", F.col("_bucket").alias("cut"), "before")
    )
    plan = sources.select(F.col("source").alias("_s"), "source_size", "target", "whole", F.col("rest").alias("left")).join(
        cut, F.col("_s").eqNullSafe(F.col("s")), "left"
    )
    plan = store.materialize(plan.drop("s"), "mix-plan")
    planned = sized.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    at_cut = F.coalesce(F.col("_bucket") == F.col("cut"), F.lit(False))
    inside = planned.where(~at_cut).withColumn("_more", F.coalesce(F.col("_bucket") < F.col("cut"), F.lit(False)))
    run = Window.partitionBy("_s", "_bucket").orderBy("_key", "size", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0))
    edge = planned.where(at_cut).withColumn("_more", start + F.col("size") / 2 < F.col("left"))
    out = inside.unionByName(edge).withColumn("epochs", (F.col("whole") + F.col("_more").cast("long")).cast("long"))
    return out.withColumn("taken", F.col("epochs") * F.col("size")).select(
        *columns.unpack(names, "doc_id", "text", "source"), "size", "source_size", "target", "epochs", "taken"
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """One row for each repetition, numbered by ``copy`` from 1; documents not taken are left out."""
    return mixed.where("epochs > 0").drop("copy").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs"))))
