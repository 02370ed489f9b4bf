"""Document fingerprints by consistent weighted sampling.

A text's terms are its pairs of neighbouring words (the last word pairs with the end); a term's
weight is how often it occurs. For each of SAMPLES samples every term draws r and c from
Gamma(2, 1) and b from [0, 1), all fixed by the term and the sample; with t = floor(ln w / r + b)
the term scores ln c - r * (t - b + 1), and the least score is the sample. Two texts share a
sample with a probability equal to their generalised Jaccard similarity, the sum of the smaller
weights over the sum of the larger.

Draws come from hashes by inversion of the distribution in LEVELS steps. A score stands for its
term and t, so only scores are kept. Texts that are null or without words have an empty
fingerprint: two of them are alike (1), one of them and another text are not (0).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve.functions.stage import hold
from logsieve.sources import store

SAMPLES = 32
LEVELS = 512
#: Characters of text in one partition: what a task groups by term must fit its memory.
PART = 4_000_000
_NONE = -(1 << 63)


def _gamma_quantile(p: float) -> float:
    """Of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x)."""
    from math import exp

    low, high = 0.0, 60.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - (1 + mid) * exp(-mid) < p else (low, mid)
    return (low + high) / 2


def _levels(log: bool) -> Column:
    from math import log as ln

    found = [_gamma_quantile((i + 0.5) / LEVELS) for i in range(LEVELS)]
    return F.from_json(F.lit(str([round(ln(x) if log else x, 9) for x in found])), "array<double>")


def sample_score(term: Column, weight: Column, sample: int, r_levels: Column, c_levels: Column) -> Column:
    """ln a of one term; null for a null term. ``weight``: its natural logarithm."""
    h = F.xxhash64(term, F.lit(sample))
    r = F.get(r_levels, h.bitwiseAND(LEVELS - 1).cast("int"))
    c = F.get(c_levels, F.shiftrightunsigned(h, 20).bitwiseAND(LEVELS - 1).cast("int"))
    b = F.shiftrightunsigned(h, 34).cast("double") * F.lit(2.0**-30)
    return F.when(term.isNotNull(), c - r * (F.floor(weight / r + b) - b + F.lit(1.0)))


def sketches(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and sketch (array<double>, nulls without terms) of texts (keys, text).

    If the rows are already partitioned by some of the keys, nothing is shuffled.
    """
    parted = hold(texts.select(*keys, "text"), {"ws": F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")})
    pairs = F.arrays_zip(F.col("ws").alias("a"), F.slice("ws", 2, F.greatest(F.size("ws"), F.lit(1))).alias("b"))
    terms = parted.select(*keys, F.inline_outer(pairs).alias("a", "b"))
    terms = terms.select(*keys, F.when(F.col("a").isNotNull(), F.xxhash64("a", "b")).alias("term"))
    weighted = terms.groupBy(*keys, "term").agg(F.log(F.count("*").cast("double")).alias("weight"))
    r, c = _levels(False), _levels(True)
    least = [F.min(sample_score(F.col("term"), F.col("weight"), k, r, c)).alias(f"s{k}") for k in range(samples)]
    found = weighted.groupBy(*keys).agg(*least)
    return found.select(*keys, F.array(*[f"s{k}" for k in range(samples)]).alias("sketch"))


def as_text(sketch: Column) -> Column:
    """Eight hex digits for each sample; empty without terms."""
    digits = F.transform(sketch, lambda x: F.lpad(F.right(F.hex(F.xxhash64(x)), F.lit(8)), 8, "0"))
    return F.when(sketch[0].isNull(), F.lit("")).otherwise(F.array_join(digits, ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two sketches."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x))
    return same / F.size(a)


def in_order(docs: DataFrame) -> DataFrame:
    """key columns k, h, their number of rows m and characters n, and of the document before: prev_k, prev_h, prev_n.

    By doc_id (null first), then by text hash; the first follows the last. Rows with equal doc_id
    and text share a key. Only ids and lengths are sorted, in ranges, never all in one task.
    """
    ids = keyed(docs).groupBy("k", "h").agg(F.count("*").alias("m"), F.min(F.length("text")).alias("n"))
    parts = store.materialize(ids.repartitionByRange("k", "h").withColumn("pid", F.spark_partition_id()), "id-ranges")
    sums = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("pid").count().withColumn("start", F.coalesce(F.sum("count").over(sums), F.lit(0)))
    run = Window.partitionBy("pid").orderBy("k", "h")
    placed = parts.withColumn("rn", F.row_number().over(run)).join(starts.select("pid", "start"), "pid")
    total = parts.count()
    placed = placed.select("k", "h", "m", "n", (F.col("start") + F.col("rn")).alias("pos"))
    before = placed.select(
        (F.col("pos") % max(total, 1) + 1).alias("pos"), F.col("k").alias("prev_k"), F.col("h").alias("prev_h"), F.col("n").alias("prev_n")
    )
    return placed.join(before, "pos").select("k", "h", "m", "n", "prev_k", "prev_h", "prev_n")


def keyed(docs: DataFrame) -> DataFrame:
    """text (null: empty), k (doc_id, or the least number for null), h."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("k"), F.xxhash64("doc_id", text).alias("h")
    )


def edited_pairs(docs: DataFrame, order: DataFrame) -> DataFrame:
    """k, h, i (which of equal rows), doc_id, n, text, edited, next_k, next_h.

    edited: the last half of the text replaced by the start of the next document, or of itself
    where an equal row follows. The texts are shuffled once by key, their starts once more: both uses of
    the keyed texts read the same columns, so that Spark reuses the shuffle.
    """
    chars = order.agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART))
    rows = keyed(docs).repartition(parts, "k", "h").join(order.drop("n").repartition(parts, "k", "h"), ["k", "h"])
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("k", "h").orderBy(F.lit(1))))
    rows = rows.withColumn("n", F.length("text"))
    heads = rows.where("i = 1").select(
        F.col("prev_k").alias("k"), F.col("prev_h").alias("h"), F.col("k").alias("next_k"), F.col("h").alias("next_h"),
        F.left("text", F.floor(F.col("prev_n") / 2).cast("int")).alias("head"),
    ).repartition(parts, "k", "h")
    half = F.floor(F.col("n") / 2).cast("int")
    both = rows.select("k", "h", "i", "m", "n", "text").join(heads, ["k", "h"])
    more = F.col("i") < F.col("m")
    tail = F.when(more, F.left("text", half)).otherwise(F.col("head"))
    return both.select(
        "k", "h", "i", F.when(F.col("k") != _NONE, F.col("k")).alias("doc_id"), "n", "text", F.concat(F.left("text", F.col("n") - half), tail).alias("edited"),
        F.when(more, F.col("k")).otherwise(F.col("next_k")).alias("next_k"),
        F.when(more, F.col("h")).otherwise(F.col("next_h")).alias("next_h"),
    )


def compare_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and its edited text, and how near it is to the edited and to the next text."""
    order = store.materialize(in_order(docs), "doc-order")
    pairs = edited_pairs(docs, order)
    key = ["k", "h", "i"]
    light = store.materialize(
        pairs.select(*key, "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "next_k", "next_h"),
        "edited",
    )
    both = pairs.select(*key, F.inline(F.array(F.struct(F.lit(0).alias("side"), "text"), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))))
    found = store.materialize(sketches(both, [*key, "side"], samples), "sketches")
    own = found.where("side = 0").select(*key, F.col("sketch").alias("a"))
    new = found.where("side = 1").select(*key, F.col("sketch").alias("b"))
    following = found.where("side = 0 and i = 1").select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("sketch").alias("c"))
    joined = light.join(own, key).join(new, key).join(following, ["next_k", "next_h"])
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
