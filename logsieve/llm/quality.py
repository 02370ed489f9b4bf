"""Quality by importance resampling (DSIR): two hashed n-gram models and a Gumbel top-k.

The target model counts n-grams of labelled good documents that are not toxic, the raw model those
of all documents. A document's log weight is the log of the ratio of its probabilities under both.
Adding Gumbel noise and keeping the k largest samples k documents without replacement, each
with a chance in proportion to its weight.

N-grams are words and word pairs, and within them three-byte pieces and whether a word repeats the one before it:
words hardly recur in different documents, pieces do. A labelled document's own n-grams are left out of
the target model when it is weighed, so it is not favoured over unlabelled ones like it. Ratios are
shrunk towards one: rare n-grams by SMOOTH, and all by SHRINK in the logarithm, because small differences (languages are
not labelled in proportion) would add up over a long text. The sum is tempered by the square root of the length (TEMPER).

Toxic documents read like others but for single words, which a sum over all n-grams hides. So buckets of
words and of their parts that are much more frequent in documents labelled toxic than in those labelled
not toxic make up a second ratio: the sum of their log-odds, by the square root of the length, as a multiple of what
all but CLEAN_LOSS of the documents labelled not toxic have. Beyond that, it takes LEAST_RATIO times the multiple off the log
weight. A label without a value for toxic counts as not toxic for the target and is left out here; without toxic labels
nothing is taken off.

A document whose weight is below exp(-LEAST_RATIO) has no chance under the target and is never sampled, however many
are asked for. Documents without words (null, empty, blank) have no weight and are never kept. Rows that tie with
the k-th are kept with it, so repeated rows share their fate. Without good labels the weights are all
0 and the sample is uniform; without any label every document with words is kept. An empty table gives
an empty result.

SMOOTH, SHRINK and TEMPER were chosen on the labelled documents of the two smaller test tables: within a factor of two of
each, no labelled junk was kept and the same good documents to one in a hundred.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm import columns, words
from logsieve.sources import store

#: Hash buckets of the models.
DIM = 1 << 18
#: The target model learns from so many labelled good documents at most, chosen by hash.
MAX_TARGET = 20_000
#: Imaginary n-grams in each bucket, shared between the models as all n-grams are; what is taken off a log ratio; the tempering.
SMOOTH, SHRINK, TEMPER = 20, 1.0, 30
#: Bytes that one step of the pieces takes.
STEP = 1 << 20
#: Documents with a log weight below its negative are never sampled.
LEAST_RATIO = 20
#: Markers of toxic documents: buckets, bytes of a part of a word, labelled documents that have it at least, log-odds
#: at least, and the share of documents labelled not toxic that may be lost. MAX_TARGET of each kind are learnt from.
TOXIC_DIM, PART, LEAST_DOCS, LEAST_ODDS, CLEAN_LOSS = 1 << 20, 5, 3, math.log(8), 0.01
#: Rows of the last interval when the k-th value is looked for; more are split again.
LAST = 4096
U64 = np.uint64


def _slots(text: list, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word and pair of a batch, the text it belongs to, and of each text: words, and words that repeat the one before."""
    h, at = words.hashes(text)
    doc = np.repeat(np.arange(len(text)), np.diff(at))
    pair = words.grams(h, 2)
    same = doc[1:] == doc[:-1]
    slot = np.concatenate([h, pair[same] if len(h) > 1 else pair]) % U64(dim)
    again = np.bincount(doc[1:][same & (h[1:] == h[:-1])], minlength=len(text))
    return slot.astype(np.int64), np.concatenate([doc, doc[1:][same]]), np.stack([np.diff(at), again])


def _ngrams(text: list, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams of a batch and the texts they belong to, in parts: words and pairs below ``dim``, the rest above."""
    slot, doc, (n, again) = _slots(text, dim)
    yield slot, doc
    places = np.arange(len(text))
    for k, times in ((0, again), (1, np.maximum(n - 1, 0) - again)):
        yield np.full(int(times.sum()), 2 * dim + k), np.repeat(places, times)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in text]
    ends, flat = np.cumsum([len(x) for x in raw], dtype=np.int64), np.frombuffer(b"".join(raw), np.uint8)
    for a in range(0, len(flat) - 2, STEP):
        b = flat[a : a + STEP + 2].astype(np.uint32)
        piece = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        place = np.arange(a, a + len(piece))
        doc = np.searchsorted(ends, place, "right")
        whole = place + 2 < ends[doc]
        slot = words.mix(piece[whole].astype(U64)) % U64(dim)
        yield dim + slot.astype(np.int64), doc[whole]


def count_ngrams(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """slot, n_raw, n_target over docs (text, is_target)."""
    size = 2 * dim + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in words.cut(batches):
            good = b.column("is_target").to_numpy(zero_copy_only=False).astype(bool)
            for slot, doc in _ngrams(b.column("text").to_pylist(), dim):
                raw += np.bincount(slot, minlength=size)
                target += np.bincount(slot[good[doc]], minlength=size)
        k = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"slot": k, "n_raw": raw[k], "n_target": target[k]})

    seen = docs.select("text", "is_target").mapInArrow(run, "slot long, n_raw long, n_target long")
    return seen.groupBy("slot").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))


def count_slots(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """slot, n_raw, n_target of words and word pairs only."""
    return count_ngrams(docs, dim).where(F.col("slot") < dim)


def _parts(text: list, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word and each PART bytes of a word (of those that known has), the text it belongs to, and how many each text has."""
    h, at = words.hashes(text, plain=True)
    slots, docs = [(h % U64(TOXIC_DIM)).astype(np.int64)], [np.repeat(np.arange(len(text)), np.diff(at))]
    raw = [(t or "").lower().encode("utf-8", "surrogatepass").translate(words._PLAIN) for t in text]
    ends, base = np.cumsum([len(x) + 1 for x in raw], dtype=np.int64), 0
    for piece in words._slices(b"\n".join([*raw, b""])):
        buf = np.frombuffer(piece, np.uint8)
        n = max(0, len(buf) - PART + 1)
        g, gap = np.zeros(n, U64), np.zeros(n, bool)
        for k in range(PART):
            g = g * U64(words._BASE) + buf[k : k + n].astype(U64)
            gap |= words._SPACE[buf[k : k + n]]
        place = np.flatnonzero(~gap)
        slot = (words.mix(g[place]) % U64(TOXIC_DIM)).astype(np.int64)
        if known is not None:
            place, slot = place[known[slot]], slot[known[slot]]
        slots.append(slot)
        docs.append(np.searchsorted(ends, place + base, "right"))
        base += len(buf)
    slot, doc = np.concatenate(slots), np.concatenate(docs)
    if known is not None:
        slot, doc = slot[known[slot]], doc[known[slot]]
    each = np.unique(doc * TOXIC_DIM + slot)
    return each % TOXIC_DIM, each // TOXIC_DIM, np.array([len(x) for x in raw], np.int64)


class Toxic:
    """Labelled documents, toxic ones and others, by bucket; TOXIC_DIM numbers each, whatever the corpus."""

    def __init__(self, labelled: DataFrame):
        """labelled: doc_id, text, toxic (1, or 0)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((2, TOXIC_DIM), np.int64)
            for b in words.cut(batches):
                slot, doc, _ = _parts(b.column("text").to_pylist())
                toxic = b.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                n += np.bincount(toxic[doc] * TOXIC_DIM + slot, minlength=2 * TOXIC_DIM).reshape(2, TOXIC_DIM)
            k = np.flatnonzero(n[1])
            yield pa.RecordBatch.from_pydict({"slot": k, "clean": n[0][k], "toxic": n[1][k]})
            rest = np.flatnonzero((n[1] == 0) & (n[0] > 0))
            yield pa.RecordBatch.from_pydict({"slot": rest, "clean": n[0][rest], "toxic": n[1][rest]})

        self.least = math.inf
        self.n = dict(labelled.groupBy("toxic").count().collect())
        self.clean, self.toxic = np.zeros(TOXIC_DIM, np.int32), np.zeros(TOXIC_DIM, np.int32)
        if self.n.get(1) and self.n.get(0):
            counts = labelled.select("text", "toxic").mapInArrow(run, "slot long, clean long, toxic long").groupBy("slot")
            got = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(f"toxic >= {LEAST_DOCS}").toArrow()
            slot = got["slot"].to_numpy()
            self.clean[slot], self.toxic[slot] = got["clean"].to_numpy(), got["toxic"].to_numpy()
            clean = toxic_weight(labelled.where("toxic = 0").select("text", "toxic"), self).select("toxic_weight")
            self.least = max(0.0, kth_largest(clean, "toxic_weight", 1 + int(CLEAN_LOSS * self.n[0])))

    def weigh(self, text: list, own: np.ndarray) -> np.ndarray:
        """Weight of the markers of each text. own: 1 and 0 for those that were learnt from as toxic or not, else -1."""
        slot, doc, length = _parts(text, self.toxic >= LEAST_DOCS)
        toxic, clean = self.toxic[slot] - (own[doc] == 1), self.clean[slot] - (own[doc] == 0)
        odds = np.log((toxic + 0.5) / (self.n.get(1, 0) + 1) * (self.n.get(0, 0) + 1) / (clean + 0.5))
        odds[(toxic < LEAST_DOCS) | (odds < LEAST_ODDS)] = 0
        return np.bincount(doc, weights=odds, minlength=len(text)) / np.sqrt(np.maximum(length, 1))


def toxic_weight(docs: DataFrame, model: Toxic) -> DataFrame:
    """docs (text, toxic, ...) with toxic_weight."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.cut(batches):
            own = b.column("toxic").fill_null(-1).to_numpy(zero_copy_only=False)
            yield b.append_column("toxic_weight", pa.array(shared.value.weigh(b.column("text").to_pylist(), own)))

    return docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", toxic_weight double")


class Model:
    """Counts of both models by bucket; a fixed number of them, whatever the corpus."""

    def __init__(self, counts: DataFrame, dim: int = DIM):
        self.dim, size = dim, 2 * dim + 2
        self.raw, self.target = np.zeros(size), np.zeros(size)
        got = counts.toArrow()
        slot = got["slot"].to_numpy()
        self.raw[slot], self.target[slot] = got["n_raw"].to_numpy(), got["n_target"].to_numpy()
        self.share = self.target.sum() / max(1.0, self.raw.sum())
        self.ratio = self.log_ratio(np.arange(size), 0)
        self.bad: Toxic | None = None

    def log_ratio(self, slot: np.ndarray, own: np.ndarray | int) -> np.ndarray:
        """Shrunk log ratio of the models in some buckets, without a target document's ``own`` n-grams in them."""
        if not self.share:
            return np.zeros(len(slot))
        ratio = np.log((self.target[slot] - own + SMOOTH * self.share) / (self.raw[slot] + SMOOTH) / self.share)
        return np.sign(ratio) * np.maximum(0, np.abs(ratio) - SHRINK)

    def weigh(self, text: list, is_target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of words and of n-grams, and log weight, of each text."""
        m = len(text)
        n, total, some = np.zeros(m, np.int64), np.zeros(m), np.zeros(m, np.int64)
        for k, (slot, doc) in enumerate(_ngrams(text, self.dim)):
            here = np.bincount(doc, minlength=m)
            n += here
            some = here if k == 0 else some
            total += np.bincount(doc, weights=self.ratio[slot], minlength=m)
        for i in np.flatnonzero(is_target).tolist():
            own = np.zeros(len(self.raw), np.int64)
            for slot, _ in _ngrams([text[i]], self.dim):
                own += np.bincount(slot, minlength=len(own))
            u = np.flatnonzero(own)
            total[i] += (own[u] * (self.log_ratio(u, own[u]) - self.ratio[u])).sum()
        return some, n, total * TEMPER / np.sqrt(np.maximum(n, 1))


def weigh(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, is_target, toxic, ...) with n_grams and log_weight (null without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in words.cut(batches):
            text = b.column("text").to_pylist()
            some, n, w = model.weigh(text, b.column("is_target").to_numpy(zero_copy_only=False).astype(bool))
            if (bad := model.bad) and bad.least < math.inf:
                own = b.column("toxic").fill_null(-1).to_numpy(zero_copy_only=False)
                times = bad.weigh(text, own) / max(bad.least, 1e-9)
                w = w - np.where(times > 1, LEAST_RATIO * times, 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), pa.array(w, mask=some == 0)], names=[*b.schema.names, "n_grams", "log_weight"])

    own = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{own}, n_grams long, log_weight double")


def kth_largest(df: DataFrame, value: str, k: int) -> float | None:
    """Exact k-th largest of a double column, from histograms of bounded size."""
    df = df.select(value).where(F.col(value).isNotNull())
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None or k < 1:
        return None
    bins = 4096
    while low < high:
        inside = df.where(F.col(value).between(low, high))
        step = (high - low) / bins
        if step == 0 or low + step == low:
            step = math.ulp(high)
        at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.lit(low)) / F.lit(step)).cast("int"))
        rows = inside.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["b"]):
            if k <= r["n"]:
                break
            k -= r["n"]
        if r["n"] <= LAST:
            last = df.where(F.col(value).between(r["lo"], r["hi"])).collect()
            return sorted((x[0] for x in last), reverse=True)[k - 1]
        if (r["lo"], r["hi"]) == (low, high):
            break
        low, high = r["lo"], r["hi"]
    return high


def fit(docs: DataFrame, labels: DataFrame, seed: int = 0, dim: int = DIM, max_target: int = MAX_TARGET) -> tuple[Model, DataFrame, float]:
    """Both models, the ids of the labelled documents learnt from, and the share of good ones among the labelled.

    ``labels``: doc_id, quality, toxic; good is quality 1 and not toxic (null: not toxic).
    """
    judged = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    n, n_good = judged.agg(F.count("*"), F.count(F.when(good, 1))).first()
    by_id = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id"))
    known = by_id.agg(F.coalesce(F.max(good), F.lit(False)).alias("good"), F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))

    def chosen(which: Column) -> DataFrame:
        return known.where(which).orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(max_target).select("_id")

    good_ids = chosen(F.col("good")).withColumns({"good": F.lit(True), "toxic": F.lit(None).cast("int")})
    kinds = [chosen(F.col("toxic") == k).withColumns({"good": F.lit(False), "toxic": F.lit(k)}) for k in (0, 1)]
    ids = good_ids.unionByName(kinds[0]).unionByName(kinds[1]).groupBy("_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    ids = store.materialize(ids, "label-ids")
    marked = mark(docs.select("doc_id", "text"), ids)
    model = Model(count_ngrams(marked, dim), dim)
    labelled = store.materialize(marked.where("toxic is not null").select("doc_id", "text", "toxic"), "labelled")
    model.bad = Toxic(labelled)
    store.release(labelled)
    return model, ids, n_good / n if n else 1.0


def mark(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs with is_target and toxic: whether the target model learns from it, and as what (1, 0 or null) the markers do."""
    # at most three times max_target ids, so this broadcast has a fixed bound
    marked = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left")
    return marked.select(*docs.columns, F.coalesce("good", F.lit(False)).alias("is_target"), "toxic")


def perturbed(docs: DataFrame, model: Model, ids: DataFrame, seed: int = 0) -> DataFrame:
    """docs (doc_id, text, ...) with n_grams, log_weight and score, the weight with seeded Gumbel noise (null without a chance)."""
    docs = docs.drop("n_grams", "log_weight", "score", "kept", "is_target", "toxic")
    seen = F.xxhash64(F.col("doc_id"), F.lit(seed), F.length("text"))
    u = (F.pmod(seen, F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    weighed = weigh(mark(docs, ids), model).drop("is_target", "toxic")
    return weighed.withColumn("score", F.when(F.col("log_weight") >= -LEAST_RATIO, F.col("log_weight") - F.log(-F.log(u))))


def least_kept(scored: DataFrame, keep: float) -> float | None:
    """The least score among the share ``keep`` of the rows with a weight; of all rows with a score if they are fewer."""
    weighed, with_score = scored.agg(F.count("log_weight"), F.count("score")).first()
    return kth_largest(scored, "score", min(round(keep * weighed), with_score))


def sample(scored: DataFrame, keep: float) -> DataFrame:
    """scored with kept: true for the share ``keep`` of the rows with a weight that has the largest scores."""
    least = least_kept(scored, keep)
    kept = F.lit(False) if least is None else F.coalesce(F.col("score") >= F.lit(least), F.lit(False))
    return scored.withColumn("kept", kept)


def resample(docs: DataFrame, labels: DataFrame, seed: int = 0, keep: float | None = None, **bounds: int) -> DataFrame:
    """doc_id, n_grams, log_weight, score and kept of each row of docs (doc_id, text).

    ``keep``: the share that is sampled; by default the share of good ones among the labels.
    """
    model, ids, share = fit(docs, labels, seed, **bounds)
    light = perturbed(docs.select("doc_id", "text"), model, ids, seed).drop("text")
    return sample(store.materialize(light, "weights"), share if keep is None else keep)


def keep_good(docs: DataFrame, labels: DataFrame, seed: int = 0, keep: float | None = None, **bounds: int) -> DataFrame:
    """The rows of docs that the sample keeps, with their columns."""
    model, ids, share = fit(docs, labels, seed, **bounds)
    # weighed once: the texts are written with their scores, and read again when the least kept score is known
    scored = store.materialize(perturbed(docs.select("doc_id", "text", columns.pack(docs, "doc_id", "text")), model, ids, seed), "weights")
    least = least_kept(scored, share if keep is None else keep)
    return scored.where(F.col("score") >= F.lit(math.inf if least is None else least)).select(*columns.unpack(docs.columns, "doc_id", "text"))
