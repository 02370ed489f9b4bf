"""Language model scoring with a Katz backoff bigram model.

Counts r of 1 to K are discounted by Good-Turing, larger ones by r / (r + 1), so every history keeps
some mass; a discount that Good-Turing can't give (too few counts) is (r - 0.5) / r. With c counts over
training tokens, N their number and V the number of different ones:

    p(w)     = (c(w) + 1) / (N + V + 1)              unknown words count as one
    p(w | h) = d(r) r / c(h)                         if the pair occurs r times in training
             = a(h) p(w)                             if not; a(h) = 1 for an unknown history
    a(h)     = (1 - sum d(r) r / c(h)) / (1 - sum p(w)), both over the words seen after h

so that p(. | h) sums to exactly one. The first history is a start mark, the last token an end mark.

Pairs of very frequent words (each at least a HOT-th of all tokens: a table of fixed size) are scored where
the texts are. All other pairs are dealt to buckets by the second word, those whose second word makes up a KNOWN-th
of all tokens or more (again a table of fixed size, with their counts) by both words, so no word fills a bucket. A
bucket's task counts its pairs, a few words at a time, writes them as a part of the model table and sums, for
each document, what its pairs add to the score. What depends on the history alone is split off:
-log c(h) is added where h is the second word, and only pairs not seen in training are joined with the
backoff table. So texts are never shuffled and each pair travels once.

Null texts are empty: just an end mark. Repeated rows count and are scored one by one. Without
training rows N and V are 0 and every token has probability 1. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm import words
from logsieve.llm.near import _groups
from logsieve.llm.words import U64, mix
from logsieve.sources import store

K = 5
HOT, KNOWN = 512, 1 << 16
START, END = U64(0x5354415254), U64(0x454E44)
#: Tokens of one block of texts, and of one bucket.
BLOCK, BUCKET = 500_000, 1_500_000
#: Parts of a bucket that are counted one after the other, by the hash of the second word.
PARTS = 8
#: Entries of one row of the model or of sums, and bytes of one Arrow batch: what a task holds besides its bucket.
ROW_LEN, BATCH = 200_000, 8 << 20
#: Counts of a document's pairs by r, in one number; a larger count takes several entries.
BITS = 12
DIGIT = 1 << BITS
#: Rows whose sums one task adds up at a time.
SPAN = 1 << 16
L64 = pa.list_(pa.int64())
ROW = "bucket int, kind int, base long, w array<long>, h array<long>, n array<long>, at array<int>, w4 array<int>, h4 array<int>, ids array<long>, size array<long>, s array<double>, b array<double>, known array<long>, k array<long>"
FIELDS = pa.schema([
    ("bucket", pa.int32()), ("kind", pa.int32()), ("base", pa.int64()), ("w", L64), ("h", L64), ("n", L64),
    ("at", pa.list_(pa.int32())), ("w4", pa.list_(pa.int32())), ("h4", pa.list_(pa.int32())), ("ids", L64), ("size", L64),
    ("s", pa.list_(pa.float64())), ("b", pa.list_(pa.float64())),
    ("known", L64), ("k", L64),
])
#: Kinds of rows: pairs of a bucket in the model, a block's documents, a block's pairs, sums for documents, pairs not seen.
MODEL, DOCS, PAIRS, SUMS, UNSEEN = range(5)


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Histories, tokens, and the number of each one's text."""
    h, at = words.hashes(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(at) + 1)
    return np.insert(h, at[:-1], START), np.insert(h, at[1:], END), doc


def _row(**x) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([x], schema=FIELDS)


def _rows(cuts: list[int], /, **x) -> Iterator[pa.RecordBatch]:
    """Rows for the parts between cuts; numbers are repeated, arrays are cut."""
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        yield _row(**{k: v[a:z] if isinstance(v, np.ndarray) else v for k, v in x.items()})


def _even(n: int) -> list[int]:
    return [*range(0, n, ROW_LEN), n]


def _at_words(w: np.ndarray) -> list[int]:
    """Cuts between different words of a sorted array, ROW_LEN apart or a little more."""
    new = np.concatenate([[0], np.flatnonzero(w[1:] != w[:-1]) + 1, [len(w)]])
    return np.unique(np.concatenate([new[np.searchsorted(new, _even(len(w))[:-1])], [len(w)]])).tolist()


def _packed(k: np.ndarray) -> Iterator[np.ndarray]:
    """How many of each document's pairs occur 1 to K times, as digits; several numbers if counts are large."""
    while True:
        part = np.minimum(k, DIGIT - 1)
        yield part @ (DIGIT ** np.arange(K))
        k = k - part
        if not k.any():
            return


def _sum_rows(ids: np.ndarray, **x) -> Iterator[pa.RecordBatch]:
    """SUMS rows for sorted row ids, cut so that each lies in one span; its first id is the row's base."""
    cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(ids // SPAN, prepend=-1)), _even(len(ids))])).astype(int).tolist()
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        yield from _rows([a, z], kind=SUMS, base=int(ids[a]) // SPAN * SPAN, ids=ids, **x)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about BLOCK tokens."""
    for b in batches:
        chars = np.cumsum(b.column("size").to_numpy(zero_copy_only=False))
        cuts = np.unique(np.concatenate([[0], np.searchsorted(chars, np.arange(BLOCK * 6, int(chars[-1]) if len(chars) else 0, BLOCK * 6)) + 1, [b.num_rows]]))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield b.slice(a, z - a)


def count_words(docs: DataFrame) -> DataFrame:
    """w, n of all tokens of docs (text, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            u, n = np.unique(tokens(b.column("text").to_pylist())[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["w", "n"])

    return docs.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


class Frequent:
    """The frequent words' counts and how often each follows each, at most (HOT + 2) squared numbers."""

    def __init__(self, found: dict[int, int], n_docs: int, least: float = 0):
        """found: counts of all words that are a KNOWN-th of all tokens; the frequent ones among them occur ``least`` times."""
        known = {w & (1 << 64) - 1: n for w, n in found.items()} | {int(START): n_docs, int(END): n_docs}
        self.known = np.array(sorted(known), U64)
        self.known_count = np.array([known[int(w)] for w in self.known], np.int64)
        count = {w: n for w, n in known.items() if n >= least or w in (int(START), int(END))}
        self.words = np.array(sorted(count), U64)
        self.count = np.array([count[int(w)] for w in self.words], np.int64)
        self.pairs = np.zeros((len(self.words), len(self.words)), np.int64)
        self.backoff = np.zeros(len(self.words))

    def find(self, w: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for those that are not frequent."""
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        return np.where(self.words[at] == w, at, -1)

    def place(self, w: np.ndarray) -> np.ndarray:
        """Place of each word among the known ones, -1 for those that make up less than a KNOWN-th of all tokens."""
        at = np.minimum(np.searchsorted(self.known, w), len(self.known) - 1)
        return np.where(self.known[at] == w, at, -1)

    def counts(self, w: np.ndarray) -> np.ndarray:
        """Count of each word, -1 for those that aren't known."""
        at = self.place(w)
        return np.where(at >= 0, self.known_count[at], -1)


def count_frequent(docs: DataFrame, frequent: Frequent) -> np.ndarray:
    shared, size = docs.sparkSession.sparkContext.broadcast(frequent), len(frequent.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for b in _blocks(batches):
            h, w, _ = tokens(b.column("text").to_pylist())
            i, j = shared.value.find(h), shared.value.find(w)
            both = (i >= 0) & (j >= 0)
            total += np.bincount(i[both] * size + j[both], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(size * size, np.int64)
    got = docs.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(size, size)


class Scale:
    """Numbers of the whole training text, and what a pair seen r times is worth."""

    def __init__(self, n: int, v: int):
        self.n, self.v = n, v
        self.discount = np.ones(K + 1)

    def learn(self, of_count: dict[int, int]) -> None:
        """of_count: how many pairs occur r times, r up to K + 1."""
        n = [0, *(of_count.get(r, 0) for r in range(1, K + 2))]
        last = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
        for r in range(1, K + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) if n[r] and last != 1 else 0.0
            self.discount[r] = d if 0 < d < 1 else (r - 0.5) / r

    def kept(self, n: np.ndarray) -> np.ndarray:
        """d(n) n."""
        return np.where(n <= K, self.discount[np.minimum(n, K)] * n, n / (n + 1.0) * n)

    def p(self, c: np.ndarray) -> np.ndarray:
        return (c + 1.0) / (self.n + self.v + 1.0)


def _history(c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """-log c(w), which the token after w needs; 0 for the end mark and unknown words."""
    return np.where((c > 0) & (w != END), -np.log10(np.maximum(c, 1)), 0.0)


def _pair(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(mix(w) + h)


def deal(docs: DataFrame, frequent: Frequent, scale: Scale, buckets: int, training: bool) -> DataFrame:
    """Rows of kind DOCS and PAIRS of docs (doc_id, text, size)."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, sc = shared.value
        for b in _blocks(batches):
            base, m = b.column("row")[0].as_py(), b.num_rows
            h, w, doc = tokens(b.column("text").to_pylist())
            i, j = hot.find(h), hot.find(w)
            both = (i >= 0) & (j >= 0)
            d, c, n = doc[both], hot.count[j[both]], hot.pairs[i[both], j[both]]
            per = lambda x: np.bincount(d, weights=x, minlength=m)  # noqa: E731, B023
            own = np.log10(np.maximum(n, 1)) if training else np.log10(np.where(n > 0, sc.kept(np.maximum(n, 1)), sc.p(c)))
            if training:
                own = np.where(n > K, np.log10(np.maximum(n * (n / (n + 1.0)), 1e-300)), own)
            else:
                own = own + np.where(n > 0, 0.0, hot.backoff[i[both]])
            s = per(own + _history(c, w[both])) - np.log10(max(1, hot.count[hot.find(np.array([START]))[0]]))
            yield _row(
                bucket=int(mix(np.array([base], np.int64).view(U64))[0] % U64(buckets)), kind=DOCS, base=base, ids=b.column("doc_id").to_pylist(),
                size=np.bincount(doc, minlength=m), s=s, b=per(np.log10(sc.p(c))), known=np.bincount(d[c > 0], minlength=m),
            )
            low = n <= K
            for k in _packed(np.bincount(d[low] * K + n[low] - 1, minlength=m * K).reshape(m, K)) if training else ():
                yield from _sum_rows(base + np.arange(m), bucket=int(mix(np.array([base], np.int64).view(U64))[0] % U64(buckets)), k=k)
            rest = ~both
            h, w, doc = h[rest], w[rest], doc[rest]
            i, j = hot.place(h), hot.place(w)
            bucket = np.where(j >= 0, _pair(w, h), mix(w + U64(1))) % U64(buckets)
            short = (i >= 0) & (j >= 0)
            # words of the known table travel as their places in it
            for part, x, y, kind, names in ((short, j, i, np.int32, ("w4", "h4")), (~short, w.view(np.int64), h.view(np.int64), np.int64, ("w", "h"))):
                mine = np.flatnonzero(part)
                mine = mine[np.lexsort((mix(x[mine].astype(np.int64).view(U64)) if kind is np.int64 else x[mine], bucket[mine]))]
                x, y, at, to = x[mine].astype(kind), y[mine].astype(kind), doc[mine].astype(np.int32), bucket[mine]
                cuts = [*np.flatnonzero(np.diff(to.astype(np.int64), prepend=-1)).tolist(), len(to)]
                for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                    yield _row(bucket=int(to[a]), kind=PAIRS, base=base, at=at[a:z], **{names[0]: x[a:z], names[1]: y[a:z]})

    rows = docs.withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, ROW)


def _flat(t: pa.Table, name: str, kind=np.int64) -> np.ndarray:
    col = t.column(name).combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The values of the asked keys (sorted keys), 0 for those that aren't there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0)


def tally(dealt: DataFrame, buckets: int, frequent: Frequent, scale: Scale, training: bool) -> DataFrame:
    """For each bucket: its MODEL row (in training), SUMS for documents, and DOCS rows as they are; UNSEEN pairs (not in training)."""
    shared, parts = dealt.sparkSession.sparkContext.broadcast((frequent, scale)), PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, sc = shared.value
        for (bucket,), t in _groups(batches, ["bucket"]):
            kind = t.column("kind").to_numpy()
            docs = t.filter(pa.array((kind == DOCS) | (kind == SUMS)))
            if docs.num_rows:
                yield from docs.to_batches()
            pairs, model = (t.select(["base", "w", "h", "n", "at", "w4", "h4"]).filter(pa.array(kind == k)) for k in (PAIRS, MODEL))
            del t, docs
            if not pairs.num_rows:
                continue
            long_ = pairs.column("w").is_valid()
            wide, short = pairs.filter(long_), pairs.filter(pa.compute.invert(long_))
            w, h = (np.concatenate([_flat(wide, k).view(U64), hot.known[_flat(short, f"{k}4", np.int32)]]) for k in ("w", "h"))
            doc = np.concatenate([
                _flat(x, "at") + np.repeat(x.column("base").to_numpy(), pa.compute.list_value_length(x.column("at")).to_numpy()) for x in (wide, short)
            ])
            del wide, short
            mw, mh, mn = (_flat(model, k) for k in ("w", "h", "n"))
            mw, mh = mw.view(U64), mh.view(U64)
            del pairs, model
            ids = np.unique(doc)
            score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
            of_count = np.zeros(len(ids) * K, np.int64)
            # all pairs of a word are in one part, so that its count can be read from there
            part, of_model = (mix(w + U64(2)) % U64(parts)).astype(np.int8), (mix(mw + U64(2)) % U64(parts)).astype(np.int8)
            for k in range(parts):
                mine = np.flatnonzero(part == k)
                pw, ph, at = w[mine], h[mine], np.searchsorted(ids, doc[mine])
                p, c = _pair(pw, ph), hot.counts(pw)
                if training:
                    u, first, back, n = np.unique(p, return_index=True, return_inverse=True, return_counts=True)
                    cold, where, count = np.unique(pw, return_inverse=True, return_counts=True)
                    c = np.where(c >= 0, c, count[where])
                    order = np.argsort(pw[first], kind="stable")
                    lw, lh = pw[first][order], ph[first][order]
                    # a word's pairs stay in one row
                    yield from _rows(_at_words(lw), bucket=bucket, kind=MODEL, w=lw.view(np.int64), h=lh.view(np.int64), n=n[order])
                    n = n[back]
                    s = np.where(n <= K, np.log10(n), np.log10(n * (n / (n + 1.0))))
                    low = n <= K
                    of_count += np.bincount(at[low] * K + n[low] - 1, minlength=len(ids) * K)
                else:
                    sub = of_model == k
                    cold, where = np.unique(mw[sub], return_inverse=True)
                    count = np.bincount(where, weights=mn[sub], minlength=len(cold)).astype(np.int64)
                    c = np.where(c >= 0, c, _found(cold, count, pw))
                    key = _pair(mw[sub], mh[sub])
                    order = np.argsort(key)
                    n = _found(key[order], mn[sub][order], p)
                    i = hot.find(ph)
                    s = np.log10(np.where(n > 0, sc.kept(np.maximum(n, 1)), sc.p(c))) + np.where((n == 0) & (i >= 0), hot.backoff[i], 0.0)
                    lost = (n == 0) & (i < 0)
                    if lost.any():
                        yield from _rows(_even(int(lost.sum())), bucket=bucket, kind=UNSEEN, h=ph[lost].view(np.int64), ids=ids[at[lost]])
                    known += np.bincount(at[c > 0], minlength=len(ids))
                score += np.bincount(at, weights=s + _history(c, pw), minlength=len(ids))
                base += np.bincount(at, weights=np.log10(sc.p(c)), minlength=len(ids))
            sums = {"s": score, "b": base}
            if training:  # all tokens are known
                for digits in _packed(of_count.reshape(-1, K)):
                    yield from _sum_rows(ids, bucket=bucket, k=digits, **sums)
                    sums = {}
            else:
                yield from _sum_rows(ids, bucket=bucket, known=known, **sums)

    # a bucket's rows follow each other, the model's first
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, ROW)


def backoff(model: DataFrame, unigrams: DataFrame, frequent: Frequent, scale: Scale) -> DataFrame:
    """h, value: log10 of a(h) c(h), for every history in training."""
    shared = model.sparkSession.sparkContext.broadcast((frequent, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, sc = shared.value
        for b in batches:
            for r in range(b.num_rows):
                w, h, n = (b.column(x)[r].values.to_numpy(zero_copy_only=False) for x in ("w", "h", "n"))
                w = w.view(U64)
                cold, where = np.unique(w, return_inverse=True)
                count, c = np.bincount(where, weights=n), hot.counts(w)
                c = np.where(c >= 0, c, count[where])
                u, back = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u), pa.array(np.bincount(back, weights=sc.p(c))), pa.array(np.bincount(back, weights=sc.kept(n)))], names=["h", "sp", "sd"]
                )

    spark, hot = model.sparkSession, frequent
    i, j = np.nonzero(hot.pairs)
    n = hot.pairs[i, j]
    near = pa.table({
        "h": pa.array(hot.words[i].view(np.int64)), "sp": pa.array(scale.p(hot.count[j])), "sd": pa.array(scale.kept(n)),
    })
    sums = model.select("w", "h", "n").mapInArrow(run, "h long, sp double, sd double").unionByName(spark.createDataFrame(near))
    counts = unigrams.select(F.col("w").alias("h"), F.col("n").cast("double").alias("c")).where(F.col("h") != int(END))
    first = spark.createDataFrame([(int(START), float(hot.count[hot.find(np.array([START]))[0]]))], "h long, c double")
    both = sums.groupBy("h").agg(F.sum("sp").alias("sp"), F.sum("sd").alias("sd")).join(counts.unionByName(first), "h")
    return both.select("h", F.log10((F.col("c") - F.col("sd")) / (1 - F.col("sp"))).alias("value"))


def score(docs: DataFrame, training: F.Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text), learnt from those in training."""
    conf, size = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(size)
    conf.set(size, str(BATCH))
    try:
        return _score(docs, training)
    finally:
        conf.set(size, before)


def _score(docs: DataFrame, training: F.Column) -> DataFrame:
    light = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"),
        F.coalesce(training, F.lit(False)).alias("training"),
    )
    known, other = light.where("training"), light.where("not training")
    unigrams = store.materialize(count_words(known.select("text", "size")), "lm-words")
    total = unigrams.agg(F.sum("n"), F.count("*"), F.max(F.when(F.col("w") == int(END), F.col("n")))).first()
    scale, n_docs = Scale(total[0] or 0, total[1]), total[2] or 0
    # at most KNOWN words reach a KNOWN-th of all tokens, and HOT a HOT-th
    found = {r["w"]: r["n"] for r in unigrams.where(F.col("n") * KNOWN >= scale.n).collect()} if scale.n else {}
    frequent = Frequent(found, n_docs, scale.n / HOT)
    frequent.pairs = count_frequent(known.select("text", "size"), frequent)
    buckets = max(1, -(-scale.n // BUCKET))
    dealt = deal(known.select("doc_id", "text", "size"), frequent, scale, buckets, True)
    learnt = store.materialize(tally(dealt, buckets, frequent, scale, True), "lm-model", compression="zstd")
    model = learnt.where(F.col("kind") == MODEL)
    of_count = {r["r"]: r["n"] for r in model.select(F.explode("n").alias("r")).where(F.col("r") <= K + 1).groupBy("r").agg(F.count("*").alias("n")).collect()}
    hot_n = frequent.pairs[frequent.pairs > 0]
    for r in range(1, K + 2):
        of_count[r] = of_count.get(r, 0) + int((hot_n == r).sum())
    scale.learn(of_count)
    weights = store.materialize(backoff(model, unigrams, frequent, scale), "lm-backoff")
    keys = {int(w): i for i, w in enumerate(frequent.words.view(np.int64))}
    for r in weights.where(F.col("h").isin(list(keys))).collect():
        frequent.backoff[keys[r["h"]]] = r["value"]
    asked = deal(other.select("doc_id", "text", "size"), frequent, scale, buckets, False).unionByName(model)
    judged = store.materialize(tally(asked, buckets, frequent, scale, False), "lm-held-out", compression="zstd")
    lost = judged.where(F.col("kind") == UNSEEN).select(F.inline(F.arrays_zip("h", "ids"))).groupBy("h", "ids").agg(F.count("*").alias("n"))
    backed = lost.join(weights, "h").groupBy(F.col("ids").alias("row")).agg(F.sum(F.col("n") * F.col("value")).alias("s"))
    logs = [float(np.log10(d)) for d in scale.discount[1:]]
    seen = _summed(learnt, logs)
    unseen = _summed(judged, None, backed)
    both = seen.withColumn("n_known", F.col("n_tokens")).unionByName(unseen)
    return both.select("doc_id", "n_tokens", "n_known", F.lit(scale.n).cast("long").alias("train_tokens"), "base_score", "score")


def _summed(rows: DataFrame, logs: list[float] | None, more: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score from DOCS and SUMS rows."""
    docs = rows.where(F.col("kind") == DOCS)
    row = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.col("base") + i)
    own = docs.select(F.inline(F.arrays_zip(row.alias("row"), F.col("ids").alias("doc_id"), "size", "s", "b", "known")))
    of_digits = np.array(logs if logs is not None else [0.0] * K)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of all parts of a span, which follow each other."""
        now, total = None, np.zeros((4, SPAN))

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(total[3])
            cols = [pa.array(now + at), pa.array(total[0][at]), pa.array(total[1][at]), pa.array(total[2][at].astype(np.int64))]
            return pa.RecordBatch.from_arrays(cols, names=["row", "s", "b", "known"])

        for b in batches:
            for i, base in enumerate(b.column("base").to_pylist()):
                if base != now:
                    if now is not None:
                        yield out()
                    now, total = base, np.zeros((4, SPAN))
                ids, s, b_, known, k = (x.values.to_numpy(zero_copy_only=False) if (x := b.column(c)[i]).is_valid else None for c in ("ids", "s", "b", "known", "k"))
                at = ids - base
                for to, x in enumerate((s, b_, known)):
                    if x is not None:
                        total[to][at] += x
                if k is not None:
                    total[0][at] += ((k[:, None] >> (BITS * np.arange(K))) & (DIGIT - 1)) @ of_digits
                total[3][at] = 1
        if now is not None:
            yield out()

    sums = rows.where(F.col("kind") == SUMS).select("base", "ids", "s", "b", "known", "k")
    rest = sums.repartition("base").sortWithinPartitions("base").mapInArrow(run, "row long, s double, b double, known long")
    flat = own.select("row", "s", "b", "known").unionByName(rest)
    if more is not None:
        flat = flat.unionByName(more.select("row", "s", F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("known")))
    total = flat.groupBy("row").agg(F.sum("s").alias("score"), F.sum("b").alias("base_score"), F.sum("known").alias("n_known"))
    return own.select("row", "doc_id", F.col("size").alias("n_tokens")).join(total, "row").drop("row")
