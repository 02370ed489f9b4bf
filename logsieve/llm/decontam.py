"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are compared in lower case and without ASCII punctuation. The n-grams of test items are counted in the
documents first; those that no document holds can't match and go. An n-gram that is much more frequent (RARER times)
than others of its item is common if the others cover each of its words at least twice; all others are rare, and
seeds as they are. A common one is a seed only together with another word of the item that stands within WIDE words
before or behind it, so that common prose meets no item by itself; a copy whose other n-grams are all edited away still
has such a pair. Items with fewer than n words are seeds as a whole.

Where seeds of an item occur in a document, the words around them, as many as the item has, are aligned with
the whole item, unless too few of its words are there for any alignment to reach the least score;
the score is the best local alignment's, as a share of a perfect copy's.

Tables of fixed size tell which n-grams of a document may be seeds, and how long the longest item of a seed is; an equality
join then finds the items exactly. Null and empty texts and items without a word have no
seeds. Repeated rows of documents or items give one result. Empty tables give an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm import words
from logsieve.llm.words import U64
from logsieve.sources import store

N = 3
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.5
#: How much more frequent a common n-gram is than the rare ones over it, and the words around one that are looked at.
RARER, WIDE = 16, 6
#: Slots of the tables; at most so many numbers are collected, however many items there are.
SLOTS = 1 << 22
L64 = pa.list_(pa.int64())


def item_grams(items: DataFrame, n: int = N) -> DataFrame:
    """item_id, words (hashes), grams (hashes, in order; the whole item if it is shorter) of items (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, at = words.hashes(b.column("text").to_pylist(), plain=True)
            each = [h[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]
            grams = [words.grams(w, min(n, max(1, len(w)))).view(np.int64) for w in each]
            yield pa.RecordBatch.from_arrays(
                [b.column("item_id"), pa.array([w.view(np.int64) for w in each], L64), pa.array(grams, L64)], names=["item_id", "words", "grams"]
            )

    found = items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, words array<long>, grams array<long>")
    return found.where(F.size("grams") > 0).dropDuplicates()


def slots(keys: DataFrame, size: str = "1") -> np.ndarray:
    """Table of the column key: by slot, the largest power of two that ``size`` needs, plus one (0: none)."""
    power = F.ceil(F.log2(F.expr(size).cast("double"))).cast("int")
    got = keys.select(F.pmod("key", F.lit(SLOTS)).alias("s"), power.alias("p")).groupBy("s").agg(F.max("p").alias("p")).toArrow()
    table = np.zeros(SLOTS, np.uint8)
    table[got["s"].to_numpy()] = got["p"].to_numpy() + 1
    return table


def _slot(keys: np.ndarray) -> np.ndarray:
    # pmod of the signed value, as Spark computes it: SLOTS divides 2**64
    return (keys & U64(SLOTS - 1)).astype(np.int64)


def _whole(h: np.ndarray, at: np.ndarray, n: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams that the table may hold: their hashes, their places and their texts' numbers."""
    grams = words.grams(h, n)
    place = np.flatnonzero(table[_slot(grams)])
    text = np.searchsorted(at, place, "right") - 1
    whole = place + n <= at[text + 1]
    return grams[place][whole], place[whole], text[whole]


def _pair(gram: np.ndarray, word: np.ndarray, before: bool) -> np.ndarray:
    """Seed of a common gram and another word before or behind it."""
    return words.mix(words.mix(gram ^ U64(0x57494445 + before)) + word)


def count_documents(docs: DataFrame, own: DataFrame, n: int) -> DataFrame:
    """gram, n_docs: how many documents hold each n-gram of the items."""
    table = slots(own.select(F.explode("grams").alias("key")))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.cut(batches):
            h, at = words.hashes(b.column("text").to_pylist(), plain=True)
            g, _, text = _whole(h, at, n, shared.value)
            order = np.lexsort((text, g))
            g, text = g[order], text[order]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (text[1:] != text[:-1])]) if len(g) else np.zeros(0, bool)
            u, count = np.unique(g[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(count)], names=["gram", "n_docs"])

    seen = docs.select("text").mapInArrow(run, "gram long, n_docs long").groupBy("gram").agg(F.sum("n_docs").alias("n_docs"))
    return seen.join(own.select(F.explode("grams").alias("gram")).distinct(), "gram", "left_semi")


def rare(n_docs: np.ndarray, n: int) -> np.ndarray:
    """Which n-grams of an item are seeds by themselves, by how many documents hold each."""
    held = n_docs > 0
    cover = np.zeros(len(n_docs) + n - 1, np.int64)
    for p in np.flatnonzero(held).tolist():
        cover[p : p + n] += 1
    out = held.copy()
    for p in sorted(np.flatnonzero(held).tolist(), key=lambda p: (-n_docs[p], p)):
        near = [q for q in range(max(0, p - n + 1), min(len(n_docs), p + n)) if q != p and out[q]]
        if (cover[p : p + n] >= 3).all() and near and n_docs[p] >= RARER * max(n_docs[q] for q in near):
            out[p] = False
            cover[p : p + n] -= 1
    return out


def seeds(own: DataFrame, counted: DataFrame, n: int) -> DataFrame:
    """item_id, size (words of the item), kind, gram (of a common gram: the gram itself), key (what is looked up)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, w, at, grams, found in zip(
                b.column("item_id").to_pylist(), b.column("words"), b.column("at").to_pylist(), b.column("gram").to_pylist(), b.column("n_docs").to_pylist(), strict=True
            ):
                w = w.values.to_numpy().view(U64)
                if len(w) < n:
                    rows += [(item, len(w), "short", None, g) for g in grams]
                    continue
                n_docs = np.zeros(len(w) - n + 1, np.int64)
                n_docs[at] = found
                by_place = dict(zip(at, grams, strict=True))
                own_ = rare(n_docs, n)
                for p in np.flatnonzero(n_docs > 0).tolist():
                    if own_[p]:
                        rows.append((item, len(w), "rare", None, by_place[p]))
                        continue
                    gram = np.array([by_place[p]], np.int64).view(U64)
                    for before, near in ((True, w[max(0, p - WIDE) : p]), (False, w[p + n : p + n + WIDE])):
                        rows += [(item, len(w), "wide", by_place[p], k) for k in _pair(np.repeat(gram, len(near)), near, before).view(np.int64).tolist()]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item_id", "size", "kind", "gram", "key"])

    long_ = own.where(F.size("words") >= n).select("item_id", "words", F.posexplode("grams").alias("at", "gram")).join(counted, "gram")
    short = own.where(F.size("words") < n).select("item_id", "words", F.posexplode("grams").alias("at", "gram")).withColumn("n_docs", F.lit(1).cast("long"))
    by_item = long_.unionByName(short).groupBy("item_id", "words").agg(F.sort_array(F.collect_list(F.struct("at", "gram", "n_docs"))).alias("g"))
    parts = by_item.select("item_id", "words", "g.at", "g.gram", "g.n_docs")
    return parts.mapInArrow(run, "item_id long, size long, kind string, gram long, key long").distinct()


def regions(docs: DataFrame, tables: dict[str, np.ndarray], n: int = N) -> DataFrame:
    """doc_id, text_hash, first (place of the first word), keys, words of the parts of docs around possible seeds."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def found(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Possible seeds, their first and last place, and how far their items reach."""
        t = shared.value
        out = []
        for size, name in [(n, "rare"), *((k, f"short{k}") for k in range(1, n))]:
            if name in t:
                g, place, text = _whole(h, at, size, t[name])
                out.append((g, place, text, t[name][_slot(g)]))
        if "wide" in t:
            g, place, text = _whole(h, at, n, t["common"])
            for before, steps in ((True, range(-WIDE, 0)), (False, range(n, n + WIDE))):
                for step in steps:
                    other = place + step
                    inside = (other >= at[text]) & (other < at[text + 1])
                    key = _pair(g[inside], h[other[inside]], before)
                    reach = t["wide"][_slot(key)]
                    out.append((key[reach > 0], place[inside][reach > 0], text[inside][reach > 0], reach[reach > 0]))
        if not out:
            return (np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.cut(batches):
            h, at = words.hashes(b.column("text").to_pylist(), plain=True)
            key, place, text, reach = found(h, at)
            reach = np.left_shift(1, np.maximum(reach.astype(np.int64) - 1, 0))
            start, end = np.maximum(place - reach, at[text]), np.minimum(place + n + reach, at[text + 1])
            order = np.argsort(start, kind="stable")
            key, text, start, end = key[order], text[order], start[order], end[order]
            new = np.flatnonzero(start[1:] >= np.maximum.accumulate(end)[:-1]) + 1 if len(key) else []
            cuts = [0, *list(new), len(key)] if len(key) else []
            rows = []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                t, last = int(text[a]), int(end[a:z].max())
                rows.append((t, int(start[a]) - int(at[t]), np.unique(key[a:z]).view(np.int64), h[int(start[a]) : last].view(np.int64)))
            own = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(own), b.column("text_hash").take(own), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], L64), pa.array([r[3] for r in rows], L64)],
                names=["doc_id", "text_hash", "first", "keys", "words"],
            )

    light = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return light.mapInArrow(run, "doc_id long, text_hash long, first long, keys array<long>, words array<long>")


def align(item: np.ndarray, words_: np.ndarray) -> tuple[int, int]:
    """Best local alignment's score, and the place after its last word in words_."""
    slope = -GAP * np.arange(len(words_) + 1)
    row, best, end = np.zeros(len(words_) + 1, np.int64), 0, 0
    for w in item:
        new = np.zeros_like(row)
        new[1:] = row[:-1] + np.where(words_ == w, MATCH, MISMATCH)
        np.maximum(new, row + GAP, out=new)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope) - slope
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST, n: int = N) -> DataFrame:
    """doc_id, text_hash, item_id, score, first_word, end_word of every document and item whose alignment scores at least ``least``."""
    light = docs.select("doc_id", "text")
    own = store.materialize(item_grams(items, n), "items")
    found = store.materialize(seeds(own, count_documents(light, own, n), n), "seeds")
    tables = {"rare": slots(found.where("kind = 'rare'"), "size"), **{
        f"short{k}": slots(found.where((F.col("kind") == "short") & (F.col("size") == k)), "size") for k in range(1, n)
    }}
    tables["wide"], tables["common"] = slots(found.where("kind = 'wide'"), "size"), slots(found.where("kind = 'wide'").select(F.col("gram").alias("key")))
    tables = {k: t for k, t in tables.items() if t.any() or k == "rare"}
    near = store.materialize(regions(light, tables, n).withColumn("region", F.xxhash64("doc_id", "text_hash", "first")), "regions")
    hits = near.select("region", F.explode("keys").alias("key")).join(found.select("key", "item_id").distinct(), "key").select("region", "item_id").distinct()
    pairs = hits.join(near.drop("keys"), "region").join(own.select("item_id", F.col("words").alias("item")), "item_id")

    # words that are missing match nowhere, so pairs that go here can't reach the least score
    pairs = pairs.where(F.size("item") - F.size(F.array_except("item", "words")) >= F.lit(least) * F.size("item"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, th, first, item_id, w, item in zip(
                *(b.column(k).to_pylist() for k in ("doc_id", "text_hash", "first", "item_id")), b.column("words"), b.column("item"), strict=True
            ):
                w, item = w.values.to_numpy(), item.values.to_numpy()
                score, end = align(item, w)
                if score >= least * MATCH * len(item):
                    back = align(item[::-1], w[:end][::-1])[1]
                    out.append((doc, th, item_id, score / (MATCH * len(item)), first + end - back, first + end))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "text_hash", "item_id", "score", "first_word", "end_word"]
            )

    # regions are dealt out anew, so that a document or item with many of them is no single task's work
    dealt = pairs.select("doc_id", "text_hash", "first", "item_id", "words", "item").repartition("doc_id", "item_id", "first")
    found = dealt.mapInArrow(run, "doc_id long, text_hash long, item_id long, score double, first_word long, end_word long")
    best = F.max(F.struct("score", F.negative("first_word").alias("f"), "end_word")).alias("best")
    return found.groupBy("doc_id", "text_hash", "item_id").agg(best).select(
        "doc_id", "text_hash", "item_id", F.col("best.score").alias("score"), F.negative("best.f").alias("first_word"), F.col("best.end_word").alias("end_word")
    )


def keep_clean(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs in which no item is found."""
    bad = contaminated(docs, items, least).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    bad = store.materialize(bad, "contaminated")
    hit = docs["doc_id"].cast("long").eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_hash"])
    return docs.join(bad.hint("merge"), hit, "left_anti")
