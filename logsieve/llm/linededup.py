"""Line dedup: content-defined chunks of lines, and what is left of repeated runs around them.

A rolling hash over the hashes of the last ROLL lines ends a chunk after about every EVERY lines. Boundaries depend on
the lines alone, so lines put in before a repeated passage shift nothing. Chunks of two or more lines with a word
(or of one line of LONG or more words), without the blank lines at their edges but one, are compared over all
documents: by hash, then by their bytes. All but the first occurrence (least doc_id, null first, then text hash, then place) go.

A repeated run of lines seldom begins and ends with a chunk, so matches are then extended line by line. A run's smallest
parts that are runs themselves (pairs of lines with a word, and what lies between them; long lines) repeat with it
and cover it. Parts inside a chunk that goes are gone with it; all others, those of the chunk that stays among them,
are compared in the same way. So of any run of two or more lines with a word among its first and last two, or of one
line of LONG or more words, that occurs more than once, exactly the first occurrence stays, and a run that overlaps
its own copy keeps its start.

Lines end with a newline; of the blank lines at the edge of a run at most one goes with it. Null texts stay
null, empty ones empty, and a text of which all lines go becomes empty. Rows that repeat doc_id and text
count as one document and are treated alike. Columns of docs named as the added ones, or ``places``, are left out. An empty table gives an empty result.
"""

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from logsieve.llm import columns
from logsieve.llm.words import U64, mix
from logsieve.sources import store

LONG = 50
#: Lines that the rolling hash covers, and lines of a chunk on average.
ROLL, EVERY = 2, 4
CHUNK, PART = 0, 1
Run = tuple[str, int, int]


def chunks(text: str) -> list[tuple[str, int, int]]:
    """The text's lines in order, as what is removed or left: text without the newline, 1, number of words."""
    return [(x, 1, len(x.split())) for x in text.split("\n")]


def eligible(lines: int, words: int) -> bool:
    """Whether lines can make up a repeated run, as parts of one if they are single and short."""
    return lines > 0 and words > 0


def boundaries(lines: list[str]) -> list[int]:
    """Where chunks end, by a rolling hash over the lines' hashes."""
    h = np.array([xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines], U64)
    rolled = mix(h)
    for k in range(1, ROLL):
        rolled[k:] += mix(h[:-k] + U64(k))
    ends = (np.flatnonzero(mix(rolled) % U64(EVERY) == 0) + 1).tolist()
    return ends if ends and ends[-1] == len(lines) else [*ends, len(lines)]


def sections(text: str) -> list[Run]:
    """The chunks that may be removed as a whole: their text, first line and the line after the last."""
    lines = text.split("\n")
    full = [bool(x.split()) for x in lines]
    out, first = [], 0
    for end in boundaries(lines):
        a, z = first, end
        while z - a > 1 and not (full[a] or full[a + 1]):
            a += 1
        while z - a > 1 and not (full[z - 1] or full[z - 2]):
            z -= 1
        if any(full[a:z]) and (z - a > 1 or len(lines[a].split()) >= LONG):
            out.append(("\n".join(lines[a:z]), a, z))
        first = end
    return out


def parts(text: str) -> list[tuple[str, int, int]]:
    """The smallest runs of the text: their text, first line and the line after the last."""
    own = chunks(text)
    out, last = [], None
    for i, (_, _, n) in enumerate(own):
        if not n:
            continue
        if n >= LONG:
            out.append((i, i + 1))
        if last is not None:
            out.append((last, i + 1))
            if last + 1 < i:
                out += [(last, last + 2), (i - 1, i + 1)]
        elif i:
            out.append((i - 1, i + 1))
        last = i
    if last is not None and last + 1 < len(own):
        out.append((last, last + 2))
    return [("\n".join(x for x, _, _ in own[a:z]), a, z) for a, z in out]


def _hash(chunk: str) -> int:
    return int(np.array([xxh64_intdigest(chunk.encode("utf-8", "surrogatepass"), 1)], U64).view(np.int64)[0])


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def units(text: str, kind: int) -> list[Run]:
    return sections(text) if kind == CHUNK else parts(text)


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, kind, place, inside, hash of all chunks and parts of docs (doc_id, text_hash, text).

    inside: the chunk that a part lies in, else -1.
    """
    fields = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("kind", pa.int32()), ("place", pa.int32()), ("inside", pa.int32()), ("hash", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, th, text in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text_hash", "text")), strict=True):
                whole = sections(text or "")
                rows += [(doc, th, CHUNK, i, -1, _hash(c)) for i, (c, _, _) in enumerate(whole)]
                ends = [z for _, _, z in whole]
                for i, (c, a, z) in enumerate(parts(text or "")):
                    k = bisect_right(ends, a)
                    rows.append((doc, th, PART, i, k if k < len(whole) and whole[k][1] <= a and z <= ends[k] else -1, _hash(c)))
            yield _batch(rows, fields)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, kind int, place int, inside int, hash long")


def _texts(docs: DataFrame, kind: int) -> DataFrame:
    """hash, chunk, doc_id, text_hash, place of the chunks or parts at docs' places."""
    fields = [("hash", pa.int64()), ("chunk", pa.string()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("place", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, th, text, places in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text_hash", "text", "places")), strict=True):
                own = units(text or "", kind)
                rows += [(_hash(own[i][0]), own[i][0], doc, th, i) for i in places]
            yield _batch(rows, fields)

    return docs.select("doc_id", "text_hash", "text", "places").mapInArrow(run, "hash long, chunk string, doc_id long, text_hash long, place int")


def _without(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, rest) without the lines of the chunks and parts at their places (null: none), and n_lines, removed_lines, removed_chunks (stretches of lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, places in zip(*(b.column(k).to_pylist() for k in ("text", "places")), strict=True):
                if not places:
                    rows.append((text, text.count("\n") + 1 if text else 0, 0, 0))
                    continue
                own = text.split("\n")
                at = [units(text, kind) if any(p["kind"] == kind for p in places) else [] for kind in (CHUNK, PART)]
                gone = {k for p in places for k in range(*at[p["kind"]][p["place"]][1:])}
                left = "\n".join(c for k, c in enumerate(own) if k not in gone)
                rows.append((left, len(own), len(gone), sum(k - 1 not in gone for k in gone)))
            new = _batch(rows, [("text", pa.string()), ("n_lines", pa.int64()), ("removed_lines", pa.int64()), ("removed_chunks", pa.int64())])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rest"), *new.columns], names=["doc_id", "rest", *new.schema.names])

    rest = docs.schema["rest"].dataType.simpleString()
    return docs.select("doc_id", "rest", "text", "places").mapInArrow(run, f"doc_id long, rest {rest}, text string, n_lines long, removed_lines long, removed_chunks long")


def repeats(docs: DataFrame, seen: DataFrame, kind: int) -> DataFrame:
    """doc_id, text_hash, place of what to remove among the occurrences seen of a kind in docs (doc_id, text_hash, text)."""
    at = F.struct("doc_id", "text_hash", "place")
    twice = seen.withColumn("at", F.xxhash64("doc_id", "text_hash", "place")).groupBy("hash").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    twice = twice.where("a != b").select("hash")
    maybe = store.materialize(seen.select("doc_id", "text_hash", "place", "hash").join(twice, "hash"), "repeated-chunks")
    wanted = maybe.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places"))
    texts = _texts(_joined(docs, store.materialize(wanted, "wanted-chunks"), "inner"), kind)
    variants = texts.groupBy("hash", "chunk").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    variants = store.materialize(variants, "chunk-texts")
    of_hash = variants.groupBy("hash").agg(F.count("*").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    of_hash = store.materialize(of_hash, "chunk-hashes")
    repeated = ~F.col("first").eqNullSafe(F.col("last")) & ~F.col("first").eqNullSafe(at)
    gone = maybe.join(of_hash.where("n = 1"), "hash").where(repeated).select("doc_id", "text_hash", "place")
    clash = of_hash.where("n > 1").select("hash")
    if not clash.isEmpty():  # different bytes with one hash: those chunks are told apart by their text
        own = texts.join(clash, "hash").join(variants, ["hash", "chunk"]).where(repeated)
        gone = gone.unionByName(own.select("doc_id", "text_hash", "place").distinct())
    gone = store.materialize(gone, "removed-chunks")
    store.release(maybe, variants, of_hash)
    return gone


def _joined(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """docs (doc_id, text_hash, text, ...) with places."""
    other = places.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "places")
    # by one strategy at every size, so that small inputs show what large ones need
    return docs.join(other.hint("merge"), docs["doc_id"].eqNullSafe(other["_d"]) & (docs["text_hash"] == other["_h"]), how).drop("_d", "_h")


def dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with the repeated runs of lines taken out of text, and n_lines, removed_lines, removed_chunks."""
    docs = docs.drop("n_lines", "removed_lines", "removed_chunks", "places")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"), columns.pack(docs, "doc_id", "text"))
    light = keyed.select("doc_id", "text_hash", "text")
    seen = store.materialize(occurrences(light), "chunk-places")
    whole = repeats(light, seen.where(F.col("kind") == CHUNK), CHUNK)
    inside = whole.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("place").alias("_p")).distinct()
    within = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")) & (F.col("inside") == F.col("_p"))
    single = repeats(light, seen.where(F.col("kind") == PART).join(inside.hint("merge"), within, "left_anti"), PART)
    gone = whole.withColumn("kind", F.lit(CHUNK)).unionByName(single.withColumn("kind", F.lit(PART)))
    places = gone.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("kind", "place")).alias("places"))
    out = _without(_joined(keyed, store.materialize(places, "removed-places"), "left"))
    return out.select(*columns.unpack(docs.columns, "doc_id", "text"), "n_lines", "removed_lines", "removed_chunks")
