"""Token counts of whole texts without tokenizing them whole.

A byte-level tokenizer cuts a text into pre-tokens and merges bytes within each; no piece crosses a
border between two. So a text's tokens are the sum over its pre-tokens of how many pieces each has:

1. All texts are cut once. A block of neighbouring documents writes each of its different pre-tokens once, with the
   documents that have it and how often. These frequencies are kept; the texts are not read again.
2. The library counts the pieces of each distinct pre-token of the corpus once. No ids are kept.
3. The frequencies are joined with these counts and summed by document. At most FREQUENT pre-tokens make up a
   FREQUENT-th of all occurrences or more; those of at most LONGEST bytes form a table of bounded size that goes to
   every task. All others meet the counts in a sorted equality join on the pre-token's 64-bit hash, or on its text if two
   share a hash; there no key can be hot unless it is longer than LONGEST bytes (then Spark splits the join's side).

Special tokens of the tokenizer that stand in a text count as one token each and separate what is around
them, as is the library's default. Texts with characters that the regular expressions here don't know
are cut by the library itself, so both follow the same version of Unicode.

Null and empty texts have 0 bytes and 0 tokens. Every row gives one row, repeated and null ids too;
other columns are left out. An empty table gives an empty result.
"""

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.sources import store

#: Bounds of the table that goes to every task: its entries, and bytes of each.
FREQUENT, LONGEST = 1 << 16, 256
#: Entries (of a pre-token in a document) and documents of a block. Entries are written as place << 16 | frequency,
#: so a block has at most 65536 documents; a larger frequency takes several entries.
HELD, DOCS = 2_000_000, 1 << 16
MOST = (1 << 16) - 1
#: Fixed values of byte-level pre-tokenization.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT, _UNKNOWN = regex.compile(PATTERN), regex.compile(r"\p{Cn}")
I64 = pa.int64()
FIELDS = pa.schema([
    ("pretoken", pa.string()), ("base", I64), ("n", I64), ("entries", pa.binary()),
    ("doc_id", pa.list_(I64)), ("n_bytes", pa.list_(I64)), ("n_tokens", pa.list_(I64)),
])
ROW = "pretoken string, base long, n long, entries binary, doc_id array<long>, n_bytes array<long>, n_tokens array<long>"


class Cutter:
    """Pre-tokens of texts, and pieces of pre-tokens, as the tokenizer of a definition (JSON text) has them."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.unmarked = Tokenizer.from_str(definition)
        self.unmarked.encode_special_tokens = True
        added = self.tokenizer.get_added_tokens_decoder().values()
        if self.tokenizer.normalizer or any(t.single_word or t.lstrip or t.rstrip or not t.special for t in added):
            raise ValueError("only tokenizers without a normalizer and with plain special tokens can be counted by pre-tokens")
        # the text is put together again from byte symbols: every byte must have one, and the cut must be the known one
        probe = "It's 12 o'clock,\n\n  and  été\t中文 x "
        if self._by_library(probe) != _CUT.findall(probe):
            raise ValueError("only byte-level tokenizers with the usual pattern can be counted by pre-tokens")
        marks = sorted((t.content for t in added), key=len, reverse=True)
        self.mark = regex.compile("|".join(map(regex.escape, marks))) if marks else None

    def _by_library(self, text: str) -> list[str]:
        return [text[a:z] for _, (a, z) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def cut(self, text: str) -> tuple[Counter, int]:
        """How often each pre-token occurs, and the number of special tokens."""
        parts = self.mark.split(text) if self.mark else [text]
        found: Counter = Counter()
        for part in parts:
            found.update(self._by_library(part) if _UNKNOWN.search(part) else _CUT.findall(part))
        return found, len(parts) - 1

    def pieces(self, pretokens: list[str]) -> list[int]:
        return [len(e) for e in self.unmarked.encode_batch(pretokens, add_special_tokens=False)]


@lru_cache(maxsize=2)
def _cutter(name: str) -> Cutter:
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return Cutter(f.read())


def _text(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def count_pieces(pretokens: DataFrame, name: str) -> DataFrame:
    """pretokens (pretoken, n) with pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("pieces", pa.array(_cutter(name).pieces(b.column("pretoken").to_pylist()), I64))

    return pretokens.mapInArrow(run, "pretoken string, n long, pieces long")


class Block:
    """Pre-token frequencies of some neighbouring documents."""

    def __init__(self, base: int):
        self.base, self.index, self.docs = base, {}, []
        self.ids, self.n, self.each = array("i"), array("q"), array("i")

    def add(self, doc: int | None, size: int, found: Counter, special: int) -> None:
        index = self.index
        self.ids.extend([index.setdefault(k, len(index)) for k in found])
        self.n.extend(found.values())
        self.each.append(len(found))
        self.docs.append((doc, size, special))

    def rows(self) -> Iterator[pa.RecordBatch]:
        ids, size, special = zip(*self.docs, strict=True)
        yield pa.RecordBatch.from_pylist([{"base": self.base, "doc_id": ids, "n_bytes": size, "n_tokens": special}], schema=FIELDS)
        at = np.repeat(np.arange(len(self.docs)), np.frombuffer(self.each, np.int32)) if self.docs else np.zeros(0, np.int64)
        k, n = np.frombuffer(self.ids, np.int32), np.frombuffer(self.n, np.int64)
        total = np.bincount(k, weights=n, minlength=len(self.index)).astype(np.int64)
        times = (n + MOST - 1) // MOST
        if (times > 1).any():
            last = np.cumsum(times) - 1
            k, at, rest = np.repeat(k, times), np.repeat(at, times), n - (times - 1) * MOST
            n = np.full(len(k), MOST)
            n[last] = rest
        order = np.argsort(k, kind="stable")
        entries = ((at[order] << 16) | n[order]).astype("<u4")
        ends = np.concatenate([[0], np.cumsum(np.bincount(k, minlength=len(self.index)))])
        keys = list(self.index)
        for a in range(0, len(keys), 50_000):
            z = min(len(keys), a + 50_000)
            own = entries[ends[a] : ends[z]].tobytes()
            places = ((ends[a : z + 1] - ends[a]) * 4).astype(np.int32)
            binary = pa.BinaryArray.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(places.tobytes()), pa.py_buffer(own)])
            none = [pa.nulls(z - a, t) for t in FIELDS.types[4:]]
            yield pa.RecordBatch.from_arrays([pa.array(keys[a:z], pa.string()), pa.array([self.base] * (z - a), I64), pa.array(total[a:z]), binary, *none], schema=FIELDS)


def frequencies(docs: DataFrame, name: str) -> DataFrame:
    """For each block of docs (doc_id, text as binary, row): a row of its documents with the tokens of special strings,
    and a row for each pre-token with how often it occurs and the documents that have it."""
    held, most = HELD, DOCS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, block = _cutter(name), None
        for b in batches:
            for row, doc, value in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                if block is None:
                    block = Block(row)
                raw = value.as_py()
                block.add(doc, len(raw or b""), *cutter.cut(_text(raw)))
                if len(block.ids) > held or len(block.docs) >= most:
                    yield from block.rows()
                    block = None
        if block:
            yield from block.rows()

    return docs.mapInArrow(run, ROW)


PARTIAL = "base long, at array<int>, tokens array<long>"


def sums(joined: DataFrame) -> DataFrame:
    """base, at, tokens of joined (base, entries, pieces), blocks one after the other: pieces times frequency by document, a row for each block that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(1 << 16, np.int64)

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays(
                [pa.array([now], I64), pa.array([at], pa.list_(pa.int32())), pa.array([total[at]], pa.list_(I64))], names=["base", "at", "tokens"]
            )

        for b in batches:
            base, pieces = b.column("base").to_numpy(), b.column("pieces").to_numpy()
            cuts = [*np.flatnonzero(np.diff(base, prepend=-1)).tolist(), len(base)]
            for at, last in zip(cuts[:-1], cuts[1:], strict=True):
                if base[at] != now:
                    if now is not None:
                        yield out()
                    now, total = int(base[at]), np.zeros(1 << 16, np.int64)
                own = b.column("entries").slice(at, last - at)
                entries = np.frombuffer(b"".join(own.to_pylist()), "<u4").astype(np.int64)
                each = pa.compute.binary_length(own).to_numpy() // 4
                total += np.bincount(entries >> 16, weights=(entries & MOST) * np.repeat(pieces[at:last], each), minlength=1 << 16).astype(np.int64)
        if now is not None:
            yield out()

    return joined.mapInArrow(run, PARTIAL)


def add_up(partial: DataFrame) -> DataFrame:
    """row, tokens: the partial sums of each block, which one task adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(1 << 16, np.int64)

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(now + at), pa.array(total[at])], names=["row", "tokens"])

        for b in batches:
            for base, at, tokens in zip(b.column("base").to_pylist(), b.column("at"), b.column("tokens"), strict=True):
                if base != now:
                    if now is not None:
                        yield out()
                    now, total = base, np.zeros(1 << 16, np.int64)
                total[at.values.to_numpy()] += tokens.values.to_numpy()
        if now is not None:
            yield out()

    return partial.repartition("base").sortWithinPartitions("base").mapInArrow(run, "row long, tokens long")


def key_of(pretoken: Column) -> Column:
    return F.xxhash64(pretoken)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text).

    ``tokenizer``: path of a ``tokenizers`` definition on the driver; Spark hands the file to the executors.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(tokenizer)
    name = tokenizer.rsplit("/", 1)[-1]
    light = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    parts = store.materialize(frequencies(light.withColumn("row", F.monotonically_increasing_id()), name), "pretoken-frequencies", compression="zstd")
    found = parts.where("pretoken is not null").select("pretoken", "base", "n", "entries")
    known = count_pieces(found.groupBy("pretoken").agg(F.sum("n").alias("n")), name)
    known = store.materialize(known, "pretokens", compression="zstd").withColumn("key", key_of(F.col("pretoken")))
    total = known.agg(F.sum("n")).first()[0] or 0
    often = (F.col("n") * FREQUENT >= total) & (F.octet_length("pretoken") <= LONGEST)
    # at most FREQUENT entries of at most LONGEST bytes
    frequent = F.broadcast(known.where(often).select("pretoken", "pieces"))
    near = found.join(frequent, "pretoken").select("base", "entries", "pieces")
    rest = found.join(frequent, "pretoken", "left_anti").select("pretoken", key_of(F.col("pretoken")).alias("key"), "base", "entries")
    counts = known.where(~often)
    shared = store.materialize(known.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-keys")
    clash = not shared.isEmpty()
    one, many = counts, None
    if clash:  # different pre-tokens with one key: those meet their counts by their text
        one, many = counts.join(shared, "key", "left_anti"), counts.join(shared, "key", "left_semi")
    # by one strategy at every size, so that small inputs show what large ones need
    by_key = rest.select("key", "base", "entries").join(one.select("key", "pieces").hint("merge"), "key")
    tokens = sums(near).unionByName(sums(by_key.select("base", "entries", "pieces").sortWithinPartitions("base")))
    if clash:
        by_text = rest.join(many.select("pretoken", "pieces").hint("merge"), "pretoken")
        tokens = tokens.unionByName(sums(by_text.select("base", "entries", "pieces").sortWithinPartitions("base")))
    tokens = add_up(tokens)
    of_docs = parts.where("pretoken is null").select("base", F.posexplode(F.arrays_zip("doc_id", "n_bytes", "n_tokens")).alias("at", "d"))
    own = of_docs.select((F.col("base") + F.col("at")).alias("row"), "d.*")
    n = F.col("n_tokens") + F.coalesce("tokens", F.lit(0))
    return own.join(tokens.hint("merge"), "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
