"""Near-duplicates by a chosen-path set similarity join on word shingles.

1. Every text becomes the set of its distinct n-word shingles and a signature of minwise tokens.
   Texts with equal sets form one class; all later steps see classes.
2. Independent trees: the root sends every class to the child of one chosen minwise token. A
   child that holds more than LEAF classes is branched again, each class going to the children of
   BRANCH chosen tokens. Small nodes are compared exhaustively by signature, with a margin below
   the threshold; nodes still large at the last level count as one clump. A pair at the threshold j
   meets in one tree with a probability of j at the root, times 1 - (1 - j) ** BRANCH for each further level, so
   TREES trees miss (1 - j) ** TREES of them where nodes are small: 2.6 in a million at 80 %, 0.3 at 85 %;
   where three more levels branch, 53 and 3 in a million.
3. What these comparisons connect is a clump, a superset of the final components. The full sets
   of each clump go to tasks in chunks of bounded size and are compared exactly, through an
   inverted index, from one member to the next until nothing new is linked. Clumps of several
   chunks: the chunks' heads are compared in turn, and every document outside the largest part
   is compared with all documents of its clump, in blocks.
4. Components of the confirmed links; the least doc_id names each.

Texts without words (null, empty, blank) have an empty set and are linked with nothing. Texts with
fewer words than n are one shingle. Rows without doc_id can't name a component and stand alone.
Repeated rows have equal sets, so they share a component. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm import columns, words
from logsieve.llm.components import components
from logsieve.llm.words import U64
from logsieve.sources import store

TOKENS, TREES, BRANCH, LEAF, DEPTH = 64, 8, 2, 1000, 4
#: Shingles in one chunk of a clump (a single larger document is a chunk of its own).
CHUNK = 1_000_000
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, TOKENS, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_B = _rng.integers(0, 1 << 63, TOKENS, dtype=np.int64).astype(U64)


def _sets(texts: list, n: int) -> list[np.ndarray]:
    h, at = words.hashes(texts)
    return [words.shingle_set(h[a:b], n) for a, b in zip(at[:-1], at[1:], strict=True)]


def _class_id(s: np.ndarray) -> int:
    """A 64-bit hash of the whole set."""
    with np.errstate(over="ignore"):
        return int(words.mix(np.array([words.mix(s).sum() + U64(len(s))], U64)).view(np.int64)[0])


def sign(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, class, tokens (packed 32-bit minwise tokens) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.cut(batches):
            sets = _sets(b.column("text").to_pylist(), n)
            size = np.array([len(s) for s in sets], np.int64)
            flat, full = np.concatenate([*sets, np.zeros(0, U64)]), np.flatnonzero(size)
            tokens = np.zeros((len(full), TOKENS), np.uint32)
            if len(full):
                starts = (np.cumsum(size) - size)[full]
                for k in range(TOKENS):
                    tokens[:, k] = np.minimum.reduceat((flat * _A[k] + _B[k]) >> U64(32), starts)
            packed: list[bytes | None] = [None] * len(sets)
            for i, row in zip(full.tolist(), tokens, strict=True):
                packed[i] = row.tobytes()
            ids = [_class_id(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(size), pa.array(ids, pa.int64()), pa.array(packed, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "class", "tokens"],
            )

    light = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return light.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, class long, tokens binary")


def _token(coordinate) -> F.Column:
    """The four bytes of the token at a coordinate."""
    return F.substring(F.col("tokens"), coordinate * 4 + 1, F.lit(4))


def branch(rows: DataFrame, seed: int, ways: int) -> DataFrame:
    """node, class of the children that rows (node, class, tokens) go to, by ``ways`` different tokens for each node."""
    first = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(TOKENS)).cast("int")
    stride = F.pmod(F.xxhash64("node", F.lit(seed + 1)), F.lit(TOKENS // 2)).cast("int") * 2 + 1
    children = [F.xxhash64("node", F.lit(w), _token((first + stride * w) % TOKENS)) for w in range(ways)]
    return rows.select(F.explode(F.array(*children)).alias("node"), "class")


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys, over the borders of batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in key]
        new = np.zeros(b.num_rows, bool)
        for col in cols:
            new[1:] |= col[1:] != col[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            k = tuple(int(col[a]) for col in cols)
            if k != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = k
            held.append(b.slice(a, z - a))
    if held:
        yield now, pa.Table.from_batches(held)


def compare_leaves(leaves: DataFrame, least: float) -> DataFrame:
    """Links a, b that connect the classes of each leaf whose signatures agree in a share of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, t in _groups(batches, ["node"]):
            ids = t.column("class").to_numpy()
            if len(ids) > 1:
                tokens = np.frombuffer(b"".join(t.column("tokens").to_pylist()), np.uint32).reshape(len(ids), TOKENS)
                rest = np.arange(1, len(ids))
                queue = [0]
                while len(rest):
                    at = queue.pop() if queue else rest[0]
                    near = (tokens[rest] == tokens[at]).mean(1) >= least
                    for x in rest[near].tolist():
                        if x != at:
                            a.append(int(ids[at]))
                            b.append(int(ids[x]))
                    queue += [x for x in rest[near].tolist() if x != at]
                    rest = rest[~near]
            if len(a) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return leaves.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def clumps(classes: DataFrame, threshold: float, trees: int = TREES) -> DataFrame:
    """class, clump for all classes that the trees connect to another; classes: class, tokens."""
    margin = 4.5 * (threshold * (1 - threshold) / TOKENS) ** 0.5
    roots = classes.select(F.explode(F.array(*[F.lit(-t - 1).cast("long") for t in range(trees)])).alias("node"), "class", "tokens")
    links, level = [], 0
    frontier = branch(roots, 1, 1)
    while True:
        rows = store.materialize(frontier, "nodes")
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("class").alias("head")).where("n > 1")
        sizes = store.materialize(sizes, "node-sizes")
        level += 1
        last = level == DEPTH
        small = rows.join(sizes.where(F.col("n") <= LEAF).select("node"), "node").join(classes, "class")
        links.append(store.materialize(compare_leaves(small, threshold - margin), "leaf-links"))
        large = sizes.where(F.col("n") > LEAF)
        if large.isEmpty():
            break
        if last:
            links.append(rows.join(large, "node").select(F.col("class").alias("a"), F.col("head").alias("b")))
            break
        frontier = branch(rows.join(large.select("node"), "node").join(classes, "class"), 2 * level + 1, BRANCH)
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    roots = components(found)
    heads = roots.select(F.col("root").alias("class"), F.col("root").alias("clump")).distinct()
    return roots.select(F.col("node").alias("class"), F.col("root").alias("clump")).unionByName(heads)


def _linked(sets: list[np.ndarray], percent: int, ask: np.ndarray | None = None, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets with 100 * intersection >= percent * union.

    ask, part: only links between sets of different parts of which one is asked for.
    """
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(len(sets)), size)[order]
    sorted_ = flat[order]
    begin = np.searchsorted(sorted_, sorted_, "left")
    # for each set, where each of its shingles' owners stand
    first = np.empty(len(flat), np.int64)
    first[order] = begin
    ends = np.searchsorted(sorted_, sorted_, "right")
    last = np.empty(len(flat), np.int64)
    last[order] = ends
    offset = np.concatenate([[0], np.cumsum(size)])
    open_ = np.ones(len(sets), bool)
    out: list[tuple[int, int]] = []

    def near(i: int) -> np.ndarray:
        f, z = first[offset[i] : offset[i + 1]], last[offset[i] : offset[i + 1]]
        n = z - f
        at = np.repeat(f - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        return 100 * common >= percent * (size[i] + size - common)

    if ask is not None:
        for i in np.flatnonzero(ask).tolist():
            hit = near(i) & (part != part[i])
            out += [(i, int(np.flatnonzero(hit & (part == p))[0])) for p in np.unique(part[hit])]
        return out
    queue: list[int] = []
    while open_.any():
        i = queue.pop() if queue else int(np.argmax(open_))
        open_[i] = False
        if not open_.any():
            break
        new = np.flatnonzero(near(i) & open_).tolist()
        open_[new] = False
        out += [(i, j) for j in new]
        queue += new
    return out


def _compare(rows: DataFrame, key: list[str], n: int, percent: int, asked: bool = False) -> DataFrame:
    """Confirmed links a, b within each group of rows (key, class, text); asked: rows have ask and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _groups(batches, key):
            sets, ids = _sets(t.column("text").to_pylist(), n), t.column("class").to_numpy()
            if asked:
                ask, part = t.column("ask").to_numpy(zero_copy_only=False), t.column("part").to_numpy()
                found = _linked(sets, percent, ask.astype(bool), part)
            else:
                found = _linked(sets, percent)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(ids[i]) for i, _ in found], pa.int64()), pa.array([int(ids[j]) for _, j in found], pa.int64())], names=["a", "b"]
            )

    return rows.repartition(*key).sortWithinPartitions(*key, "class").mapInArrow(run, "a long, b long")


def _chunked(rows: DataFrame, name: str, by: list[str]) -> DataFrame:
    """Adds the chunk (by class hash) of rows (by, class, size); chunks hold about CHUNK shingles."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.sum("size") / CHUNK).alias("_c"))
    return rows.join(sizes, by).withColumn(name, F.pmod(F.xxhash64("class"), F.col("_c")).cast("long")).withColumnRenamed("_c", f"{name}s")


def confirm(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Confirmed links a, b between classes; members: class, clump, doc_id, text_hash, size of one document of each class."""
    parted = store.materialize(_chunked(members, "chunk", ["clump"]), "chunks")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def with_text(rows: DataFrame) -> DataFrame:
        own = [c for c in rows.columns if c != "size"]
        # by one strategy at every size, so that small inputs show what large ones need
        return rows.select(own).join(texts.hint("merge"), ["doc_id", "text_hash"]).dropDuplicates(own)

    links = [store.materialize(_compare(with_text(parted), ["clump", "chunk"], n, percent), "confirmed")]
    wide = store.materialize(parted.where("chunks > 1").drop("chunk", "chunks"), "wide-clumps")
    if wide.isEmpty():
        return links[0]

    def parts() -> DataFrame:
        found = links[0]
        for more in links[1:]:
            found = found.unionByName(more)
        roots = components(found).withColumnRenamed("node", "class")
        return store.materialize(wide.join(roots, "class", "left").withColumn("part", F.coalesce("root", "class")).drop("root"), "parts")

    now, before = parts(), None
    while True:  # the heads of the parts, chunk by chunk, until that joins nothing more
        heads = now.where(F.col("class") == F.col("part"))
        n_heads = heads.count()
        if n_heads == before or n_heads == heads.select("clump").distinct().count():
            break
        before = n_heads
        round_ = _chunked(heads.drop("part"), "chunk", ["clump"])
        links.append(store.materialize(_compare(with_text(round_), ["clump", "chunk"], n, percent), "confirmed"))
        now = parts()
    sizes = now.groupBy("clump", "part").agg(F.sum("size").alias("_s"))
    largest = sizes.groupBy("clump").agg(F.max_by("part", F.struct("_s", "part")).alias("main"), F.count("*").alias("_n"))
    open_ = store.materialize(now.join(largest.where("_n > 1").drop("_n"), "clump"), "open-clumps")
    asking = open_.where(F.col("part") != F.col("main"))
    if asking.isEmpty():
        return _union(links)
    blocks = _chunked(asking.drop("main"), "block", ["clump"])
    chunks = _chunked(open_.drop("main"), "chunk", ["clump"])
    n_blocks, n_chunks = blocks.select("clump", "blocks").distinct(), chunks.select("clump", "chunks").distinct()
    ask = blocks.join(n_chunks, "clump").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    told = chunks.join(n_blocks, "clump").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cols = ["clump", "chunk", "block", "class", "doc_id", "text_hash", "part"]
    both = ask.select(*cols, F.lit(True).alias("ask")).unionByName(told.select(*cols, F.lit(False).alias("ask")))
    links.append(store.materialize(_compare(with_text(both), ["clump", "chunk", "block"], n, percent, asked=True), "confirmed"))
    return _union(links)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept (whether doc_id names its component) of each row of docs (doc_id, text)."""
    signed = store.materialize(sign(docs, n), "signed")
    full = signed.where("class is not null and doc_id is not null")
    classes = full.groupBy("class").agg(
        F.min("tokens").alias("tokens"), F.min(F.struct("doc_id", "text_hash")).alias("head"), F.max("n_shingles").alias("size")
    )
    classes = store.materialize(classes, "classes")
    found = clumps(classes.select("class", "tokens"), percent / 100, trees)
    members = found.join(classes.select("class", "head.*", "size"), "class")
    links = confirm(docs.select(F.col("doc_id").cast("long"), "text"), store.materialize(members, "members"), n, percent)
    roots = store.materialize(components(links), "roots")
    named = classes.select("class", F.col("head.doc_id").alias("least")).join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = store.materialize(named.withColumn("root", F.coalesce("root", "class")), "named")
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(lowest, "root").select("class", "component_id")
    joined = signed.drop("tokens").join(of_class, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select(
        "doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the document with the least doc_id, once."""
    names, light = docs.columns, docs.select("doc_id", "text", columns.pack(docs, "doc_id", "text"))
    found = near_duplicates(docs.select("doc_id", "text"), n, percent, trees).where("kept and doc_id is not null")
    found = found.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    named = light.where("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
    same = (F.col("doc_id") == F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))
    once = named.join(found.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).drop("text_hash")
    return once.unionByName(light.where("doc_id is null")).select(*columns.unpack(names, "doc_id", "text"))
