"""Conversation prefix trie from sorted sequences: sparse tables over LCPs instead of a tree walk.

Every conversation is a sequence of turns (role and text). A node of depth d is a different sequence of d first
turns; its members are the conversations that begin with it. Sorted, they stand next to each other, and the
least LCP (number of equal first turns) between neighbours tells how far: from any member, binary searches over
a sparse table of range minima find both ends of the interval on their own, without a stack.

1. A turn becomes two 64-bit numbers that depend on its place; the xor of a prefix's numbers is the node's id.
   Turns are numbered by a range-partitioned sort, so one conversation may fill many tasks.
2. Sequences are cut into segments of SEGMENT turns. A segment's row is sorted after the id of all turns before it,
   so rows of one node's continuations meet whatever the length of a conversation, and rows stay small.
3. Rows are sorted in ranges of about RANGE rows. In each range: LCPs of neighbours, sparse tables, and for each
   candidate prefix its left and right extent; the leftmost row of an interval speaks for it. Parts of one
   node in several ranges are added up by id, at most one part a range.
4. Sums over subtrees are sums over members. For a member c let T(c) be the words of the prefix down to the first
   node whose smallest member c is. Node v of smallest member m then saves sum T(c) - T(m) - (n - 1) W, over its n
   members, with W the words before its last turn. Its leaves are the members that are the smallest of a leaf.
   So a second pass over the same intervals takes differences of running sums, at any depth.
5. The ids of conversations that end at a node are hashed where they stand; if they reach the end of a range, ranges
   send their part as one text, and one task streams over these texts in order (SHA-256 allows no other way).

Turns are ordered by number (null first), ties by role, then by a hash of role and text; repeated rows are turns of
their own. Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out; a
remainder of negative ids has their sign. Other columns are ignored. An empty table has no nodes, not even a root.
"""

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsieve.llm import words
from logsieve.llm.near import _groups
from logsieve.sources import store

#: Turns of a segment; rows of a range; turns of a range while they are numbered; segments of one running xor.
SEGMENT, RANGE, NUMBERED, STRETCH = 32, 50_000, 200_000, 1024
NO_ENDS = sha256(b"").hexdigest()
I64 = pa.int64()
NODE, ROW, ENDS = range(3)
PART = pa.schema([
    ("kind", pa.int32()), ("pid", I64), ("place", I64), ("right", I64), ("least_at", I64), ("depth", I64), ("a", I64), ("b", I64),
    ("pa", I64), ("pb", I64), ("conv_id", I64), ("n", I64), ("before", I64), ("ends", pa.string()),
])
PART_DDL = ", ".join(f"{f.name} {'string' if f.name == 'ends' else 'int' if f.name == 'kind' else 'long'}" for f in PART)


def _ranges(n: int, size: int) -> int:
    return max(1, -(-n // size))


def number(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, h, words) as conv_id, pos (from 0, in order), h, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column("conv_id").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            place = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
            if conv[0] == last:
                place[: first[1] if len(first) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), pa.array(place), pa.array(np.full(len(conv), pid)), b.column("h"), b.column("words")], names=["conv_id", "place", "pid", "h", "words"]
            )

    key = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h")]
    ordered = turns.repartitionByRange(_ranges(turns.count(), NUMBERED), *key).sortWithinPartitions(*key)
    out = store.materialize(ordered.mapInArrow(run, "conv_id long, place long, pid long, h binary, words long"), "numbered-turns")
    counts = out.groupBy("conv_id", "pid").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    # only the first conversation of a range can have begun before it: at most one row a range
    moved = counts.withColumn("before", before).where("before > 0").select("conv_id", "pid", "before")
    joined = out.join(F.broadcast(moved), ["conv_id", "pid"], "left")
    return joined.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "h", "words")


def rebuild(numbered: DataFrame, group: int, head: int) -> DataFrame:
    """conv_id, turns, pos, h, words: the first crc32(id) % head turns of the group's first conversation, then the own ones after as many.

    turns: how many there are; one row with a null pos for a conversation without any.
    """
    start = F.col("conv_id") - F.col("conv_id") % group
    heads = numbered.where((F.col("pos") < head - 1) & (start == F.col("conv_id")))
    heads = heads.groupBy(F.col("conv_id").alias("start")).agg(F.sort_array(F.collect_list(F.struct("pos", "h", "words"))).alias("given"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).alias("taken")
    convs = numbered.groupBy("conv_id").agg(F.count("*").alias("own")).select("conv_id", "own", start.alias("start"), taken)
    given = F.slice(F.coalesce("given", F.array()), F.lit(1), F.col("taken").cast("int"))
    convs = convs.join(heads, "start", "left").select("conv_id", "own", "taken", given.alias("given"))
    lead = F.size("given").cast("long")
    convs = convs.withColumn("lead", lead).withColumn("turns", lead + F.greatest(F.lit(0), F.col("own") - F.col("taken")))
    convs = store.materialize(convs, "conversations")
    from_head = convs.select("conv_id", "turns", F.inline_outer("given"))
    light = convs.select("conv_id", "taken", "lead", "turns")
    own = numbered.join(light, "conv_id").where(F.col("pos") >= F.col("taken"))
    own = own.select("conv_id", "turns", (F.col("pos") - F.col("taken") + F.col("lead")).alias("pos"), "h", "words")
    return from_head.where("pos is not null or turns = 0").unionByName(own)


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, seg, ga, gb (id of all turns before), before (their words), key (two numbers for each turn), words, more (whether turns follow)."""
    pos = F.col("pos")
    lanes = turns.select(
        "conv_id", "turns", F.coalesce(F.floor(pos / SEGMENT), F.lit(0)).alias("seg"), "pos", "words",
        F.when(pos.isNotNull(), F.xxhash64("pos", "h")).alias("a"), F.when(pos.isNotNull(), F.xxhash64("h", "pos", F.lit(1))).alias("b"),
    )
    one = F.when(pos.isNotNull(), F.struct("pos", "a", "b", "words"))
    rows = lanes.groupBy("conv_id", "seg").agg(
        F.max("turns").alias("turns"), F.sort_array(F.collect_list(one)).alias("t"),
        F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"), F.coalesce(F.sum("words"), F.lit(0)).alias("xw"),
    )
    rows = store.materialize(rows.select(
        "conv_id", "seg", "xa", "xb", "xw", (F.col("turns") > (F.col("seg") + 1) * SEGMENT).alias("more"), (F.col("turns") > SEGMENT).alias("long"),
        F.flatten(F.transform("t", lambda x: F.array(x["a"], x["b"]))).alias("key"), F.transform("t", lambda x: x["words"]).alias("words"),
    ), "segments")
    ids = [F.col("xa"), F.col("xb"), F.col("xw")]
    long_ = rows.where("long").withColumn("stretch", F.floor(F.col("seg") / STRETCH)).select("conv_id", "seg", "stretch", *ids)
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    per = long_.groupBy("conv_id", "stretch").agg(F.bit_xor("xa").alias("sa"), F.bit_xor("xb").alias("sb"), F.sum("xw").alias("sw"))
    over = upto.partitionBy("conv_id").orderBy("stretch")
    per = per.select("conv_id", "stretch", *[f("s" + k).over(over).alias("p" + k) for k, f in (("a", F.bit_xor), ("b", F.bit_xor), ("w", F.sum))])
    over = upto.partitionBy("conv_id", "stretch").orderBy("seg")
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    both = long_.join(per, ["conv_id", "stretch"]).select(
        "conv_id", "seg", zero(F.col("pa")).bitwiseXOR(zero(F.bit_xor("xa").over(over))).alias("ga"),
        zero(F.col("pb")).bitwiseXOR(zero(F.bit_xor("xb").over(over))).alias("gb"), (zero(F.col("pw")) + zero(F.sum("xw").over(over))).alias("before"),
    )
    short = rows.where("not long").select("*", *[F.lit(0).cast("long").alias(k) for k in ("ga", "gb", "before")])
    out = short.unionByName(rows.where("long").join(both, ["conv_id", "seg"]))
    return store.materialize(out.select("conv_id", F.col("seg").cast("long").alias("seg"), "ga", "gb", "before", "key", "words", "more"), "sorted-after")


class Minima:
    """Sparse table of range minima."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= len(values):
            half, last = 1 << len(self.levels) - 1, self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Minima of values[left..right]."""
        out = np.empty(len(left), self.levels[0].dtype)
        level = np.frexp((right - left + 1).astype(float))[1] - 1
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.levels[k][left[at]], self.levels[k][right[at] - (1 << k) + 1])
        return out

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place that is reached from each place over values of at least ``least`` (value i stands between i - 1 and i)."""
        out = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table = self.levels[k]
            fits = out + 1 < len(table)
            fits[fits] = table[out[fits] + 1] >= least[fits]
            out[fits] += 1 << k
        return out

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        out = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table = self.levels[k]
            start = out - (1 << k) + 1
            fits = start > 0
            fits[fits] = table[start[fits]] >= least[fits]
            out[fits] -= 1 << k
        return out


def _lists(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    col = t.column(name).combine_chunks()
    each = pa.compute.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    return col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(each)])


def _running(values: np.ndarray, starts: np.ndarray, ufunc) -> tuple[np.ndarray, np.ndarray]:
    """Running totals with a zero in front, and what to take off for each row."""
    total = np.concatenate([np.zeros(1, values.dtype), ufunc.accumulate(values)])
    return total, total[starts]


def intervals(t: pa.Table, pid: int, segment: int) -> Iterator[pa.RecordBatch]:
    """NODE, ROW and ENDS rows of one range of sorted segment rows."""
    m = t.num_rows
    conv, seg, ga, gb, before = (t.column(k).to_numpy() for k in ("conv_id", "seg", "ga", "gb", "before"))
    more = t.column("more").to_numpy()
    key, _ = _lists(t, "key")
    word, at = _lists(t, "words")
    a, b = np.ascontiguousarray(key[0::2]), np.ascontiguousarray(key[1::2])
    start, size = at[:-1], np.diff(at)
    group = np.concatenate([[False], (seg[1:] == seg[:-1]) & (ga[1:] == ga[:-1]) & (gb[1:] == gb[:-1])])
    lcp = np.where(group, 0, -1)
    open_ = np.flatnonzero(group)
    for e in range(segment):
        open_ = open_[(size[open_] > e) & (size[open_ - 1] > e)]
        i, j = start[open_] + e, start[open_ - 1] + e
        open_ = open_[(a[i] == a[j]) & (b[i] == b[j])]
        if not len(open_):
            break
        lcp[open_] = e + 1
    table = Minima(lcp)
    # candidates: prefixes that the row before hasn't; the root is one of a first segment
    least = np.maximum(lcp + 1, np.where(seg == 0, 0, 1))
    each = np.maximum(0, size - least + 1)
    row = np.repeat(np.arange(m), each)
    e = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(least, each)
    left, right = table.left(row, e), table.right(row, e)
    kept = left == row
    row, e, right = row[kept], e[kept], right[kept]
    smallest = Minima(conv).least(row, right)
    order = np.argsort(conv, kind="stable")
    # conversations stand once in a segment's rows, but twice in a range that holds several segments
    least_at = _place_of(conv, order, smallest, row, right)
    (xa, xa0), (xb, xb0), (ww, ww0) = (_running(v, start, f) for v, f in ((a, np.bitwise_xor), (b, np.bitwise_xor), (word, np.add)))
    ids = [g[row] ^ x[start[row] + k] ^ x0[row] for k in (e, np.maximum(e - 1, 0)) for g, x, x0 in ((ga, xa, xa0), (gb, xb, xb0))]
    words_before = before[row] + ww[start[row] + np.maximum(e - 1, 0)] - ww0[row]
    # runs of conversations that end with the same turns
    new = np.concatenate([[True], ~((lcp[1:] == size[1:]) & (size[1:] == size[:-1]) & (more[1:] == more[:-1]))])
    first = np.flatnonzero(new & ~more)
    bounds = np.append(np.flatnonzero(new), m)
    last = bounds[np.searchsorted(bounds, first, "right")]
    digest: dict[int, str] = {}
    texts = []
    for i, z in zip(first.tolist(), last.tolist(), strict=True):
        text = ",".join(map(str, conv[i:z].tolist()))
        if i and z < m:
            digest[i] = sha256(text.encode()).hexdigest()
        else:
            full = at[i + 1]
            texts.append((int(seg[i] * segment + size[i]), int(ga[i] ^ xa[full] ^ xa0[i]), int(gb[i] ^ xb[full] ^ xb0[i]), text))
    ends = [digest.get(i) if whole else None for i, whole in zip(row.tolist(), (e == size[row]).tolist(), strict=True)]
    yield _part(
        kind=NODE, pid=pid, rows=len(row), place=row, right=right, least_at=least_at, depth=seg[row] * segment + e, a=ids[0], b=ids[1], pa=ids[2], pb=ids[3],
        conv_id=smallest, n=right - row + 1, before=words_before, ends=ends,
    )
    # n: whether turns follow; before: words of the conversation up to here
    yield _part(kind=ROW, pid=pid, rows=m, place=np.arange(m), conv_id=conv, n=more.astype(np.int64), before=before + ww[at[1:]] - ww0)
    if texts:
        depth, ta, tb, text = zip(*texts, strict=True)
        yield _part(kind=ENDS, pid=pid, rows=len(texts), depth=depth, a=ta, b=tb, ends=text)


def _place_of(conv: np.ndarray, order: np.ndarray, wanted: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The place within left..right that has the wanted conversation; places of one conversation are in order."""
    by = conv[order]
    lo, hi = np.searchsorted(by, wanted, "left"), np.searchsorted(by, wanted, "right")
    while True:  # first of its places that isn't before left
        early = (hi - lo > 1) & (order[lo] < left)
        if not early.any():
            return order[lo]
        lo = lo + early


def _part(kind: int, pid: int, rows: int, **cols) -> pa.RecordBatch:
    given = {"kind": np.full(rows, kind, np.int32), "pid": np.full(rows, pid)} | cols
    return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(rows, f.type) for f in PART], schema=PART)


def find_nodes(rows: DataFrame) -> DataFrame:
    """NODE, ROW and ENDS rows of all ranges of segment rows."""
    segment = SEGMENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from intervals(pa.Table.from_batches(held), TaskContext.get().partitionId(), segment)

    order = ["seg", "ga", "gb", "key", "more", "conv_id"]
    ranges = _ranges(rows.count(), RANGE)
    return store.materialize(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(run, PART_DDL), "trie-parts")


def sum_members(parts: DataFrame, values: DataFrame) -> DataFrame:
    """depth, a, b, t, least (conv_id and t of the smallest member), leaves of each part of a node; values: conv_id, t, leaf."""
    rows = parts.where(F.col("kind") == ROW).select("pid", "place", "conv_id").join(values, "conv_id")
    own = rows.select("pid", F.lit(ROW).alias("kind"), "place", F.col("t").alias("x"), F.col("leaf").alias("y"), *[F.lit(None).cast("long").alias(k) for k in ("z", "depth", "a", "b", "conv_id")])
    asked = parts.where(F.col("kind") == NODE).select(
        "pid", F.lit(ROW + 1).alias("kind"), "place", F.col("right").alias("x"), F.lit(None).cast("long").alias("y"), F.col("least_at").alias("z"), "depth", "a", "b", "conv_id"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _groups(batches, ["pid"]):
            is_row = t.column("kind").to_numpy() == ROW
            own, node = t.filter(pa.array(is_row)), t.filter(pa.array(~is_row))
            value = own.column("x").to_numpy()
            total = np.concatenate([[0], np.cumsum(value)])
            leaves = np.concatenate([[0], np.cumsum(own.column("y").to_numpy())])
            left, right, least = (node.column(k).to_numpy() for k in ("place", "x", "z"))
            keys = [node.column(k).combine_chunks() for k in ("depth", "a", "b", "conv_id")]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(value[least]), pa.array(total[right + 1] - total[left]), pa.array(leaves[right + 1] - leaves[left])],
                names=["depth", "a", "b", "conv_id", "own", "t", "leaves"],
            )

    dealt = own.unionByName(asked).repartition("pid").sortWithinPartitions("pid", "kind", "place")
    return dealt.mapInArrow(run, "depth long, a long, b long, conv_id long, own long, t long, leaves long")


def hash_ends(parts: DataFrame) -> DataFrame:
    """depth, a, b, hashed: of the conversations that end at a node, for those that reach the end of a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for b in batches:
            for *key, text in zip(*(b.column(k).to_pylist() for k in ("depth", "a", "b")), b.column("ends").to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        yield one(now, digest)
                    now, digest = key, sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if now is not None:
            yield one(now, digest)

    def one(key: list[int], digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": [key[0]], "a": [key[1]], "b": [key[2]], "hashed": [digest.hexdigest()]})

    texts = parts.where(F.col("kind") == ENDS).select("depth", "a", "b", "pid", "ends")
    return texts.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "pid").mapInArrow(run, "depth long, a long, b long, hashed string")


def trie(conversations: DataFrame, group: int = 20, head: int = 4) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the
    rebuilt conversations (conv_id, turn, role, text)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), F.substring(F.unhex(F.sha2(both, 256)), 1, 16).alias("h"), words.count(text).alias("words")
    )
    numbered = store.materialize(number(store.materialize(turns, "turns")), "positions")
    parts = find_nodes(segments(rebuild(numbered, group, head)))
    key = ["depth", "a", "b"]
    nodes = parts.where(F.col("kind") == NODE).groupBy(*key).agg(
        *[F.min(k).alias(k) for k in ("pa", "pb", "conv_id", "before")], F.sum("n").alias("n_convs"), F.max("ends").alias("ends")
    )
    nodes = store.materialize(nodes, "nodes")
    root = nodes.where("depth = 0").select("conv_id").first()
    if root is None:
        return conversations.sparkSession.createDataFrame(
            [], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        )
    # facts about a node meet in one grouping, which needs less memory than a join for each kind
    child = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"), F.lit(1).alias("child"))
    own = ["pa", "pb", "conv_id", "before", "n_convs", "ends"]
    both = nodes.withColumn("child", F.lit(0)).unionByName(child, allowMissingColumns=True)
    nodes = both.groupBy(*key).agg(*[F.max(k).alias(k) for k in own], F.sum("child").alias("n_children"))
    nodes = store.materialize(nodes, "nodes")
    of_conv = nodes.groupBy("conv_id").agg(F.min("before").alias("t"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    whole = parts.where((F.col("kind") == ROW) & (F.col("n") == 0)).select("conv_id", F.col("before").alias("whole"))
    values = whole.unionByName(of_conv, allowMissingColumns=True).groupBy("conv_id").agg(
        F.coalesce(F.max("t"), F.max("whole")).alias("t"), F.coalesce(F.max("leaf"), F.lit(0)).alias("leaf")
    )
    sums = sum_members(parts, store.materialize(values, "members")).select(*key, F.struct("conv_id", "own").alias("least"), "t", "leaves")
    facts = nodes.unionByName(sums, allowMissingColumns=True).unionByName(hash_ends(parts), allowMissingColumns=True)
    nodes = facts.groupBy(*key).agg(
        *[F.max(k).alias(k) for k in [*own, "n_children", "hashed"]], F.sum("t").alias("t"), F.sum("leaves").alias("n_leaves"), F.min("least").alias("least")
    )
    nodes = store.materialize(nodes, "nodes")
    parents = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent"))
    out = nodes.join(parents, ["depth", "pa", "pb"], "left")
    parent = F.when(F.col("depth") == 1, F.lit(root["conv_id"])).when(F.col("depth") > 1, F.col("parent"))
    saved = F.col("t") - F.col("least.own") - (F.col("n_convs") - 1) * F.col("before")
    return out.select(
        "conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("hashed", "ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
