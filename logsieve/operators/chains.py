"""Starts of windows that open at an event and take all events up to a fixed time after it.

After a start at ``s`` the next start is the first event later than ``s + gap``, so starts form a chain through
an address's events that has to be followed in order. A busy address is cut in time, and its chunks are followed
in parallel:

1. What a chunk does to the chain is a step function from the reach (last start plus gap) with which the chain enters to
   the reach with which it leaves. Next-start pointers, doubled until they stand still, give it for every
   possible entry; only entries within one gap of the chunk's first event are possible, which bounds the function.
2. Functions of FAN neighbouring chunks are composed into one, and these again, until one is left for each address.
3. Back down, each group's entering reach is carried through its members' functions, which gives every chunk its own.
4. All chunks are walked at once, each from its reach.

No task holds more than one chunk and two functions. Addresses of a single chunk take only step 4.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve.sources.store import materialize

c = F.col
#: Events of a chunk; one block of one gap more at most. Functions that one task composes.
CHUNK, FAN = 1_000_000, 64
L64 = pa.list_(pa.int64())
STEPS = "src_ip string, place bigint, keys array<bigint>, outs array<bigint>"


def apply(keys: np.ndarray, outs: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The step function's value: outs of the first key beyond the reach, the reach itself beyond the last key."""
    at = np.searchsorted(keys, reach, "right")
    return np.where(at < len(keys), outs[np.minimum(at, len(outs) - 1)] if len(outs) else reach, reach)


def chunk_steps(times: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The step function of a chunk of sorted distinct times."""
    m = len(times)
    after = np.searchsorted(times, times + gap, "right")
    last = np.where(after < m, after, np.arange(m))
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    n = min(m, int(np.searchsorted(times, times[0] + gap, "right")) + 1)
    return times[:n], times[last[:n]] + gap


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """One step function after the other, as far as a reach can lie when the first begins."""
    keys, outs = first
    more = then[0] > keys[-1]
    keys, outs = np.concatenate([keys, then[0][more]]), np.concatenate([apply(*then, outs), then[1][more]])
    n = int(np.searchsorted(keys, keys[0] + gap, "right")) + 1
    return keys[:n], outs[:n]


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Each batch cut where the key changes."""
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_pylist() for k in key]
        keys = list(zip(*cols, strict=True))
        at = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at]:
                yield keys[at], b.slice(at, i - at)
                at = i


def _whole(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Each key's times."""
    now, held = None, []
    for k, b in _runs(batches, key):
        if k != now:
            if held:
                yield now, np.concatenate(held)
            now, held = k, []
        held.append(b.column("ms").to_numpy())
    if held:
        yield now, np.concatenate(held)


def _step_row(ip: str, place: int, keys: np.ndarray, outs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([ip], pa.string()), pa.array([place], pa.int64()), pa.array([keys], L64), pa.array([outs], L64)], names=["src_ip", "place", "keys", "outs"]
    )


def _steps_of(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for place, keys, outs in zip(b.column("place").to_pylist(), b.column("keys"), b.column("outs"), strict=True):
        yield place, keys.values.to_numpy() if keys.is_valid else None, outs.values.to_numpy() if outs.is_valid else None


def map_chunks(points: DataFrame, gap: int) -> DataFrame:
    """src_ip, place, keys, outs: the step function of each chunk of points (src_ip, chunk, ms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ip, chunk), times in _whole(batches, ["src_ip", "chunk"]):
            yield _step_row(ip, chunk, *chunk_steps(times, gap))

    return points.repartition("src_ip", "chunk").sortWithinPartitions("src_ip", "chunk", "ms").mapInArrow(run, STEPS)


def compose_groups(steps: DataFrame, gap: int, fan: int) -> DataFrame:
    """The step functions of ``fan`` neighbours each, as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for key, b in _runs(batches, ["src_ip", "upper"]):
            for _, keys, outs in _steps_of(b):
                if key != now:
                    if now is not None:
                        yield _step_row(*now, *held)
                    now, held = key, (keys, outs)
                else:
                    held = compose(held, (keys, outs), gap)
        if now is not None:
            yield _step_row(*now, *held)

    dealt = steps.withColumn("upper", F.floor(c("place") / fan)).repartition("src_ip", "upper")
    return dealt.sortWithinPartitions("src_ip", "upper", "place").mapInArrow(run, STEPS)


def reaches(steps: DataFrame, upper: DataFrame | None, fan: int) -> DataFrame:
    """src_ip, place, reach: what each function is entered with; ``upper``: the same for groups of ``fan`` (None: one function each)."""
    if upper is None:
        return steps.select("src_ip", "place", F.lit(None).cast("bigint").alias("reach"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reach = None, None
        for key, b in _runs(batches, ["src_ip", "upper"]):
            ips, places, found = [], [], []
            for (place, keys, outs), given in zip(_steps_of(b), b.column("reach").to_pylist(), strict=True):
                if key != now:  # the group's own row comes first
                    now, reach = key, given
                    continue
                ips.append(key[0])
                places.append(place)
                found.append(reach)
                reach = int(outs[0]) if reach is None else int(apply(keys, outs, np.array([reach]))[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ips, pa.string()), pa.array(places, pa.int64()), pa.array(found, pa.int64())], names=["src_ip", "place", "reach"]
            )

    none = F.lit(None).cast("array<bigint>")
    own = upper.select("src_ip", c("place").alias("upper"), F.lit(-1).cast("bigint").alias("place"), none.alias("keys"), none.alias("outs"), "reach")
    rows = steps.select("src_ip", F.floor(c("place") / fan).alias("upper"), "place", "keys", "outs", F.lit(None).cast("bigint").alias("reach"))
    dealt = own.unionByName(rows).repartition("src_ip", "upper").sortWithinPartitions("src_ip", "upper", "place")
    return dealt.mapInArrow(run, "src_ip string, place bigint, reach bigint")


def walk(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[pa.RecordBatch]:
    """src_ip, start_ms of rows sorted by (src_ip, chunk, ms); a chunk's reach stands in its first row, before its times."""
    now, reach = None, None
    for key, b in _runs(batches, ["src_ip", "chunk"]):
        times = b.column("ms").fill_null(0).to_numpy()
        at, found = 0, []
        if key != now:
            now, reach = key, b.column("reach")[0].as_py()
            if b.column("ms")[0].as_py() is None:
                at = 1
        while True:
            if reach is not None:
                at += int(np.searchsorted(times[at:], reach, "right"))
            if at >= len(times):
                break
            found.append(int(times[at]))
            reach = found[-1] + gap
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.string()), pa.array(found, pa.int64())], names=["src_ip", "start_ms"])


def starts(points: DataFrame, gap: int, chunk: int | None = None, fan: int | None = None) -> DataFrame:
    """src_ip, start_ms of points: distinct (src_ip, block, ms), where a block is ms divided by the gap. No null addresses."""
    size, fan = chunk or CHUNK, fan or FAN
    blocks = points.groupBy("src_ip", "block").agg(F.count("*").alias("n"))
    # one narrow row for each gap of time enters the window, however many events it has
    before = F.sum("n").over(Window.partitionBy("src_ip").orderBy("block")) - c("n")
    blocks = materialize(blocks.select("src_ip", "block", F.floor(before / size).alias("chunk")), "blocks")
    of_ip = blocks.groupBy("src_ip").agg(F.max("chunk").alias("last"))
    longest = of_ip.agg(F.max("last")).first()[0] or 0
    none = F.lit(None).cast("bigint")
    cut = points.join(blocks, ["src_ip", "block"]).select("src_ip", "chunk", "ms", none.alias("reach"))
    if longest:
        cut = materialize(cut, "chunks")
        busy = cut.join(of_ip.where("last > 0").select("src_ip"), "src_ip", "left_semi")
        levels = [materialize(map_chunks(busy.select("src_ip", "chunk", "ms"), gap), "steps")]
        while longest:  # chunk numbers shrink by the fan at each level
            levels.append(materialize(compose_groups(levels[-1], gap, fan), "steps"))
            longest //= fan
        found = None
        for steps in reversed(levels):
            found = materialize(reaches(steps, found, fan), "reaches")
        cut = cut.unionByName(found.select("src_ip", c("place").alias("chunk"), none.alias("ms"), "reach"))
    dealt = cut.repartition("src_ip", "chunk").sortWithinPartitions("src_ip", "chunk", c("ms").asc_nulls_first())
    return dealt.mapInArrow(lambda batches: walk(batches, gap), "src_ip string, start_ms bigint")


def place_within(df: DataFrame, group: list[str], order: list[Column], rows: int = 200_000) -> DataFrame:
    """df with ``place``, the number (from 1) of each row in its group by order, however large a group is.

    Rows are sorted in ranges by group and order, so a group may fill many tasks; each range numbers its rows, and
    what the ranges before it hold of its first group is added. At most one such number is there for a range.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, now, n = TaskContext.get().partitionId(), None, 0
        for key, b in _runs(batches, group):
            if key != now:
                now, n = key, 0
            places = pa.array(np.arange(n + 1, n + b.num_rows + 1))
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, places, pa.array(np.full(b.num_rows, pid))], names=[*names, "place", "pid"])

    keys = [c(g) for g in group] + order
    own = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    ranges = max(1, -(-df.count() // rows))
    sorted_ = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    numbered = materialize(sorted_.mapInArrow(run, f"{own}, place bigint, pid bigint"), "numbered")
    counts = numbered.groupBy(*group, "pid").agg(F.count("*").alias("n"))
    over = Window.partitionBy(*group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.withColumn("moved", F.sum("n").over(over)).where("moved > 0").drop("n")
    moved = moved.select(*[c(g).alias(f"_{i}") for i, g in enumerate([*group, "pid"])], "moved")
    same = [c(g).eqNullSafe(c(f"_{i}")) for i, g in enumerate([*group, "pid"])]
    joined = numbered.join(F.broadcast(moved), same, "left")
    return joined.select(*names, (c("place") + F.coalesce("moved", F.lit(0))).alias("place"))
