"""Growing log files as a streaming source.

``spark.readStream.format("logtail").option("path", glob)`` gives the complete lines of all files that the glob
names, each once, while the files grow. A file is known by device and inode and by a checksum of its first bytes:

- appended lines are read from where the last batch ended, up to the last newline;
- a renamed file (rotation) keeps its place, and its unfinished last line counts as complete;
- a file that became shorter, or whose first bytes changed, was cut off or replaced: it is read from 0 again.

What is read is kept in the query's checkpoint as (file, bytes), so a restart neither loses nor doubles lines that are
still there. Byte ranges are cut in slices at newlines and read in parallel. Lines of a file that is deleted, or
cut off, before they were read are gone. The folder must be one that all executors see.

Options: ``flushBytes`` and ``flushSeconds``: a batch begins when so many new bytes are there, or the oldest of them
has waited so long (0: at once); ``sliceBytes``: bytes that one task reads.
"""

import glob
import os
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, kind string, file string"
HEAD, STEP, ROWS = 256, 1 << 16, 10_000


@dataclass
class Slice(InputPartition):
    path: str
    file: str
    start: int
    end: int
    first: bool


def _checksum(path: str, n: int) -> int:
    with open(path, "rb") as f:
        return zlib.crc32(f.read(n))


def _last_line_end(path: str, floor: int, size: int) -> int:
    """Place after the last newline before ``size``, at least ``floor``."""
    with open(path, "rb") as f:
        at = size
        while at > floor:
            start = max(floor, at - STEP)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return floor


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.pattern = options["path"].removeprefix("file:")
        self.flush_bytes = int(options.get("flushbytes", 20_000))
        self.flush_seconds = float(options.get("flushseconds", 2))
        self.slice = int(options.get("slicebytes", 32 << 20))
        self.known: dict[str, dict] = {}
        self.offered: dict[str, dict] = {}
        self.waiting_since: float | None = None

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _look(self) -> dict[str, dict]:
        found = {}
        for path in sorted(glob.glob(self.pattern)):
            try:
                at = os.stat(path)
                file = f"{at.st_dev}:{at.st_ino}"
                old = self.known.get(file)
                if old and not self._same(path, at.st_size, old):
                    old = None
                floor = old["end"] if old else 0
                renamed = old is not None and old["path"] != path
                end = at.st_size if renamed else _last_line_end(path, floor, at.st_size)
                n = min(HEAD, end)
                found[file] = {"path": path, "end": end, "n": n, "sum": _checksum(path, n)}
            except FileNotFoundError:  # moved or deleted since it was listed: the next look sees what became of it
                continue
        return found

    @staticmethod
    def _same(path: str, size: int, old: dict) -> bool:
        return size >= old["end"] and _checksum(path, old["n"]) == old["sum"]

    def latestOffset(self) -> dict:
        seen = self._look()
        new = sum(x["end"] - (self.offered[f]["end"] if f in self.offered and self.offered[f]["end"] <= x["end"] else 0) for f, x in seen.items())
        changed = new > 0 or any(f not in seen or seen[f]["sum"] != x["sum"] and seen[f]["n"] == x["n"] for f, x in self.offered.items())
        now = time.monotonic()
        if not changed:
            self.waiting_since = None
            return {"files": self.offered or seen}
        self.waiting_since = self.waiting_since or now
        if new < self.flush_bytes and now - self.waiting_since < self.flush_seconds:
            return {"files": self.offered}
        self.waiting_since, self.offered, self.known = None, seen, seen
        return {"files": seen}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        if not self.known:  # after a restart: what the checkpoint says was read or is to be read again
            self.known = self.offered = end["files"]
        out = []
        for file, now in end["files"].items():
            old = start["files"].get(file)
            begin = old["end"] if old and old["end"] <= now["end"] and (old["n"], old["sum"]) == self._head(now, old["n"]) else 0
            for at in range(begin, now["end"], self.slice):
                out.append(Slice(now["path"], file, at, min(now["end"], at + self.slice), at == begin))
        return out or [Slice("", "", 0, 0, True)]

    @staticmethod
    def _head(now: dict, n: int) -> tuple[int, int]:
        """The checksum of the first n bytes, as far as the file still has them; else as it was when the batch was planned."""
        if now["n"] == n:
            return n, now["sum"]
        try:
            return n, _checksum(now["path"], n)
        except FileNotFoundError:
            return -1, 0

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.end:
            return
        path = _find(partition, self.pattern)
        if path is None:
            return
        folder = os.path.basename(os.path.dirname(path))
        kind = folder.removeprefix("kind=") if folder.startswith("kind=") else None
        held: list[str] = []

        def out() -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays(
                [pa.array(held, pa.string()), pa.array([kind] * n, pa.string()), pa.array([path] * n, pa.string())], names=["value", "kind", "file"]
            )

        with open(path, "rb") as f:
            at = partition.start
            f.seek(at)
            if not partition.first:  # a line that began before belongs to the slice before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < partition.end:
                line = f.readline()
                if not line:
                    break
                at += len(line)
                held.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                if len(held) >= ROWS:
                    yield out()
                    held = []
        if held:
            yield out()


def _find(part: Slice, pattern: str) -> str | None:
    """The path that the slice's file has now."""
    folder = os.path.dirname(part.path)
    for path in [part.path, *glob.glob(pattern), *glob.glob(os.path.join(glob.escape(folder), "*"))]:
        try:
            at = os.stat(path)
        except FileNotFoundError:
            continue
        if f"{at.st_dev}:{at.st_ino}" == part.file:
            return path
    return None


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogTail)
