"""Words of whole texts, as columns and as 64-bit hashes in numpy.

A word is a maximal run of characters other than space and U+0009 to U+000D, after A-Z
are lower-cased. Equal words have equal hashes on every machine. Null texts have no words.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step takes; texts are cut between words, never dropped.
STEP = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
U64 = np.uint64


def cut(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, for what needs much memory for each row."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def count(text: Column) -> Column:
    """How many words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _powers(n: int, kept: list = [np.ones(1, U64)]) -> np.ndarray:  # noqa: B006
    if len(kept[0]) < n:
        out = np.full(2 * n, _BASE, U64)
        out[0] = 1
        kept[0] = np.multiply.accumulate(out)
    return kept[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _slices(buf: bytes) -> Iterator[bytes]:
    """Pieces of about STEP bytes that end after white space."""
    at = 0
    while at < len(buf):
        end = min(len(buf), at + STEP)
        while end < len(buf):
            found = buf[end : end + STEP]
            cut = np.flatnonzero(_SPACE[np.frombuffer(found, np.uint8)])
            if len(cut):
                end += int(cut[0]) + 1
                break
            end = min(len(buf), end + STEP)
        yield buf[at:end]
        at = end


def hashes(texts: Sequence[str | None], plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after the other, and where each text's begin (and end).

    plain: all letters are lower-cased and ASCII punctuation separates words, as white space does.
    """
    if plain:
        parts = [(t or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN) for t in texts]
    else:
        parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64) if parts else np.zeros(0, np.int64)
    words, places, base = [], [], 0
    for piece in _slices(b"\n".join([*parts, b""])):
        buf = np.frombuffer(piece, np.uint8)
        gap = _SPACE[buf]
        start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        if len(start):
            stop = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
            at = np.arange(len(buf), dtype=np.int64)
            at -= np.repeat(start, np.diff(np.append(start, len(buf)))) if start[0] == 0 else np.concatenate([np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(buf))))])
            at[gap] = 0
            value = (buf.astype(U64) + U64(1)) * _powers(int((stop - start).max()) + 1)[at]
            value[gap] = 0
            words.append(mix(np.add.reduceat(value, start) + (stop - start).astype(U64) * U64(0xD6E8FEB86659FD93)))
            places.append(start + base)
        base += len(buf)
    if not words:
        return np.zeros(0, U64), np.zeros(len(parts) + 1, np.int64)
    bounds = np.searchsorted(np.concatenate(places), ends)
    return np.concatenate(words), np.concatenate([[0], bounds]).astype(np.int64)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word runs that start at each place; shorter by n - 1."""
    if len(words) < n:
        return np.zeros(0, U64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out) + words[k : len(words) - n + 1 + k]
    return mix(out)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; the whole sequence as one if it is shorter; none without words."""
    if 0 < len(words) < n:
        return grams(words, len(words)) ^ U64(len(words))
    return np.unique(grams(words, n))
