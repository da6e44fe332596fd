"""Shared plumbing: the shared folder, whole-text batches from Arrow and vectorised hashes of slices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, dropped, saved, shared_dir, sized, small_enough
from ..sources.tables import read

__all__ = ["delete", "dropped", "saved", "shared_dir", "sized", "small_enough"]

#: A word, as every contract here takes it, for Java's and Python's regex engines alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that one numpy step handles; a longer document is a step of its own.
STEP_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, sf_dir, name)


def unused(name: str, *frames: DataFrame) -> str:
    """The name, with underscores before it until no frame has a column of that name."""
    while any(name.lower() in (c.lower() for c in f.columns) for f in frames):
        name = "_" + name
    return name


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_steps(column: pa.Array, limit: int = STEP_BYTES):
    """Yields (first row, end row, UTF-8 bytes, byte offsets of the rows) of whole texts; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mixed(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, in place."""
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Codes of a slice are below two to this power.
CODE_BITS = np.uint64(21)


def slice_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice codes[start:end]; slices come in order and don't overlap.

    Each code and its place in the slice become one number, which splitmix64 scrambles; a slice's hash scrambles the sum. Unlike in
    a polynomial sum there is no base whose powers could cancel, so texts that are built from each other collide by chance alone.
    """
    n = len(codes)
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(n, dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.r_[starts, n]))
    with np.errstate(over="ignore"):
        x = place.view(np.uint64)
        x <<= CODE_BITS
        x += codes
        x += np.uint64(1)
        x *= _GOLDEN
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(x), out=total[1:])
        return mixed(total[ends] - total[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Byte values with A-Z as a-z.
SMALL_LETTERS = np.arange(256, dtype=np.uint8)
SMALL_LETTERS[65:91] += 32


#: True for the six bytes that part words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_slices(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the texts in raw, and the index of each text's first word (one more at the end)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)
