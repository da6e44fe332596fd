"""Byte-level BPE encoding and decoding (operator 5).

Pre-tokenisation uses no regex: every code point becomes a class symbol (letter, number, white space, other, apostrophe that opens
a contraction; white space also says whether a non-space follows), and a transition table over eight states says whether a slice
starts there. The scan over the symbols is associative: each block of symbols is first composed into a function from entry state
to exit state (all blocks side by side), the functions are composed from left to right, and a second sweep reads the starts off
with the entry states known. Slices that hash alike are compared in full, and only slices not met before go through pair merging:
all short ones at once, long ones with a heap each.

Defined results: null text counts as empty and has no ids; repeated rows are encoded each; very long texts are one numpy step;
an empty table gives an empty result; other columns of the input pass through untouched unless named like an output (those are
replaced).
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, cached_property
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slice_hashes, text_steps

L, N, O, AP1, AP2, SP_LAST, SP_MORE, WS_LAST, WS_MORE = range(9)
IN_WS, IN_L, IN_N, IN_O, IN_SP, IN_C1, IN_C2, AFTER_C = range(8)
STATES, SYMBOLS = 8, 9
#: Symbols in a block of the scan.
BLOCK = 256
#: Slices kept in a worker's cache, and their code points; it is emptied when full, which costs time and changes no result.
CACHE_SLICES, CACHE_POINTS = 300_000, 16_000_000
#: Slices of more bytes are merged one at a time, with a heap, as each merge of many slices at once touches all of them.
LONG = 256
NEVER = 1 << 40


@cache
def classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, for every code point."""
    out = np.full(sys.maxunicode + 1, 2, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            out[i] = 0
        elif kind == "N":
            out[i] = 1
    # fixed values: the code points with Unicode's White_Space property
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    return out


@cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a slice) by symbol * STATES + state; symbols from SYMBOLS on are those at the start of a text."""
    step, start = np.zeros((2 * SYMBOLS, STATES), np.uint8), np.ones((2 * SYMBOLS, STATES), bool)
    for first in (0, SYMBOLS):
        for symbol, state, joined in ((L, IN_L, (IN_L, IN_SP)), (N, IN_N, (IN_N, IN_SP)), (O, IN_O, (IN_O, IN_SP)), (AP1, IN_C1, ()), (AP2, IN_C2, ()), (SP_LAST, IN_SP, ()), (SP_MORE, IN_WS, (IN_WS,)), (WS_LAST, IN_WS, ()), (WS_MORE, IN_WS, (IN_WS,))):
            step[first + symbol] = state
            if not first:
                start[symbol, list(joined)] = False
    for apostrophe in (AP1, AP2):  # within a run of other signs, or after the space that joins it, it is one of them
        step[apostrophe, [IN_O, IN_SP]], start[apostrophe, [IN_O, IN_SP]] = IN_O, False
    step[L, IN_C2], step[L, IN_C1] = IN_C1, AFTER_C
    start[L, [IN_C2, IN_C1]] = False
    return step.ravel(), start.ravel()


def symbols(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    kind = classes()[points]
    n = len(points)
    last = np.zeros(n, bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    out = kind.copy()
    white = kind == 3
    follows = np.zeros(n, bool)
    follows[:-1] = ~white[1:]
    follows &= ~last
    at = np.flatnonzero(white)
    out[at] = np.where(points[at] == 32, SP_LAST, WS_LAST) + ~follows[at]
    at = np.flatnonzero(points == 39)
    if len(at):
        room = np.searchsorted(offsets, at, "right")
        left = offsets[room] - at - 1  # code points of the text after it
        one, two = (points[np.minimum(at + k, n - 1)] for k in (1, 2))
        single = (left >= 1) & np.isin(one, [ord(c) for c in "stmd"])
        pair = (left >= 2) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        out[at[single]], out[at[pair]] = AP1, AP2
    out[offsets[:-1][np.diff(offsets) > 0]] += SYMBOLS
    return out


def slice_starts(symbol: np.ndarray) -> np.ndarray:
    """Positions at which slices start, by the associative scan."""
    step, start = machine()
    n = len(symbol)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, WS_MORE, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T).astype(np.intp) * STATES
    function = np.tile(np.arange(STATES, dtype=np.uint8)[:, None], (1, blocks))
    for row in grid:
        function = step[row[None, :] + function]
    entry = np.zeros(blocks, np.uint8)
    state = IN_WS
    for b, f in enumerate(function.T.tolist()):
        entry[b] = state
        state = f[state]
    starts = np.empty((BLOCK, blocks), bool)
    state = entry
    for k, row in enumerate(grid):
        at = row + state
        starts[k], state = start[at], step[at]
    return np.flatnonzero(starts.T.ravel()[:n])


class Merges:
    """Pair merging for many slices at once, by ranks of byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], np.array(rank, np.int64)[order]
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    @cached_property
    def rank_of(self) -> dict[int, int]:
        return dict(zip(self.key.tolist(), self.rank.tolist(), strict=True))

    def long(self, data: bytes) -> list[int]:
        """The ids of one slice: always the least rank is merged next, the leftmost of equal ones."""
        ids = self.byte[np.frombuffer(data, np.uint8)].tolist()
        n, rank_of = len(ids), self.rank_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [rank_of.get(a << 32 | b, -1) for a, b in zip(ids[:-1], ids[1:], strict=True)] + [-1]
        heap = [(r, i) for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            if pair[i] != r:  # merged or changed since
                continue
            j = after[i]
            k = after[j]
            ids[i], pair[j], after[i] = r, -1, k
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0:
                    pair[x] = rank_of.get(ids[x] << 32 | ids[y], -1) if y < n else -1
                    if pair[x] >= 0:
                        heappush(heap, (pair[x], x))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NEVER)

    def strings(self, slices: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self([s.encode() for s in slices])

    def __call__(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slices end to end, number of ids of each)."""
        whole = np.fromiter(map(self.ranks.get, slices, repeat(-1)), np.int64, len(slices))
        todo = np.flatnonzero(whole < 0)
        done_ids, done_owner = [whole[whole >= 0]], [np.flatnonzero(whole >= 0)]
        for i in todo.tolist():
            if len(slices[i]) > LONG:
                done_ids.append(np.array(self.long(slices[i]), np.int64))
                done_owner.append(np.full(len(done_ids[-1]), i))
        todo = todo[np.fromiter((len(slices[i]) <= LONG for i in todo.tolist()), bool, len(todo))]
        if len(todo):
            texts = [slices[i] for i in todo.tolist()]
            ids = self.byte[np.frombuffer(b"".join(texts), np.uint8)]
            owner = np.repeat(todo, np.fromiter(map(len, texts), np.int64, len(texts)))
            rank = np.full(len(ids), NEVER)
            rank[:-1] = np.where(owner[1:] == owner[:-1], self.pairs(ids[:-1], ids[1:]), NEVER)
            while len(ids):
                bounds = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                size = np.diff(np.r_[bounds, len(ids)])
                least = np.minimum.reduceat(rank, bounds)
                live = least < NEVER
                if not live.all():  # slices without a further merge leave the table
                    keep = np.repeat(live, size)
                    done_ids.append(ids[~keep])
                    done_owner.append(owner[~keep])
                    ids, owner, rank = ids[keep], owner[keep], rank[keep]
                    size, least = size[live], least[live]
                    if not len(ids):
                        break
                at = np.flatnonzero(rank == np.repeat(least, size))
                at = at[np.r_[True, owner[at][1:] != owner[at][:-1]]]  # the leftmost of each slice
                ids[at] = rank[at]
                keep = np.ones(len(ids), bool)
                keep[at + 1] = False
                place = np.cumsum(keep) - 1
                ids, owner, rank, at = ids[keep], owner[keep], rank[keep], place[at]
                for x in (at, at[at > 0] - 1):
                    y = np.minimum(x + 1, len(ids) - 1)
                    rank[x] = np.where((x + 1 < len(ids)) & (owner[x] == owner[y]), self.pairs(ids[x], ids[y]), NEVER)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(slices))


class SliceCoder:
    """Encodes texts slice by slice; `encode_slices` is called only with slices that the cache lacks."""

    def __init__(self, encode_slices):
        self.encode_slices = encode_slices
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.points = 0
        self.flat, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)

    def make_room(self) -> None:
        """Forgets the slices that were met in one step only."""
        keep = np.flatnonzero(self.again)
        slices = list(self.known)  # a dict keeps the order of the slots
        slices = [slices[k] for k in keep.tolist()]
        points = sum(map(len, slices))
        if len(keep) > CACHE_SLICES // 2 or points > CACHE_POINTS // 2:
            return self.clear()
        count = self.count[keep]
        total = np.cumsum(count) - count
        self.flat = self.flat[np.repeat(self.first[keep] - total, count) + np.arange(count.sum())]
        self.first, self.count, self.again = total, count, np.zeros(len(keep), bool)
        self.known, self.points = dict(zip(slices, range(len(keep)), strict=True)), points

    def add(self, slices: list[str]) -> None:
        ids, count = self.encode_slices(slices)
        self.known.update(zip(slices, range(len(self.count), len(self.count) + len(count)), strict=True))
        self.points += sum(map(len, slices))
        self.first = np.r_[self.first, len(self.flat) + np.cumsum(count) - count]
        self.count = np.r_[self.count, count]
        self.flat = np.r_[self.flat, ids.astype(np.int32)]
        self.again = np.r_[self.again, np.zeros(len(count), bool)]

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, index of each text's first id and one more, code point in the step at which each id's slice starts)."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
        text = raw.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(points) == len(raw):
            at = offsets
        else:
            heads = np.zeros(len(raw) + 1, np.int64)
            np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
            at = heads[offsets]
        starts = slice_starts(symbols(points, at))
        ends = np.r_[starts[1:], len(points)]
        codes, example = distinct_slices(text, points, starts, ends)
        if len(self.known) > CACHE_SLICES or self.points > CACHE_POINTS:
            self.make_room()
        listed = [text[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
        where = np.fromiter(map(self.known.get, listed, repeat(-1)), np.int64, len(listed))
        new = np.flatnonzero(where < 0)
        self.again[where[where >= 0]] = True
        if len(new):
            self.add([listed[i] for i in new.tolist()])
            where[new] = np.arange(len(self.count) - len(new), len(self.count))
        slot = where[codes]
        count = self.count[slot]
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        ids = self.flat[np.repeat(self.first[slot] - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, at)], np.repeat(starts, count)


def distinct_slices(text: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which distinct slice each slice is, a slice that is an example of each). Slices tile the step.

    Hashes propose which slices are equal; every slice is then held against its example, code point by code point.
    """
    codes, unique = pd.factorize(slice_hashes(points, starts, ends))
    example = np.zeros(len(unique), np.int64)
    example[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    size, of = ends - starts, example[codes]
    alike = np.array_equal(size, size[of]) and np.array_equal(points, points[np.repeat(starts[of] - starts, size) + np.arange(len(points))])
    if not alike:
        codes, _ = pd.factorize(np.array([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], object))
        example = np.zeros(codes.max() + 1, np.int64)
        example[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, example


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def coder(path: str) -> SliceCoder:
    return SliceCoder(Merges(read_ranks(path)).strings)


@cache
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all tokens' bytes end to end, start of each id's bytes, their number)."""
    ranks = read_ranks(path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    size = np.array([len(b) for b in by_id], np.int64)
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(size) - size, size


def decode_ids(path: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, index of each id's first byte and one more)."""
    data, first, size = vocabulary(path)
    count = size[ids]
    total = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(count, out=total[1:])
    return data[np.repeat(first[ids] - total[:-1], count) + np.arange(total[-1])], total


def _rows(batches: Iterator[pa.RecordBatch], column: str, schema: list[str], encode, offsets: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, raw, at in text_steps(batch.column(column)):
            ids, first, starts = encode(raw, at)
            made = {"ids": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))}
            if offsets:
                base = np.searchsorted(first, np.arange(len(ids)), "right") - 1
                heads = np.zeros(len(raw) + 1, np.int64)
                np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
                made["id_starts"] = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(starts - heads[at][base], pa.int32()))
            part = batch.slice(row, end - row)
            yield pa.RecordBatch.from_arrays([made[c] if c in made else part.column(c) for c in schema], names=schema)


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), offsets: bool = False) -> DataFrame:
    """ids array<int> of every whole text by the ranks in `path`; with offsets also id_starts, the code point at which each id's slice starts."""
    keep = tuple(c for c in keep if c not in ("ids", "id_starts"))
    read = docs.select(*dict.fromkeys([*keep, text_col]))
    fields = [read.schema[c] for c in keep] + [T.StructField(c, T.ArrayType(T.IntegerType(), False), False) for c in ("ids", "id_starts")[: 1 + offsets]]
    names = [f.name for f in fields]
    return read.mapInArrow(lambda batches: _rows(batches, text_col, names, coder(path), offsets), T.StructType(fields))


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """decoded binary: the bytes of each row's ids."""
    keep = tuple(c for c in keep if c != "decoded")
    read = encoded.select(*dict.fromkeys([*keep, "ids"]))
    names = [*keep, "decoded"]

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            for row in range(0, len(lists), 512):
                part = batch.slice(row, 512)
                own = part.column("ids")
                at = np.asarray(own.offsets, np.int64)
                ids = np.asarray(own.values)[at[0] : at[-1]]
                raw, total = decode_ids(path, ids)
                made = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(total[at - at[0]].astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([made if c == "decoded" else part.column(c) for c in names], names=names)

    return read.mapInArrow(run, T.StructType([*(read.schema[c] for c in keep), T.StructField("decoded", T.BinaryType(), False)]))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns, from the ids and the bytes they decode to."""
    ids = encode(docs, path).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"))
    kept = ("doc_id", "n_tokens", "ids_sha256")
    return decode(ids, path, kept).select(*kept, F.sha2("decoded", 256).alias("decoded_sha256"))
