"""Token-ID files with keyed access (operator 9).

A shard holds, end to end: the raw ids (little-endian, two bytes each while the vocabulary allows, else four), a record table in
key order (key, first id, number of ids), a minimal perfect hash over the distinct keys, and a footer that says where each part
lies. The hash is a cascade of bit arrays: a key sits on the first level where no other remaining key shares its bit, and the rank
of that bit is its slot; a slot stores the key's fingerprint and its record. Bits lie in blocks of 64 bytes, and the bits set before
each block are stored, so a lookup reads a block a level (two on average), one number, one fingerprint, one record and the ids, each
at its place in the file, however large the shard is. Shards follow each other by key range, so a key finds its shard from the
manifest alone.

Executors write each shard under a name of its own into the shared folder; only files that the manifest names count, so a task run
twice leaves no trace in the result.

Defined results: null text counts as empty (only the end id is written); a null key sorts first and is stored without an index
entry; rows with equal keys are all written, ordered by text, and the index leads to the first; an empty table gives no shard; very
long texts are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import atexit
import os
import re
import uuid
import zlib
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SliceCoder
from .common import delete, mixed, saved, shared_dir, shuffle_parts, text_steps

MAGIC = b"TALLYID1"
GAMMA = 2.0
LEVELS = 64
SLICES_AT_ONCE = 200
#: White space within a slice, and white space that a slice may begin with beside a space.
_WHITE = re.compile(r"[\s\x85\u200b]")
_WHITE_FIRST = frozenset("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200C))))
NULL_KEY = -(1 << 63)
#: A record, and the bytes of the footer: five numbers and MAGIC.
RECORD, FOOTER = np.dtype([("key", "<i8"), ("start", "<u8"), ("count", "<u8")]), 48
MANIFEST = "shard int, path string, n_docs long, n_ids long, first_key long, last_key long"


@cache
def coder(path: str) -> SliceCoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    newline = t.encode("\n", add_special_tokens=False).ids
    letter = {v: k for k, v in t.get_vocab(with_added_tokens=False).items()}
    space = letter[t.encode(" ", add_special_tokens=False).ids[0]][0]
    opens = np.zeros(max(letter) + 1, bool)
    opens[[k for k, v in letter.items() if v[0] == space]] = True

    def joined(slices: list[str], mark: str, heads: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Slices encoded some hundred at a time as one text; they end with the mark, or each begins with an id in heads."""
        texts = [mark.join([*slices[k : k + SLICES_AT_ONCE], ""]) for k in range(0, len(slices), SLICES_AT_ONCE)]
        ids = np.concatenate([np.array(e.ids, np.int64) for e in t.encode_batch_fast(texts, add_special_tokens=False)])
        if heads is not None:
            count = np.diff(np.r_[np.flatnonzero(heads[ids]), len(ids)])
        else:
            count = np.diff(np.r_[-1, np.flatnonzero(ids == newline[0])]) - 1
            ids = ids[ids != newline[0]]
        if len(count) != len(slices):
            raise ValueError(f"{len(slices)} slices gave {len(count)}")
        return ids, count

    def encode(slices: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slices of a space and no other white space follow each other as they are, those without any stand on lines; the rest go one by one."""
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        for k, s in enumerate(slices):
            odd = len(newline) != 1 or s[0] in _WHITE_FIRST or s == " " or (not s[1:].isalpha() and _WHITE.search(s, 1))
            kinds[2 if odd else 0 if s[0] == " " else 1].append(k)
        ids, order, count = [], [], []
        for which, (mark, heads) in enumerate((("", opens), ("\n", None))):
            if kinds[which]:
                i, c = joined([slices[k] for k in kinds[which]], mark, heads)
                ids.append(i)
                count.append(c)
                order += kinds[which]
        for k in kinds[2]:
            ids.append(np.array(t.encode(slices[k], add_special_tokens=False).ids, np.int64))
            count.append(np.array([len(ids[-1])]))
            order.append(k)
        ids, count, order = np.concatenate(ids), np.concatenate(count), np.array(order)
        if len(order) == len(kinds[0]):
            return ids, count
        owner = np.repeat(order, count)
        return ids[np.argsort(owner, kind="stable")], count[np.argsort(order)]

    return SliceCoder(encode)


@cache
def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def file_system(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(keys.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_level_hash(keys, 1000) >> np.uint64(32)).astype(np.uint32)


BLOCK_BITS = 512


class PerfectHash:
    """Slots 0..n-1 for n distinct int64 keys."""

    def __init__(self, sizes: list[int], blocks: np.ndarray, ranks: np.ndarray):
        """Bits of each level; all levels' blocks of bytes; the bits set before each block."""
        self.sizes, self.blocks, self.ranks = sizes, blocks, ranks
        self.first_block = first_blocks(sizes)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, packed = [], [np.zeros((0, BLOCK_BITS // 8), np.uint8)]
        while len(keys):
            if len(sizes) == LEVELS:
                raise ValueError("keys for a perfect hash must be distinct")
            size = max(64, int(GAMMA * len(keys)))
            at = (_level_hash(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.zeros(-(-size // BLOCK_BITS) * BLOCK_BITS, bool)
            alone[:size] = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            packed.append(np.packbits(alone, bitorder="little").reshape(-1, BLOCK_BITS // 8))
            keys = keys[~alone[at]]
        blocks = np.concatenate(packed)
        count = np.bitwise_count(blocks).sum(1, dtype=np.uint64)
        return cls(sizes, blocks, np.cumsum(count) - count)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that was not built in, some slot or -1."""
        slot = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, size in enumerate(self.sizes):
            at = (_level_hash(keys[left], k) % np.uint64(size)).astype(np.int64)
            own = self.blocks[self.first_block[k] + at // BLOCK_BITS]
            before = np.arange(BLOCK_BITS // 8) * 8
            bit = at % BLOCK_BITS
            hit = (own[np.arange(len(at)), bit // 8] >> (bit % 8).astype(np.uint8) & 1).astype(bool)
            # bits of the block below this one: whole bytes, then a part of one
            whole = np.where(before[None, :] + 8 <= bit[:, None], np.bitwise_count(own), 0).sum(1)
            part = np.bitwise_count(own[np.arange(len(at)), bit // 8] & ((1 << bit % 8) - 1).astype(np.uint8))
            slot[left[hit]] = (self.ranks[self.first_block[k] + at // BLOCK_BITS].astype(np.int64) + whole + part)[hit]
            left = left[~hit]
        return slot


def first_blocks(sizes: list[int]) -> list[int]:
    return [0, *np.cumsum([-(-s // BLOCK_BITS) for s in sizes]).tolist()]


def _write_shard(batches, root: str, shard: int, path: str, end_id: int):
    code, wide = coder(path), vocabulary_size(path) > 1 << 16
    width = np.dtype("<u4" if wide else "<u2")
    sink = uri = None
    keys, counts = [], []
    for batch in batches:
        if not len(batch):
            continue
        if sink is None:
            uri = f"{root}/part-{shard:05d}-{uuid.uuid4().hex}.ids"
            where, name = file_system(uri)
            where.create_dir(name.rpartition("/")[0], recursive=True)
            sink = where.open_output_stream(name)
        keys.append(np.asarray(batch.column(0).fill_null(NULL_KEY), np.int64))
        for _, _, raw, at in text_steps(batch.column(1)):
            ids, first, _ = code(raw, at)
            sink.write(np.insert(ids, first[1:], end_id).astype(width).tobytes())
            counts.append(np.diff(first) + 1)
    if sink is None:
        return None
    key, count = np.concatenate(keys), np.concatenate(counts)
    start = np.cumsum(count) - count
    distinct, record = np.unique(key, return_index=True)
    if distinct[0] == NULL_KEY:
        distinct, record = distinct[1:], record[1:]
    index = PerfectHash.build(distinct)
    slot = index(distinct)
    prints, records = np.zeros(len(slot), "<u4"), np.zeros(len(slot), "<u8")
    prints[slot], records[slot] = fingerprints(distinct), record
    parts = [np.rec.fromarrays([key, start, count], RECORD).tobytes(), prints.tobytes(), records.tobytes(), index.blocks.tobytes(), index.ranks.astype("<u8").tobytes(), np.array(index.sizes, "<u8").tobytes()]
    for p in parts:
        sink.write(p)
    n_ids = int(count.sum())
    sink.write(np.array([width.itemsize, n_ids, len(key), len(slot), len(index.sizes)], "<u8").tobytes() + MAGIC)
    sink.close()
    return uri, len(key), n_ids, int(key[0]), int(key[-1])


class Shard:
    """One shard, opened for reading: only the footer is read before something is asked."""

    def __init__(self, uri: str):
        where, name = file_system(uri)
        self.uri, self.file = uri, where.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(min(size, 8 * LEVELS + FOOTER), max(0, size - 8 * LEVELS - FOOTER))
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{uri} is no shard of token ids")
        width, self.n_ids, self.n, self.slots, levels = (int(x) for x in np.frombuffer(tail[-FOOTER : -len(MAGIC)], "<u8"))
        self.width = np.dtype(f"<u{width}")
        self.sizes = np.frombuffer(tail, "<u8", levels, len(tail) - FOOTER - 8 * levels).tolist()
        self.first_block = first_blocks(self.sizes)
        blocks = self.first_block[-1]
        self.at = dict(zip(("records", "prints", "slots", "blocks", "ranks"), np.cumsum([width * self.n_ids, RECORD.itemsize * self.n, 4 * self.slots, 8 * self.slots, BLOCK_BITS // 8 * blocks]).tolist(), strict=True))

    def _read(self, part: str, kind, first: int, count: int = 1) -> np.ndarray:
        kind = np.dtype(kind)
        return np.frombuffer(self.file.read_at(count * kind.itemsize, self.at[part] + first * kind.itemsize), kind)

    def find(self, key: int) -> np.void | None:
        """The record (key, start, count) of a key, None where no level, or else the stored fingerprint or key, has it."""
        one = np.array([key], np.int64)
        for k, size in enumerate(self.sizes):
            bit = int(_level_hash(one, k)[0] % np.uint64(size))
            block = self.first_block[k] + bit // BLOCK_BITS
            bits = int.from_bytes(self._read("blocks", "u1", block * (BLOCK_BITS // 8), BLOCK_BITS // 8).tobytes(), "little")
            if bits >> bit % BLOCK_BITS & 1:
                slot = int(self._read("ranks", "<u8", block)[0]) + (bits & (1 << bit % BLOCK_BITS) - 1).bit_count()
                if self._read("prints", "<u4", slot)[0] != fingerprints(one)[0]:
                    return None
                record = self._read("records", RECORD, int(self._read("slots", "<u8", slot)[0]))[0]
                return record if record["key"] == key else None
        return None

    def ids(self, record: np.void) -> np.ndarray:
        w = self.width.itemsize
        return np.frombuffer(self.file.read_at(int(record["count"]) * w, int(record["start"]) * w), self.width)

    def records(self) -> np.ndarray:
        """All records, each as the index leads to it; those of null and repeated keys, which it leaves out, by position."""
        stored = self._read("records", RECORD, 0, self.n)
        key, blocks = stored["key"].astype(np.int64), self.first_block[-1]
        index = PerfectHash(self.sizes, self._read("blocks", "u1", 0, blocks * BLOCK_BITS // 8).reshape(-1, BLOCK_BITS // 8), self._read("ranks", "<u8", 0, blocks))
        lone = ~(np.r_[False, key[1:] == key[:-1]] | (key == NULL_KEY))
        own = np.arange(self.n)
        if lone.any():
            slot = index(key[lone])
            record = self._read("slots", "<u8", 0, self.slots).astype(np.int64)[slot]
            if (slot < 0).any() or (self._read("prints", "<u4", 0, self.slots)[slot] != fingerprints(key[lone])).any() or (key[record] != key[lone]).any():
                raise ValueError(f"{self.uri}: the index misses a key")
            own[lone] = record
        return stored[own]


@lru_cache(8)
def opened(uri: str) -> Shard:
    return Shard(uri)


def write(docs: DataFrame, path: str, end_id: int = 2, root: str | None = None, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents in ascending key order and returns the manifest: shard, path, n_docs, n_ids, first_key, last_key.

    Without a root the files lie in the shared folder and go when the program ends.
    """
    spark = docs.sparkSession
    if root is None:
        root = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
        atexit.register(delete, spark, root)
    n = shuffle_parts(spark)

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        if made := _write_shard(batches, root, shard, path, end_id):
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, *made)], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())]))

    rows = docs.select(F.col(key_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(n, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    return saved(ordered.mapInArrow(run, MANIFEST), "ids-manifest")


def with_base(manifest: DataFrame) -> DataFrame:
    """Adds base: the ids in all shards before. The manifest has a row for each partition, so one task may order it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, ids of every record of every shard, each reached through the index (null and repeated keys by position)."""

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(uri)
                records = shard.records()
                for a in range(0, len(records), 256):
                    own = records[a : a + 256]
                    lists = [shard.ids(r).astype(np.int32) for r in own]
                    first = np.r_[0, np.cumsum([len(x) for x in lists])]
                    key = own["key"].astype(np.int64)
                    start = own["start"].astype(np.int64) + base
                    yield pa.RecordBatch.from_arrays([pa.array(key, mask=key == NULL_KEY), pa.array(start), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.concatenate(lists), pa.int32()))], names=["doc_id", "start", "ids"])

    n = shuffle_parts(manifest.sparkSession)
    return with_base(manifest).repartition(n, "shard").mapInArrow(run, "doc_id long, start long, ids array<int>")


def lookup(manifest: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """ids of the keys asked for (null where no shard has the key), by manifest range, then index."""
    spans = manifest.select("path", "first_key", "last_key")  # a row for each partition of the writing
    asked = keys.select(F.col(key_col).cast("long").alias("doc_id"))
    routed = asked.join(F.broadcast(spans), F.col("doc_id").between(F.col("first_key"), F.col("last_key")), "left").select("doc_id", "path")

    def run(batches):
        for batch in batches:
            key = np.asarray(batch.column("doc_id").fill_null(NULL_KEY), np.int64)
            out = []
            for k, uri in zip(key, batch.column("path").to_pylist(), strict=True):
                r = opened(uri).find(int(k)) if uri else None
                out.append(opened(uri).ids(r).astype(np.int32) if r is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return routed.repartition(shuffle_parts(keys.sparkSession), "path").mapInArrow(run, "doc_id long, ids array<int>")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns, from what the files give back."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            at, values = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4")
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(write(docs, path)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
