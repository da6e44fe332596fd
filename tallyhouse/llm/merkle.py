"""Document fingerprints (operator 4): a Merkle tree over paragraphs and sections.

A text is cut, without gaps, into paragraphs (lines) and those into sections (at blank lines, and where a paragraph's hash says so, so
that an edit moves no boundary far from it). A paragraph's hash is a cryptographic one of its bytes, a section's covers its
paragraphs' hashes, the root all sections'. Below, each paragraph is cut by content into leaves of a few words with hashes of 64 bits,
which tell how much of two differing paragraphs is the same.

The fingerprint string is the tree without most of its leaves: root, sections with their numbers of paragraphs, paragraphs with their
numbers of leaves, and a sample of the leaves, those whose hash ends in as many zero bits as leave SAMPLED of them at most. Equal roots
mean equal texts. Where roots differ, likeness() descends: equal sections count in full and are not looked into, then equal paragraphs
of the sections left; of the paragraphs left after that the sampled leaves in common are counted and stand for all. A text of SAMPLED
leaves (some 1,600 characters) or fewer keeps them all, so its likeness is exact; of longer ones the part of the likeness that comes from
leaves has a standard error of at most about 1 / sqrt(2 SAMPLED), 0.06, where all leaves are left over. differing() locates edits from
trees of both texts, down to leaves.

Neighbours in descending doc_id are found without ordering all rows in one place: doc_id is cut into ranges of like size, every
range is a task of its own and sorted there, and the first row of the next range is copied in as the last row's neighbour.

Defined results: null counts as empty; empty texts have the fingerprint of no leaves; rows that repeat a doc_id are ordered by text
and are each other's neighbours; null doc_ids come last; a table of one row has itself as neighbour; an empty table gives an empty
result; very long texts are hashed whole; other columns are ignored. Rows of one doc_id, and those of none, are one range: an id is
taken to name few rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, slice_hashes, word_slices

#: Mean words in a leaf and mean paragraphs in a section (powers of two), and the most words in a leaf.
LEAF_WORDS, SECTION_PARAGRAPHS, MOST_WORDS = 2, 8, 8
STEP_CHARS = 1 << 19
#: Bytes of a section's, a paragraph's and a leaf's hash in the fingerprint string; the tree itself is built from DIGEST bytes.
SHOWN, SHOWN_PARAGRAPH, SHOWN_LEAF, DIGEST = 8, 5, 5, 16
#: Leaves in a fingerprint at most.
SAMPLED = 128


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


class Tree:
    """One text's tree: the root, section and paragraph hashes with the number of children of each, and the leaves' 64-bit hashes.

    leaves, and leaf_at, their byte offsets and at last the text's size, are None in a tree read from a fingerprint. level, sample and
    paragraph_sample are what the fingerprint holds of the leaves: how many zero bits were asked for, the ends of the hashes that have
    them, in order, and how many of those each paragraph has.
    """

    __slots__ = ("leaf_at", "leaves", "level", "paragraph_leaves", "paragraph_sample", "paragraphs", "root", "sample", "section_paragraphs", "sections")

    @classmethod
    def of(cls, text: bytes, leaves: np.ndarray, leaf_at: list[int], heads: list[int], blank: list[bool]) -> Tree:
        """heads: which leaves open a paragraph; blank: whether a blank line goes before it."""
        tree = cls()
        tree.leaves, tree.leaf_at = leaves, [*leaf_at, len(text)]
        bounds = [*heads, len(leaves)]
        digests = [_digest(text[tree.leaf_at[a] : tree.leaf_at[b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        tree.paragraph_leaves = [b - a for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        sections, tree.section_paragraphs, start = [], [], 0
        for k, d in enumerate(digests):
            if k + 1 == len(digests) or d[0] % SECTION_PARAGRAPHS == 0 or blank[k + 1]:
                sections.append(_digest(b"".join(digests[start : k + 1])))
                tree.section_paragraphs.append(k + 1 - start)
                start = k + 1
        tree.root = _digest(b"".join(sections)).hex()
        tree.sections, tree.paragraphs = [d[:SHOWN] for d in sections], [d[:SHOWN_PARAGRAPH] for d in digests]
        ends = leaves & np.uint64((1 << 8 * SHOWN_LEAF) - 1)
        tree.level = 0
        held = np.ones(len(leaves), bool)
        while held.sum() > SAMPLED and tree.level < 8 * SHOWN_LEAF:
            tree.level += 1
            held = ends & np.uint64((1 << tree.level) - 1) == 0
        tree.sample = ends[held]
        inside = np.r_[0, held.cumsum()]
        tree.paragraph_sample = np.diff(inside[bounds]).tolist() if len(leaves) else []
        return tree

    @classmethod
    def read(cls, fingerprint: str) -> Tree:
        tree = cls()
        tree.root, sections, paragraphs, level, leaves = fingerprint.split(".")
        own = [x.split(":") for x in sections.split("-")] if sections else []
        tree.sections, tree.section_paragraphs = [bytes.fromhex(d) for d, _ in own], [int(n) for _, n in own]
        own = [x.split(":") for x in paragraphs.split("-")] if paragraphs else []
        tree.paragraphs, tree.paragraph_leaves = [bytes.fromhex(x[0]) for x in own], [int(x[1]) for x in own]
        tree.paragraph_sample = [int(x[2]) if len(x) > 2 else 0 for x in own]
        size = 2 * SHOWN_LEAF
        tree.level, tree.sample = int(level), np.array([int(leaves[k : k + size], 16) for k in range(0, len(leaves), size)], np.uint64)
        tree.leaves = tree.leaf_at = None
        return tree

    @property
    def fingerprint(self) -> str:
        sections = "-".join(f"{d.hex()}:{n}" for d, n in zip(self.sections, self.section_paragraphs, strict=True))
        paragraphs = "-".join(f"{d.hex()}:{n}" + (f":{k}" if k else "") for d, n, k in zip(self.paragraphs, self.paragraph_leaves, self.paragraph_sample, strict=True))
        leaves = self.sample.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - SHOWN_LEAF :].tobytes().hex()
        return f"{self.root}.{sections}.{paragraphs}.{self.level}.{leaves}"


def trees(texts: list[bytes]) -> list[Tree]:
    """The trees of all texts of one step."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    starts, ends, first = word_slices(raw, offsets)
    words = slice_hashes(raw, starts, ends)
    newlines = np.r_[0, np.cumsum(raw == 10)]
    lines = np.zeros(len(starts), np.int64)  # newlines between a word and the one before it
    lines[1:] = newlines[starts[1:]] - newlines[ends[:-1]]
    opens = np.r_[True, words[:-1] % np.uint64(LEAF_WORDS) == 0][: len(starts)]
    opens |= lines > 0
    opens[first[:-1][np.diff(first) > 0]] = True
    # a leaf that runs on is cut after MOST_WORDS words
    at = np.flatnonzero(opens)
    run = np.arange(len(starts)) - np.repeat(at, np.diff(np.r_[at, len(starts)]))
    opens |= (run > 0) & (run % MOST_WORDS == 0)
    at = np.flatnonzero(opens)
    begin = starts[at]
    leaf_first = np.searchsorted(at, first)
    # a text's first leaf begins with the text; a text of white space alone is one leaf
    some = np.diff(leaf_first) > 0
    begin[leaf_first[:-1][some]] = offsets[:-1][some]
    bare = np.flatnonzero(~some & (np.diff(offsets) > 0))
    everywhere = np.sort(np.r_[begin, offsets[bare]])
    leaf_first = np.searchsorted(everywhere, offsets)
    leaves = slice_hashes(raw, everywhere, np.r_[everywhere[1:], len(raw)])
    kind = np.zeros(len(everywhere), np.int64)
    kind[np.searchsorted(everywhere, begin)] = lines[at]
    out = []
    for text, offset, a, b in zip(texts, offsets[:-1].tolist(), leaf_first[:-1].tolist(), leaf_first[1:].tolist(), strict=True):
        opened = kind[a:b] > 0
        opened[:1] = True
        heads = np.flatnonzero(opened)
        out.append(Tree.of(text, leaves[a:b], (everywhere[a:b] - offset).tolist(), heads.tolist(), (kind[a:b][heads] > 1).tolist()))
    return out


def _left_over(one: list[bytes], two: list[bytes], sizes: list[int]) -> tuple[list[bool], list[bool], int]:
    """Which children of each side find no equal one on the other, and the sizes of those of one that do."""
    free = Counter(two)
    left, taken, size = [], Counter(), 0
    for d, n in zip(one, sizes, strict=True):
        if free[d] > taken[d]:
            taken[d] += 1
            size += n
            left.append(False)
        else:
            left.append(True)
    rest = []
    for d in two:
        rest.append(not taken[d])
        taken[d] -= not rest[-1]
    return left, rest, size


def likeness(one: Tree | str, two: Tree | str) -> float:
    """1 for equal roots, else twice the leaves in common over the leaves of both, found by descending where hashes differ and, below
    paragraphs, estimated from the sampled leaves."""
    a, b = (Tree.read(x) if isinstance(x, str) else x for x in (one, two))
    if a.root == b.root:
        return 1.0
    total = [sum(t.paragraph_leaves) for t in (a, b)]
    if not all(total):
        return 0.0
    inside = [list(accumulate(t.section_paragraphs, initial=0)) for t in (a, b)]
    weight = [sum(a.paragraph_leaves[i:j]) for i, j in zip(inside[0][:-1], inside[0][1:], strict=True)]
    *left, same = _left_over(a.sections, b.sections, weight)
    open_ = [[p for k, out in enumerate(own) if out for p in range(i[k], i[k + 1])] for own, i in zip(left, inside, strict=True)]
    *left, more = _left_over([a.paragraphs[p] for p in open_[0]], [b.paragraphs[p] for p in open_[1]], [a.paragraph_leaves[p] for p in open_[0]])
    same += more
    level = max(a.level, b.level)
    loose, rest = [], []
    for t, own, which in zip((a, b), left, open_, strict=True):
        out = [p for p, is_out in zip(which, own, strict=True) if is_out]
        mask = np.zeros(len(t.paragraphs), bool)
        mask[out] = True
        held = t.sample[np.repeat(mask, t.paragraph_sample)]
        loose.append(held[held & np.uint64((1 << level) - 1) == 0])  # the coarser of both samples
        rest.append(sum(t.paragraph_leaves[p] for p in out))
    if len(loose[0]) and len(loose[1]):
        (ux, cx), (uy, cy) = (np.unique(x, return_counts=True) for x in loose)
        at = np.minimum(np.searchsorted(ux, uy), len(ux) - 1)
        found = int(np.where(ux[at] == uy, np.minimum(cx[at], cy), 0).sum())
        # as many of the leaves left over as of those sampled; all are sampled at level 0
        same += min(2 * found / (len(loose[0]) + len(loose[1])) * sum(rest) / 2 if level else found, *rest)
    return min(1.0, 2 * same / sum(total))


def _gaps(a: list, b: list) -> list[tuple[int, int, int, int]]:
    """(from, to) in a and in b of the runs that differ: what lies between equal ends and what occurs once on both sides in like order."""
    where = {x: k for k, x in enumerate(b)}
    twice = {x for side in (a, b) for x, n in Counter(side).items() if n > 1}
    anchors = [(i, where[x]) for i, x in enumerate(a) if x in where and x not in twice]
    # the longest run of anchors that rises in b as well
    tails, ends, back = [], [], []
    for k, (_, j) in enumerate(anchors):
        at = bisect_left(tails, j)
        back.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [j], [k]
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(anchors[k])
        k = back[k]
    out, i, j = [], 0, 0
    for x, y in [*reversed(chain), (len(a), len(b))]:
        p, q = x, y
        while i < p and j < q and a[i] == b[j]:
            i, j = i + 1, j + 1
        while i < p and j < q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
        if i < p or j < q:
            out.append((i, p, j, q))
        i, j = x + 1, y + 1
    return out


def differing(one: Tree, two: Tree) -> list[tuple[int, int]]:
    """Byte ranges of two's text that an edit of one's explains: sections that differ, in those paragraphs, in those leaves.

    Where something was only taken out, the range is empty and says where. `two` must have been built from its text.
    """
    if one.root == two.root:
        return []
    sections, leaves = ([list(accumulate(sizes, initial=0)) for sizes in pair] for pair in ((one.section_paragraphs, two.section_paragraphs), (one.paragraph_leaves, two.paragraph_leaves)))
    x, y = one.leaves.tolist(), two.leaves.tolist()
    out = []
    for a, b, c, d in _gaps(one.sections, two.sections):
        a, b, c, d = sections[0][a], sections[0][b], sections[1][c], sections[1][d]
        for e, f, g, h in _gaps(one.paragraphs[a:b], two.paragraphs[c:d]):
            e, f, g, h = leaves[0][a + e], leaves[0][a + f], leaves[1][c + g], leaves[1][c + h]
            out += [(two.leaf_at[g + j], two.leaf_at[g + k]) for _, _, j, k in _gaps(x[e:f], y[g:h])]
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """key and fingerprint of every whole text."""
    read = docs.select(key_col, text_col)

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            out = []
            for a, b in _steps(texts):
                out += [t.fingerprint for t in trees(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key_col, "fingerprint"])

    from pyspark.sql import types as T

    return read.mapInArrow(run, T.StructType([read.schema[key_col], T.StructField("fingerprint", T.StringType(), False)]))


def _steps(texts: list):
    a = size = 0
    for b, t in enumerate(texts):
        if size and size + len(t) > STEP_CHARS:
            yield a, b
            a, size = b, 0
        size += len(t)
    if texts:
        yield a, len(texts)


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, copy, doc_id, text: ranges of doc_id, each in descending order and followed by the next range's first rows (copy)."""
    spark = docs.sparkSession
    n = shuffle_parts(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = rows.stat.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (8 * n)) if n > 1 else []
    cuts = sorted(set(map(int, cuts or [])))
    # the number of cuts at or below doc_id, by a balanced tree of comparisons
    def place(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < cuts[mid], place(lo, mid)).otherwise(place(mid + 1, hi))

    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place(0, len(cuts)))
    placed = rows.select(bucket.alias("bucket"), "doc_id", "text")
    heads = {r.bucket: r.head for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}  # a row for each range
    order = sorted(heads, reverse=True)
    moved = [(order[k - 1], b, heads[b]) for k, b in enumerate(order)]  # the first range's head follows the last range
    if not moved:
        return placed.withColumn("copy", F.lit(False))
    ghosts = spark.createDataFrame(moved, "to int, bucket int, head long")
    copies = placed.join(F.broadcast(ghosts), (placed.bucket == ghosts.bucket) & placed.doc_id.eqNullSafe(ghosts["head"])).select(F.col("to").alias("bucket"), "doc_id", "text", F.lit(True).alias("copy"))
    everything = placed.withColumn("copy", F.lit(False)).unionByName(copies)
    return everything.repartitionById(len(cuts) + 2, F.col("bucket") + 1).sortWithinPartitions("bucket", "copy", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """The contract's columns."""

    def answer(rows: list[tuple]):
        """rows: (doc_id, text, next text)"""
        for a, b in _steps([r[1] for r in rows]):
            own = rows[a:b]
            edited, texts, nexts = [], [], []
            for _, text, after in own:
                cut = len(text) // 3
                edited.append((text[: len(text) - cut] + after[:cut]).encode())
                texts.append(text.encode())
                nexts.append(after.encode())
            # a text's neighbour is most often the next text of the step
            chained = [k for k in range(len(own)) if k + 1 == len(own) or nexts[k] != texts[k + 1]]
            made = trees(texts + [nexts[k] for k in chained])
            other = dict(zip(chained, made[len(own) :], strict=True))
            changed = trees(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in own], pa.int64()),
                    pa.array([len(r[1]) for r in own], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                    pa.array([t.fingerprint for t in made[: len(own)]]),
                    pa.array([t.fingerprint for t in changed]),
                    pa.array([likeness(t, c) for t, c in zip(made, changed, strict=False)]),
                    pa.array([likeness(made[k], other.get(k) or made[k + 1]) for k in range(len(own))]),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    def run(batches):
        bucket = held = None  # held: the row that waits for its neighbour
        for batch in batches:
            ready, size = [], 0
            for b, copied, key, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "copy", "doc_id", "text")), strict=True):
                text = text or ""
                if held is not None and b == bucket:
                    ready.append((*held, text))
                    size += len(text)
                held, bucket = None if copied else (key, text), b
                if size > STEP_CHARS:
                    yield from answer(ready)
                    ready, size = [], 0
            if ready:
                yield from answer(ready)

    return with_next(docs).select("bucket", "copy", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
