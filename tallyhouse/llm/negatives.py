"""Hard-negative mining by blocked dense matrix products (operator 12).

Anchors meet all candidates in blocks: a group of anchors of a bounded size (ANCHOR_BYTES) is broadcast, every task multiplies it, block
by block, with its own candidates in blocks of CANDIDATES rows, and keeps for each anchor only the best so far. Such a state (a few
numbers an anchor) merges with any other in any order, so tasks give theirs once, at their end, and a window over the tasks' states
picks the result. The first pass finds each anchor's positives, the second, for each positive, the negatives whose score lies in the
window that the positive's score sets. More anchors than a group holds take more rounds, each a job of its own whose result is written;
an executor lost costs its tasks.

Scores are exact: the components are whole numbers, and where dimension times the greatest products stays below 2^53 they are summed in
float64 by a matrix product; a block beyond that is summed in Python's integers, and what leaves 64 bits is set to their end. Within a
block candidates stand in the order of their ids, so that score and place make one number, whose order is the result's; it is again
exact below 2^53, and a stable sort serves beyond.

Defined results: rows with a null label, a null vector or a null or non-finite component (or one whose scaled value is) take no part, nor do rows without a vec_id,
which couldn't be named. Vectors of another length than the anchor's have no product with it and are passed over. Rows that repeat a
vec_id are candidates each; a candidate with the anchor's own vec_id is never its positive or negative; an anchor row that repeats in
full counts once, one that repeats its vec_id alone is an anchor of its own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, saved

#: Bytes of anchors, as float64, that are broadcast at once.
ANCHOR_BYTES = 32 << 20
#: Rows of a block of anchors and of candidates; their product, in float64, is 32 MB.
ANCHORS, CANDIDATES = 1024, 4096
SCALE = 256
EXACT = 1 << 53
ENDS = (1 << 63) - 1


def relabelled(vectors: DataFrame, every: int = 7, kinds: int = 10) -> DataFrame:
    """The table with noisy labels, as the registered query takes it."""
    label = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % kinds).otherwise(F.col("label"))
    return vectors.select("vec_id", label.alias("label"), "embedding")


def usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """id, label, x of the rows that take part."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * SCALE) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))


class Anchors:
    """A group of anchors of one dimension, in rows: key (the anchor's number), id, label, x (whole numbers)."""

    def __init__(self, key, ids, label, x):
        self.key, self.id, self.label, self.x = key, ids, label, x
        self.most = float(np.abs(x).max(initial=0.0))


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(x * SCALE)


def products(a: np.ndarray, a_most: float, c: np.ndarray) -> np.ndarray:
    """a @ c.T, exact: float64 where every sum stays below 2^53, else integers as Python objects within 64 bits."""
    if a.shape[1] * a_most * float(np.abs(c).max(initial=0.0)) < EXACT:
        return a @ c.T
    to_int = np.frompyfunc(int, 1, 1)
    held = np.frompyfunc(lambda v: min(max(v, -ENDS), ENDS), 1, 1)
    one, two = to_int(a), to_int(c)
    return held(np.stack([(row[None, :] * two).sum(1) for row in one])) if len(a) and len(c) else np.zeros((len(a), len(c)), object)


def blocks(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and whole vectors of the candidates, by length of the vector, in blocks of CANDIDATES rows in the order of their ids."""
    held: dict[int, list] = {}

    def made(parts):
        i, lab, x = (np.concatenate(p) for p in zip(*parts, strict=True))
        o = np.argsort(i, kind="stable")
        return i[o], lab[o], x[o]

    for batch in batches:
        column = batch.column("x")
        lengths = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy(zero_copy_only=False)
        starts = np.r_[0, lengths.cumsum()]
        i, lab = batch.column("id").to_numpy(), batch.column("label").to_numpy()
        for d in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == d)
            x = whole(flat[starts[rows][:, None] + np.arange(d)])
            held.setdefault(d, [])
            for lo in range(0, len(rows), CANDIDATES):
                at = rows[lo : lo + CANDIDATES]
                if held[d] and sum(len(p[0]) for p in held[d]) + len(at) > CANDIDATES:
                    yield made(held.pop(d))
                    held[d] = []
                held[d].append((i[at], lab[at], x[lo : lo + CANDIDATES]))
    for parts in held.values():
        if parts:
            yield made(parts)


class Best:
    """The k best (score, id) of each of n rows so far, best first; places not filled have the score `none`."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
        self.exact = True  # as long as all scores were float64's

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score and ids (a row for each of rows, not filled: -inf) join what is held."""
        if self.exact and score.dtype == object:
            self.score, self.exact = self.score.astype(object), False
        both, names = np.concatenate([self.score[rows], score], 1), np.concatenate([self.id[rows], ids], 1)
        k = self.score.shape[1]
        if self.exact:
            o = np.lexsort((names, -both), axis=-1)[:, :k]
        else:
            o = np.array([sorted(range(both.shape[1]), key=lambda j, s=s, n=n: (-s[j], n[j]))[:k] for s, n in zip(both, names, strict=True)])
        self.score[rows], self.id[rows] = np.take_along_axis(both, o, 1), np.take_along_axis(names, o, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, score and id of all filled places."""
        r, k = np.nonzero(self.score > -np.inf)
        return r, np.array([int(v) for v in self.score[r, k]], np.int64), self.id[r, k]


def ordered(score: np.ndarray, allowed: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Scores (best first, of the allowed places alone, -inf after them) and places of each row's k best, all if k is None; of equal
    scores the earlier place comes first."""
    n = score.shape[1]
    k = n if k is None else min(k, n)
    if score.dtype != object and float(np.abs(score).max(initial=0.0)) * n + n < EXACT:
        key = np.where(allowed, score * n + np.arange(n - 1, -1, -1), -np.inf)
        if k < n:
            key = -np.partition(-key, k - 1, axis=1)[:, :k]
        key = -np.sort(-key, axis=1)
        filled = np.where(np.isfinite(key), key, 0.0)
        s = np.floor(filled / n)
        return np.where(np.isfinite(key), s, -np.inf), (n - 1 - (filled - s * n)).astype(np.int64)
    masked = np.where(allowed, score, -np.inf)
    o = np.argsort(-masked, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(masked, o, 1), o


def first_pass(anchors: list[Anchors], k: int, batches) -> Iterator[pa.RecordBatch]:
    """The k best of an anchor's own label among these candidates: key, score, other."""
    state = [Best(len(a.key), k) for a in anchors]
    for ids, labels, x in blocks(batches):
        for a, best in zip(anchors, state, strict=True):
            if a.x.shape[1] != x.shape[1]:
                continue
            for label in np.intersect1d(a.label, labels).tolist():
                mine, at = np.flatnonzero(a.label == label), np.flatnonzero(labels == label)
                for lo in range(0, len(mine), ANCHORS):
                    own = mine[lo : lo + ANCHORS]
                    s, o = ordered(products(a.x[own], a.most, x[at]), ids[at][None] != a.id[own][:, None], k)
                    best.add(own, s, ids[at][o])
    for a, best in zip(anchors, state, strict=True):
        r, s, i = best.rows()
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(a.key[r]), pa.array(s), pa.array(i)], names=["key", "score", "other"])


def second_pass(anchors: list[Anchors], positives: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, batches) -> Iterator[pa.RecordBatch]:
    """For each positive of an anchor the k best of other labels within its window: positive (its number), score, other.

    positives, for each group of anchors: the anchor's row (ascending), the least and the greatest score of the window."""
    state = [Best(len(p[0]), k) for p in positives]
    for ids, labels, x in blocks(batches):
        for a, (row, least, most), best in zip(anchors, positives, state, strict=True):
            if a.x.shape[1] != x.shape[1] or not len(row):
                continue
            for lo in range(0, len(a.key), ANCHORS):
                hi = min(lo + ANCHORS, len(a.key))
                first, last = np.searchsorted(row, [lo, hi])
                if first == last:
                    continue
                s, o = ordered(products(a.x[lo:hi], a.most, x), (labels[None] != a.label[lo:hi, None]) & (ids[None] != a.id[lo:hi, None]), None)
                falling = -s
                mine = row[first:last] - lo
                start = np.array([np.searchsorted(falling[r], -m) for r, m in zip(mine.tolist(), most[first:last].tolist(), strict=True)])
                at = start[:, None] + np.arange(k)
                inside = at < s.shape[1]
                at = np.minimum(at, s.shape[1] - 1)
                found = s[mine[:, None], at]
                found = np.where(inside & (found >= least[first:last, None]), found, -np.inf)
                best.add(np.arange(first, last), found, ids[o[mine[:, None], at]])
    for g, best in enumerate(state):
        r, s, i = best.rows()
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), g)), pa.array(r), pa.array(s), pa.array(i)], names=["part", "positive", "score", "other"])


def _grouped(rows: list) -> list[Anchors]:
    """Collected anchors by dimension; the order of the rows numbers them."""
    by: dict[int, list] = {}
    for n, r in enumerate(rows):
        by.setdefault(len(r.x), []).append((n, r))
    return [Anchors(np.array([n for n, _ in of]), np.array([r.id for _, r in of], np.int64), np.array([r.label for _, r in of], np.int64), whole(np.array([r.x for _, r in of], float).reshape(len(of), d))) for d, of in sorted(by.items())]


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its `positives` best others
    of its label the `negatives` best of other labels whose score lies within window per cent of the positive's."""
    spark = vectors.sparkSession
    candidates = usable(vectors, id_col, label_col, vector_col)
    anchors = saved(usable(vectors.where(is_anchor), id_col, label_col, vector_col).distinct(), "negatives-anchors")
    size = anchors.agg(F.sum(8 * F.size("x") + 64).alias("b")).first().b or 0
    rounds = max(1, -(-2 * size // anchor_bytes))  # dealt by hash, a group stays below the bound
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    results = []
    for k in range(rounds):
        rows = anchors.where(F.pmod(F.xxhash64("id", "label", "x"), F.lit(rounds)) == k).orderBy("id", "label", "x").collect() if size else []  # at most anchor_bytes
        if rows:
            results.append(_round(spark, candidates, rows, positives, negatives, window))
    dropped(anchors)
    made = spark.createDataFrame([], schema)
    for r in results:
        made = made.unionByName(r)
    return made


def _merged(states: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of the tasks' states, ranked: a task gives k rows a group at most."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "other"))
    return states.withColumn("rank", rank).where(F.col("rank") <= k)


def _round(spark, candidates: DataFrame, rows: list, positives: int, negatives: int, window: tuple[int, int]) -> DataFrame:
    """The result of one group of anchors, written. What returns to the driver is `positives` rows an anchor of the group."""
    groups = _grouped(rows)
    held = spark.sparkContext.broadcast(groups)
    first = candidates.mapInArrow(lambda b: first_pass(held.value, positives, b), "key long, score long, other long")
    best = _merged(first, ["key"], positives).orderBy("key", "rank").collect()
    place = {int(n): (g, r) for g, a in enumerate(groups) for r, n in enumerate(a.key)}
    parts: list[list] = [[] for _ in groups]
    for b in best:
        g, r = place[b.key]
        low, high = -(-window[0] * b.score // 100), window[1] * b.score // 100
        parts[g].append((r, low, high, b.key, b.other, b.score))
    for p in parts:
        p.sort(key=lambda v: v[0])  # stable: the positives of an anchor stay in order
    windows = [tuple(np.array([v[c] for v in p], np.int64) for c in range(3)) for p in parts]
    sent = spark.sparkContext.broadcast(windows)
    second = candidates.mapInArrow(lambda b: second_pass(held.value, sent.value, negatives, b), "part long, positive long, score long, other long")
    named = [(g, n, rows[v[3]].id, v[4], v[5]) for g, p in enumerate(parts) for n, v in enumerate(p)]
    names = spark.createDataFrame(named, "part long, positive long, anchor_id long, positive_id long, positive_score long")
    found = _merged(second, ["part", "positive"], negatives).join(F.broadcast(names), ["part", "positive"])
    out = saved(found.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives-found")
    held.unpersist()
    sent.unpersist()
    return out


def digest(vectors: DataFrame) -> DataFrame:
    """The contract's rows."""
    return mine(relabelled(vectors), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other))::INTEGER AS rank,
  s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
