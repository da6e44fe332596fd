"""Permutations that no row has to wait for others to take part in.

A permutation of n places is a keyed bijection: where place i goes in draw b follows from (i, n, the group's name, b) alone. So a row
that knows its place in its group finds, for a thousand draws at once, where it goes, in whichever task it lies; only sums of draws
move. Restricted groups of permutations (within strata, of whole blocks) are bijections of fewer places.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import saved, sized
from .joins import in_blocks
from .ranks import cumulated, ranked
from .sampling import numbered, order_of

#: Up to so many places a permutation is the order of that many hashes, and so exactly uniform; beyond, rounds of a Feistel network.
ORDERED = 32
ROUNDS = 6
#: Numbers that stay in a processor's cache.
CACHED = 1 << 15
#: Numbers that a task holds at once for a step over draws and rows.
STEP = 1 << 21


def dealt_out(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that each take much work, over all cores whatever the size of their files."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash(*parts) -> np.ndarray:
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            out = _mixed((np.asarray(p).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD1342543DE82EF95) ^ out)
    return out


def scattered(place: np.ndarray, size: np.ndarray, name: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Where each row's place (below size) goes in each draw: draws by rows. Rows of one name and size share a permutation a draw."""
    place, size = (np.broadcast_to(np.asarray(v, np.int64), np.shape(place)) for v in (place, size))
    name = np.broadcast_to(np.asarray(name).astype(np.uint64), np.shape(place))
    out = np.empty((len(draws), len(place)), np.int64)
    key = _hash(name[None], draws[:, None])
    small = size <= ORDERED
    if small.any():
        own = np.flatnonzero(small)
        _, first, group = np.unique(np.stack([name[own], size[own].astype(np.uint64)]), axis=1, return_index=True, return_inverse=True)
        sizes = size[own][first]
        ends = sizes.cumsum()
        starts = ends - sizes
        inner = np.arange(ends[-1]) - np.repeat(starts, sizes)
        part = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(44)
        step = max(1, CACHED // len(inner))
        for lo in range(0, len(draws), step):
            k = key[lo : lo + step][:, own[first]][:, np.repeat(np.arange(len(sizes)), sizes)]
            order = np.argsort((_hash(k, inner[None]) >> np.uint64(20)) | part, axis=1, kind="stable")
            place_of = np.empty(order.shape, np.int64)
            np.put_along_axis(place_of, order, np.broadcast_to(inner, order.shape), 1)
            out[lo : lo + step, own] = place_of[:, starts[group.ravel()] + place[own]]
    if not small.all():
        rows = np.flatnonzero(~small)
        n = size[rows].astype(np.uint64)
        a = np.ceil(np.sqrt(size[rows])).astype(np.uint64)
        b = (n + a - np.uint64(1)) // a
        start = place[rows].astype(np.uint64)
        whole = len(rows) == len(place)
        step = max(1, CACHED // max(1, len(rows)))
        for lo in range(0, len(draws), step):
            k = key[lo : lo + step] if whole else key[lo : lo + step, rows]
            made = _network(start, k, a, b, n)
            out[lo : lo + step, slice(None) if whole else rows] = made
    return out


def _network(start: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A network over a * b >= n places; what leaves the n places goes round again."""
    shape = key.shape
    left, right = np.broadcast_to(start // b, shape), np.broadcast_to(start % b, shape)
    for step in range(ROUNDS):
        if step % 2:
            right = _turned(right, left, key, step, b)
        else:
            left = _turned(left, right, key, step, a)
    x = left * b + right
    draw, row = np.nonzero(x >= n)
    if len(draw):
        x[draw, row] = _network(x[draw, row], key[draw, row][None], a[row], b[row], n[row])[0]
    return x.astype(np.int64)


def _turned(half: np.ndarray, by: np.ndarray, key: np.ndarray, step: int, size: np.ndarray) -> np.ndarray:
    """half, moved round its size by a hash of the other half."""
    h = _moves(by, key, step, size)
    h += half
    return np.where(h >= size, h - size, h)


def _moves(by: np.ndarray, key: np.ndarray, step: int, size: np.ndarray) -> np.ndarray:
    """How far a step of the network moves a half, below its size."""
    with np.errstate(over="ignore"):
        h = by * np.uint64(0x9E3779B97F4A7C15)
        h = h + np.uint64((0xD1342543DE82EF95 * (step + 1)) & (2**64 - 1))
        h = h ^ key
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h >>= np.uint64(32)
        h *= size
        h >>= np.uint64(32)
    return h


class Whence:
    """scattered() of one whole group, the other way round: which place comes to each place in each draw.

    A step moves a half by a hash of the other half, and a group of n places has about sqrt(n) halves: each is hashed once a draw and
    kept in a table, so that a place in a draw costs six look-ups. Halves are held as half * draws + draw, their own place in a table.
    """

    def __init__(self, size: int, name: np.uint64, draws: np.ndarray):
        self.size, self.draws = size, len(draws)
        key = _hash(name, draws)
        if size <= ORDERED:
            inner = np.arange(size, dtype=np.uint64)
            order = np.sort((_hash(key[:, None], inner[None]) >> np.uint64(20)) << np.uint64(5) | inner, axis=1)
            self.order = np.ascontiguousarray((order & np.uint64(ORDERED - 1)).T).view(np.int64)
            return
        a = int(np.ceil(np.sqrt(size)))
        self.halves = a, -(-size // a)
        self.tables = []
        for step in range(ROUNDS):
            own, other = self.halves[step % 2], self.halves[1 - step % 2]
            moved = _moves(np.arange(other, dtype=np.uint64)[:, None], key[None], step, np.uint64(own))
            self.tables.append(((np.uint64(own) - moved) * np.uint64(self.draws)).ravel())
        self.beyond = self._back(np.arange(size, a * self.halves[1])).ravel()

    def _back(self, place: np.ndarray) -> np.ndarray:
        d, (a, b) = np.uint64(self.draws), self.halves
        draw = np.arange(self.draws, dtype=np.uint64)
        halves = [np.add.outer(half.astype(np.uint64) * d, draw) for half in (place // b, place % b)]
        spare = np.empty_like(halves[0])
        for step in reversed(range(ROUNDS)):
            half, by = halves[step % 2], halves[1 - step % 2]
            half += self.tables[step].take(by.view(np.int64), out=spare, mode="clip")
            np.subtract(half, np.uint64(self.halves[step % 2]) * d, out=spare)
            np.minimum(half, spare, out=half)  # below 0 an unsigned number is a large one
        left, right = (np.floor_divide(half, d, out=half) for half in halves)
        left *= np.uint64(b)
        left += right
        return left.view(np.int64)

    def __call__(self, place: np.ndarray) -> np.ndarray:
        """Places by draws."""
        if self.size <= ORDERED:
            return self.order[place]
        x = self._back(place)
        flat = x.ravel()
        at = np.flatnonzero(flat >= self.size)
        while len(at):  # what comes from outside the group's places came there from a place before
            flat[at] = self.beyond[(flat[at] - self.size) * self.draws + at % self.draws]
            at = at[flat[at] >= self.size]
        return x


# ---- whose centroid is nearest -------------------------------------------------------------------


def nearest_people(test: DataFrame, centroids: DataFrame, key: str, person: str, vector: str, k: int = 5) -> DataFrame:
    """key, person, rank of the own centroid among all by dot product (ties by person), and best, the k nearest people: one pass in
    blocks, each of which gives a count and its k best."""
    kinds = {n: test.schema[n].dataType.simpleString() for n in (key, person)}
    c = centroids.select(F.col(person).alias("_p"), F.col(vector).alias("_c"))
    from ..functions.arrays import dot

    t = test.select(F.col(key).alias(key), F.col(person).alias(person), F.col(vector).alias(vector))
    own = t.join(c, F.col(person) == F.col("_p")).select(key, person, vector, dot(F.col(vector), F.col("_c")).alias("_own"))

    def met(q, b):
        import pandas as pd

        columns = [key, person, "n", "near"]
        if not len(q) or not len(b):
            return pd.DataFrame(columns=columns)
        b = b.sort_values("_p")
        sim = np.stack(q[vector].to_numpy()).astype(float) @ np.stack(b["_c"].to_numpy()).astype(float).T
        mine, who = q["_own"].to_numpy()[:, None], b["_p"].to_numpy()
        own_ = who[None] == q[person].to_numpy()[:, None]
        sim = np.where(own_, mine, sim)
        tied = np.abs(sim - mine) <= 1e-12
        above = ((sim > mine) & ~tied) | (tied & (who[None] < q[person].to_numpy()[:, None]))
        top = np.argsort(-np.round(sim, 12), axis=1, kind="stable")[:, :k]
        near = [[{"s": float(-np.round(sim[i, j], 12)), "p": who[j]} for j in js] for i, js in enumerate(top)]
        return pd.DataFrame({key: q[key].to_numpy(), person: q[person].to_numpy(), "n": (above & ~own_).sum(1), "near": near})

    again = centroids.select(F.col(person).alias("_p"), F.col(vector).alias("_c"))
    found = in_blocks(own, again, met, f"{key} {kinds[key]}, {person} {kinds[person]}, n long, near array<struct<s: double, p: {kinds[person]}>>")
    g = found.groupBy(key, person).agg((F.sum("n") + 1).alias("rank"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("_near"))  # k a block
    return g.select(key, person, "rank", F.transform("_near", lambda s: s["p"]).alias("best"))


def label_permutation(rows: DataFrame, key: str, person: str, best: str = "best", tops: tuple[int, ...] = (1, 5), draws: int = 1000) -> DataFrame:
    """For each of tops: how often a row's person is among its first so many of best, against the rows' people dealt anew over the rows:
    top, observed, null_mean, null_q95, p, n, draws.

    People hold successive places in proportion to their rows. A row is dealt a place, and its guess is right where that place is the
    guessed person's: nothing is compared again, and nothing but counts by draw moves.
    """
    held = saved(rows.select(key, person, F.slice(best, 1, max(tops)).alias("best")), "permuted-rows")
    size = held.groupBy(F.col(person).alias("of")).agg(F.count("*").alias("n"))
    owned = sized(saved(cumulated(size, ["of"], {"start": "n"}), "permuted-people"))
    turn = numbered(held, key, [F.col(key)], [person, "best"])
    guess = turn.select((F.col("number") - 1).alias("i"), F.col(person).alias("own"), F.posexplode("best").alias("at", "guess"))
    placed = guess.join(owned, F.col("guess") == F.col("of"), "left").select("i", "at", (F.col("own") == F.col("guess")).alias("right"), F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("n", F.lit(0)).alias("n"))
    total = held.count()

    def run(batches):
        import pyarrow as pa

        hits = np.zeros((draws + 1, len(tops)), np.int64)
        for batch in batches:
            i, at, right, start, n = (np.asarray(batch.column(c)) for c in range(5))
            for lo in range(0, len(i), max(1, STEP // max(draws, 1))):
                part = slice(lo, lo + max(1, STEP // max(draws, 1)))
                to = scattered(i[part], np.full(len(i[part]), total), np.zeros(len(i[part]), np.uint64), np.arange(draws))
                inside = np.r_[right[part][None], (to >= start[part]) & (to < start[part] + n[part])]
                for t, top in enumerate(tops):
                    hits[:, t] += inside[:, at[part] < top].sum(1)
        draw = np.repeat(np.arange(-1, draws, dtype=np.int32), len(tops))
        yield pa.RecordBatch.from_arrays([pa.array(draw), pa.array(np.tile(np.array(tops, np.int32), draws + 1)), pa.array(hits.ravel())], names=["draw", "top", "hits"])

    sums = dealt_out(placed, "i").mapInArrow(run, "draw int, top int, hits long").groupBy("draw", "top").agg((F.sum("hits") / F.lit(max(total, 1))).alias("x"))
    from .nulls import beyond_null

    return beyond_null(sums, ["top"]).select("top", "observed", "null_mean", "null_q95", "p", F.lit(total).alias("n"), F.col("n_null").alias("draws"))


# ---- labels within strata, the greatest of many statistics ---------------------------------------


def in_strata(df: DataFrame, key: str, stratum: str, keep: list[str], order: list[Column]) -> DataFrame:
    """key, keep, stratum, _place (from 0, in the order given, within the stratum) and _size."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    starts = sized(saved(cumulated(sizes, [stratum], {"_start": "_size"}), "strata"))
    turn = numbered(df, key, [F.col(stratum), *order], [stratum, *keep]).alias("l")
    return turn.join(starts.alias("r"), F.col(f"l.{stratum}").eqNullSafe(F.col(f"r.{stratum}"))).select("l.*", (F.col("number") - 1 - F.col("_start")).alias("_place"), "_size").drop("number")


def network_contrast(df: DataFrame, columns: list[str], key: str, label: str, stratum: str, draws: int = 300, seed: int = 0) -> DataFrame:
    """Rank correlations of all column pairs among rows of label 1 and of label 0 (as many of either, by hash), and whether they differ
    by more than labels dealt anew within strata make any pair differ: a, b, rho_1, rho_0, delta, p (family-wise, by the greatest absolute
    difference of a draw), threshold (its 95 % quantile), n (of either side).

    Ranks are taken once over both sides. A row knows its place in its stratum, so a task labels its rows in all draws and adds up their
    products by one matrix multiplication; sums by draw meet.
    """
    known = df.dropna(subset=[*columns, label, stratum]).select(key, F.col(label).cast("int").alias("_label"), F.col(stratum).alias("_stratum"), *columns)
    known = saved(known, "contrast-known")  # counted, sized and numbered apart
    least = known.agg(F.least(F.count_if(F.col("_label") == 1), F.count_if(F.col("_label") == 0)).alias("n")).first().n
    even = in_strata(known, key, "_label", ["_stratum", *columns], [order_of(key, seed), F.col(key)]).where(F.col("_place") < least)
    even = saved(even.select(key, "_label", "_stratum", *columns), "contrast-rows")
    rank = ranked(even, columns).select(key, "_label", "_stratum", F.array(*(F.col(f"_r_{c}") - F.lit(least + 0.5) for c in columns)).alias("x"))
    rank = saved(rank, "contrast-ranks")
    placed = in_strata(rank, key, "_stratum", ["_label", "x"], [order_of(key, seed + 1), F.col(key)]).select(F.xxhash64(F.col("_stratum").cast("string")).alias("name"), "_label", "x", "_place", "_size")
    c = len(columns)
    upper = np.triu_indices(c)

    def run(batches):
        import pyarrow as pa

        inside = np.zeros((draws + 1, 1 + c + len(upper[0])))
        every = np.zeros(inside.shape[1])
        for batch in batches:
            name, lab, place, size = (np.asarray(batch.column(k)) for k in ("name", "_label", "_place", "_size"))
            x = np.asarray(batch.column("x").flatten(), float).reshape(-1, c)
            for lo in range(0, len(x), max(1, STEP // max(draws, 1))):
                part = slice(lo, lo + max(1, STEP // max(draws, 1)))
                v = x[part]
                terms = np.concatenate([np.ones((len(v), 1)), v, v[:, upper[0]] * v[:, upper[1]]], 1)
                to = scattered(place[part], size[part], name[part].view(np.uint64), np.arange(draws))
                labelled = np.r_[lab[part][None] == 1, to < size[part] // 2].astype(float)
                inside += labelled @ terms
                every += terms.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, draws, dtype=np.int32)), pa.array([row.tobytes() for row in inside]), pa.array([every.tobytes()] * (draws + 1))], names=["draw", "inside", "every"])

    def rho(s):
        n, m = max(s[0], 1.0), np.zeros((c, c))
        m[upper] = s[1 + c :] / n
        cov = m - np.triu(np.outer(s[1 : 1 + c], s[1 : 1 + c]) / n**2)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        with np.errstate(invalid="ignore", divide="ignore"):
            r = cov / np.outer(sd, sd)
        return np.nan_to_num(r[np.triu_indices(c, 1)])

    def one(ids, pdf):
        import pandas as pd

        inside, every = (np.sum([np.frombuffer(v) for v in pdf[k]], axis=0) for k in ("inside", "every"))
        one_, zero = rho(inside), rho(every - inside)
        return pd.DataFrame([{"draw": ids[0], "most": float(np.abs(one_ - zero).max(initial=0.0)), "rho_1": one_, "rho_0": zero}])

    # a group holds a draw's sums of every task
    each = saved(dealt_out(placed, "name", "_place").mapInArrow(run, "draw int, inside binary, every binary").groupBy("draw").applyInPandas(one, "draw int, most double, rho_1 array<double>, rho_0 array<double>"), "contrast-draws")
    i, j = np.triu_indices(c, 1)
    names = F.array(*(F.struct(F.lit(columns[p]).alias("a"), F.lit(columns[q]).alias("b")) for p, q in zip(i, j, strict=True)))
    null = each.where("draw >= 0").agg(F.collect_list("most").alias("_x"))  # a number a draw
    seen = each.where("draw < 0").select(F.explode(F.arrays_zip(names.alias("pair"), "rho_1", "rho_0")).alias("e")).select("e.pair.*", "e.rho_1", "e.rho_0")
    delta = F.col("rho_1") - F.col("rho_0")
    cut = F.element_at(F.array_sort("_x"), F.ceil(F.size("_x") * 0.95).cast("int"))
    beyond = F.size(F.filter("_x", lambda v: v >= F.abs(F.col("delta")) - 1e-12))
    return seen.withColumn("delta", delta).crossJoin(F.broadcast(null)).select("a", "b", "rho_1", "rho_0", "delta", ((beyond + 1) / (F.size("_x") + 1)).alias("p"), cut.alias("threshold"), F.lit(least).alias("n"))


# ---- within persons, in strata and in blocks -----------------------------------------------------

#: Rows of a person (and stratum) above which they are not brought together; each is dealt by its place, wherever it lies.
HOT_ROWS = 1 << 16


def dealt_places(place: np.ndarray, size: np.ndarray, name: np.ndarray, draws: np.ndarray, block: int) -> np.ndarray:
    """scattered(), of whole blocks of `block` successive places; the last block may be shorter."""
    if block == 1:
        return scattered(place, size, name, draws)
    blocks, short = -(-size // block), -size % block
    at = place // block
    to = scattered(at, blocks, name, draws)
    last = scattered(blocks - 1, blocks, name, draws)  # where the short block goes: what comes after it moves up
    return to * block + place % block - np.where(last < to, short, 0)


def dealt_whence(size: int, name: np.uint64, draws: np.ndarray, block: int):
    """dealt_places() of one whole group, the other way round, for successive places, as Whence."""
    if block == 1:
        return Whence(size, name, draws)
    blocks, short = -(-size // block), -size % block
    whence = Whence(blocks, name, draws)
    last = scattered(np.array([blocks - 1]), np.array([blocks]), np.array([name]), draws)[:, 0]
    ends = (last + 1) * block - short  # of the short block: what comes after it has moved up

    def blockwise(place: np.ndarray) -> np.ndarray:
        full = place[:, None] + np.where(place[:, None] >= ends, short, 0)
        first = place[0] // block
        order = whence(np.arange(first, full[-1].max() // block + 1))
        return np.take_along_axis(order, full // block - first, 0) * block + full % block

    return blockwise


def shuffled_sums(df: DataFrame, person: str, period: str, columns: list[Column], draws: int, seed: str = "within", stratum: Column | None = None, block: int = 1, hot: int | None = None) -> DataFrame:
    """period, draw, n and s: the sums of the columns by period when each person's rows are dealt anew over the person's own rows; draw
    -1 is as observed. With stratum only over rows of the same stratum (a weekday, say, so that weekdays are kept); with block > 1 whole
    runs of so many successive rows change places, so that what stands side by side in a run still does.

    Rows move once, by person, all draws are made where they then lie, and a task gives its sums by period. The rows of a person with
    more than `hot` of them (HOT_ROWS) aren't brought together: their places come from ranges of an order, and the places that each period
    holds, a row a person and period, from a join of a checked size. Either way a row goes where its place, its person and the draw say.
    """
    hot = HOT_ROWS if hot is None else hot
    kind = df.schema[period].dataType.simpleString()
    arrow = to_arrow_type(df.schema[period].dataType)
    c = len(columns)
    x = F.array(*(v.cast("double") for v in columns))
    name = F.xxhash64(F.lit(seed), F.col(person).cast("string"), (F.lit("") if stratum is None else stratum).cast("string"))
    rows = df.select(name.alias("name"), F.col(period).alias("period"), x.alias("x")).where("period IS NOT NULL")
    seen = rows.groupBy("period").agg(F.count("*").alias("n"), F.array(*(F.sum(F.get("x", F.lit(k))) for k in range(c))).alias("s")).withColumn("draw", F.lit(-1))
    if not draws:
        return seen.withColumnRenamed("period", period)
    crowded = saved(rows.groupBy("name").agg(F.count("*").alias("size")).where(F.col("size") > hot), "hot-people")
    any_hot = not crowded.isEmpty()
    usual = rows.join(sized(crowded), "name", "left_anti") if any_hot else rows

    def emitted(totals, counts):
        import pyarrow as pa

        names = list(totals)
        return pa.RecordBatch.from_arrays([pa.array(names, arrow), pa.array([counts[p] for p in names], pa.int64()), pa.array([totals[p].tobytes() for p in names], pa.binary())], names=["period", "n", "s"])

    class Sums:
        """Sums by period and draw of what has been dealt; steps over draws and rows are put together before they are added up."""

        def __init__(self):
            self.totals: dict = {}
            self.counts: dict = {}
            self.waiting: list = []
            self.size = 0

        def put(self, codes, names, values):
            """codes: draws by rows, places in names; values: rows by columns."""
            self.waiting.append((codes, names, values))
            self.size += codes.size
            if self.size > STEP:
                self.add()

        def add(self):
            if not self.waiting:
                return
            known: dict = {}
            flat, weight = [], []
            for codes, names, values in self.waiting:
                own = np.array([known.setdefault(p, len(known)) for p in names])
                flat.append((own[codes] * draws + np.arange(draws)[:, None]).ravel())
                weight.append(np.broadcast_to(values[None], (draws, *values.shape)).reshape(-1, c))
            flat, weight = np.concatenate(flat), np.concatenate(weight)
            made = np.stack([np.bincount(flat, weight[:, k], len(known) * draws) for k in range(c)]).reshape(c, len(known), draws)
            for p, k in known.items():
                self.totals[p] = self.totals[p] + made[:, k] if p in self.totals else made[:, k].copy()
            self.waiting, self.size = [], 0

        def full(self) -> bool:
            return len(self.totals) * draws * c > 8 * STEP

    def together(batches):
        sums, held = Sums(), None
        step = max(1, CACHED // 2 // draws)

        def deal(who, periods, values):
            whence = dealt_whence(len(values), np.int64(who).view(np.uint64), np.arange(draws), block)
            for lo in range(0, len(values), step):
                come = whence(np.arange(lo, min(len(values), lo + step)))
                moved = np.empty((c, *come.shape))
                for v, to in zip(values.T, moved, strict=True):
                    v.take(come, out=to, mode="clip")
                at = 0
                for p, run in groupby(periods[lo : lo + step]):  # the places of a period are successive
                    k = len(list(run))
                    if p not in sums.totals:
                        sums.totals[p] = np.zeros((c, draws))
                    sums.totals[p] += moved[:, at : at + k].sum(1)
                    sums.counts[p] = sums.counts.get(p, 0) + k
                    at += k

        for batch in batches:
            who = np.asarray(batch.column("name"))
            periods = batch.column("period").to_pylist()
            values = np.asarray(batch.column("x").flatten().fill_null(0.0), float).reshape(-1, c)
            cuts = np.r_[0, np.flatnonzero(np.diff(who)) + 1, len(who)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                new = (who[lo], periods[lo:hi], values[lo:hi])
                if held is not None and held[0] == new[0]:
                    held = (held[0], held[1] + new[1], np.r_[held[2], new[2]])
                    continue
                if held is not None:
                    deal(*held)
                held = new
            if sums.full():
                yield emitted(sums.totals, sums.counts)
                sums.totals, sums.counts = {}, {}
        if held is not None:
            deal(*held)
        if sums.totals:
            yield emitted(sums.totals, sums.counts)

    dealt = dealt_out(usual, "name").sortWithinPartitions("name", "period", "x").mapInArrow(together, f"period {kind}, n long, s binary")

    def apart(batches):
        sums = Sums()
        for batch in batches:
            who, place, size = (np.asarray(batch.column(k)) for k in ("name", "place", "size"))
            values = np.asarray(batch.column("x").flatten().fill_null(0.0), float).reshape(-1, c)
            spans = batch.column("spans")
            for w in np.unique(who):
                mine = np.flatnonzero(who == w)
                span = spans[int(mine[0])].as_py()
                names, starts = [s["period"] for s in span], np.array([s["start"] for s in span])
                for p in batch.column("period").take(_ints(mine)).to_pylist():
                    sums.counts[p] = sums.counts.get(p, 0) + 1
                for lo in range(0, len(mine), max(1, STEP // draws)):
                    part = mine[lo : lo + max(1, STEP // draws)]
                    to = dealt_places(place[part], size[part], who[part].view(np.uint64), np.arange(draws), block)
                    sums.put(np.searchsorted(starts, to, "right") - 1, names, values[part])
            if sums.full():
                sums.add()
                yield emitted(sums.totals, {p: sums.counts.pop(p, 0) for p in sums.totals})
                sums.totals = {}
        sums.add()
        if sums.totals or sums.counts:
            for p in sums.counts:
                sums.totals.setdefault(p, np.zeros((c, draws)))
            yield emitted(sums.totals, {p: sums.counts.get(p, 0) for p in sums.totals})

    if any_hot:
        many = saved(rows.join(sized(crowded), "name").withColumn("_id", F.monotonically_increasing_id()), "hot-rows")
        runs = Window.partitionBy("name").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)  # a row a period of a hot person
        spans = many.groupBy("name", "period").agg(F.count("*").alias("k")).withColumn("start", F.coalesce(F.sum("k").over(runs), F.lit(0)))
        spans = saved(spans.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("start", "period"))).alias("spans")), "hot-spans")
        at = in_strata(many, "_id", "name", ["period", "x", "size"], [F.col("period"), F.col("x"), F.col("_id")]).withColumnRenamed("_place", "place")
        dealt = dealt.unionByName(at.join(sized(spans), "name").select("name", "place", "size", "period", "x", "spans").mapInArrow(apart, f"period {kind}, n long, s binary"))

    def told(ids, pdf):
        import pandas as pd

        total = np.sum([np.frombuffer(v).reshape(c, draws) for v in pdf["s"]], axis=0).T
        return pd.DataFrame({"period": [ids[0]] * draws, "n": int(pdf["n"].sum()), "s": list(total), "draw": np.arange(draws, dtype=np.int32)})

    # a group holds a period's sums of every task
    each = dealt.groupBy("period").applyInPandas(told, f"period {kind}, n long, s array<double>, draw int")
    return seen.unionByName(each).withColumnRenamed("period", period)


def _ints(x: np.ndarray):
    import pyarrow as pa

    return pa.array(x)
