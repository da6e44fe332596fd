"""Bootstraps, sign flips and repeated matchings whose replicates are made where the rows are.

A row's weight, sign or membership in a replicate comes from a hash of its name and the replicate's number. Tasks give sums by
replicate, and those meet; neither rows nor replicates have to come together.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import kernels as K
from ..sources.shared import saved, sized
from .permutations import STEP, _hash, dealt_out, in_strata, scattered

#: Chances of a Poisson number of mean 1 to be at most 0, 1, ...
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
#: Places of a pool up to which each unit finds out by its place in which draws it is; in larger pools a draw is dealt to blocks first.
PLACED_POOL = 1 << 16
#: Units of a day that meet in a task where draws are dealt to blocks.
BLOCK_UNITS = 1 << 14


def weights(name: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """Poisson numbers of mean 1: draws by rows."""
    u = (_hash(np.uint64(seed), name[None].view(np.uint64), draws[:, None]) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_POISSON, u, "right").astype(float)


def signs(name: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """1 or -1: draws by rows."""
    return np.where(_hash(np.uint64(seed), name[None].view(np.uint64), draws[:, None]) >> np.uint64(63), 1.0, -1.0)


def _summed(rows: DataFrame, by: list[str], fn, width: int) -> DataFrame:
    """by and x, the packed sums of fn(names, values) (a vector of so many numbers) over rows (by, name, v), by group."""
    kinds = "".join(f"{b} {rows.schema[b].dataType.simpleString()}, " for b in by)
    arrow = [to_arrow_type(rows.schema[b].dataType) for b in by]

    def run(batches):
        totals: dict = {}
        for batch in batches:
            name, v = np.asarray(batch.column("name")), np.asarray(batch.column("v"), float)
            keys = list(zip(*(batch.column(b).to_pylist() for b in by), strict=True)) if by else [()] * len(v)
            groups: dict = {}
            for i, k in enumerate(keys):
                groups.setdefault(k, []).append(i)
            for k, at in groups.items():
                made = fn(name[at], v[at])
                totals[k] = totals[k] + made if k in totals else made
            if len(totals) * width > 8 * STEP:
                yield told(totals)
                totals = {}
        if totals:
            yield told(totals)

    def told(totals):
        import pyarrow as pa

        columns = [pa.array([k[i] for k in totals], t) for i, t in enumerate(arrow)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([t.tobytes() for t in totals.values()])], names=[*by, "x"])

    return dealt_out(rows, "name").mapInArrow(run, kinds + "x binary")


def resampled_means(df: DataFrame, name: str, value: str, by: list[str] | None = None, boots: int = 4000, flips: int = 10_000, seed: int = 0) -> DataFrame:
    """by, mean, lo, hi (95 % of bootstraps, rows weighed by Poisson numbers), p (sign flips, two-sided), n: of rows that are told apart
    by name, such as one a contributor."""
    by = by or []
    rows = df.where(F.col(value).isNotNull()).select(*by, F.xxhash64(F.col(name).cast("string")).alias("name"), F.col(value).cast("double").alias("v"))

    def fn(names, v):
        out = np.zeros(2 + 2 * boots + flips)
        for lo in range(0, len(v), max(1, STEP // max(boots, flips))):
            part = slice(lo, lo + max(1, STEP // max(boots, flips)))
            w = weights(names[part], np.arange(boots), seed)
            out += np.r_[len(v[part]), v[part].sum(), w.sum(1), w @ v[part], signs(names[part], np.arange(flips), seed + 1) @ v[part]]
        return out

    def one(ids, pdf):
        import pandas as pd

        t = np.sum([np.frombuffer(x) for x in pdf["x"]], axis=0)
        n, mean = t[0], t[1] / t[0]
        boot = t[2 + boots : 2 + 2 * boots] / np.maximum(t[2 : 2 + boots], 1e-300)
        flip = t[2 + 2 * boots :] / n
        lo, hi = np.quantile(boot[t[2 : 2 + boots] > 0], [0.025, 0.975])
        return pd.DataFrame([{**dict(zip(by, ids, strict=True)), "mean": mean, "lo": lo, "hi": hi, "p": (1 + (np.abs(flip) >= abs(mean) - 1e-12).sum()) / (flips + 1), "n": int(n)}])

    kinds = "".join(f"{b} {df.schema[b].dataType.simpleString()}, " for b in by)
    # a group holds the sums of every task
    return _summed(rows, by, fn, 2 + 2 * boots + flips).groupBy(*by).applyInPandas(one, kinds + "mean double, lo double, hi double, p double, n long")


def contrasts(df: DataFrame, name: str, side: str, value: str, by: list[str], draws: int = 1000, seed: int = 0) -> DataFrame:
    """by, difference (of the means of side 1 and 0), lo, hi, p (two-sided, bootstrap), n_1, n_0: for each group."""
    known = df.where(F.col(value).isNotNull())
    rows = known.select(*by, F.col(side).cast("int").alias("side"), F.xxhash64(F.col(name).cast("string"), F.col(side).cast("string")).alias("name"), F.col(value).cast("double").alias("v"))

    def fn(names, v):
        out = np.zeros(2 + 2 * draws)
        for lo in range(0, len(v), max(1, STEP // draws)):
            part = slice(lo, lo + max(1, STEP // draws))
            w = weights(names[part], np.arange(draws), seed)
            out += np.r_[len(v[part]), v[part].sum(), w.sum(1), w @ v[part]]
        return out

    def one(ids, pdf):
        import pandas as pd

        t = [np.sum([np.frombuffer(x) for x in pdf[pdf["side"] == s]["x"]] or [np.zeros(2 + 2 * draws)], axis=0) for s in (0, 1)]
        n = [v[0] for v in t]
        if min(n) == 0:
            return pd.DataFrame()
        mean = [v[1] / v[0] for v in t]
        boot = [v[2 + draws :] / np.maximum(v[2 : 2 + draws], 1e-300) for v in t]
        ok = (t[0][2 : 2 + draws] > 0) & (t[1][2 : 2 + draws] > 0)
        d = (boot[1] - boot[0])[ok]
        lo, hi = np.quantile(d, [0.025, 0.975])
        p = 2 * min((1 + (d <= 0).sum()) / (len(d) + 1), (1 + (d >= 0).sum()) / (len(d) + 1))
        return pd.DataFrame([{**dict(zip(by, ids, strict=True)), "difference": mean[1] - mean[0], "lo": lo, "hi": hi, "p": min(1.0, p), "n_1": int(n[1]), "n_0": int(n[0])}])

    kinds = "".join(f"{b} {df.schema[b].dataType.simpleString()}, " for b in by)
    return _summed(rows, [*by, "side"], fn, 2 + 2 * draws).groupBy(*by).applyInPandas(one, kinds + "difference double, lo double, hi double, p double, n_1 long, n_0 long")


def matched_over_seeds(df: DataFrame, key: str, side: str, stratum: str, person: str, value: str, seeds: int = 50, draws: int = 1000) -> DataFrame:
    """seed, difference, lo, hi, p, n_1, n_0: of people's means of value, from as many rows of either side in each stratum, drawn anew
    for each seed.

    A row knows its place among its side's rows of the stratum, and so in which seeds' draws it is; rows are not ranked once a seed.
    """
    known = df.where(F.col(value).isNotNull() & F.col(stratum).isNotNull())
    cell = F.concat_ws("|", F.col(side).cast("int").cast("string"), F.col(stratum).cast("string"))
    placed = in_strata(known.withColumn("_cell", cell), key, "_cell", [side, stratum, person, value], [F.col(key)])
    least = known.groupBy(stratum).agg(F.least(F.count_if(F.col(side).cast("int") == 1), F.count_if(F.col(side).cast("int") == 0)).alias("_k")).where("_k > 0")
    met = placed.join(sized(saved(least, "matched-sizes")), stratum).select(F.xxhash64("_cell").alias("name"), "_place", "_size", "_k", F.col(side).cast("int").alias("side"), F.col(person).cast("string").alias("person"), F.col(value).cast("double").alias("v"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, len(batch), max(1, STEP // seeds)):
                part = batch.slice(lo, max(1, STEP // seeds))
                name, place, size, k = (np.asarray(part.column(c)) for c in ("name", "_place", "_size", "_k"))
                inside = scattered(place, size, name.view(np.uint64), np.arange(seeds)) < k[None]
                row, seed = np.nonzero(inside.T)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(seed.astype(np.int32)), *(part.column(c).take(at) for c in ("side", "person", "v"))], names=["seed", "side", "person", "v"])

    drawn = dealt_out(met, "name", "_place").mapInArrow(run, "seed int, side int, person string, v double")
    return contrasts(drawn.groupBy("seed", "side", "person").agg(F.avg("v").alias("v")), "person", "side", "v", ["seed"], draws)


def over_seeds(each: DataFrame) -> DataFrame:
    """One row: median difference, median, least and greatest p, seeds. Rows are few, one a seed."""
    return each.agg(F.percentile("difference", F.lit(0.5)).alias("difference"), F.percentile("p", F.lit(0.5)).alias("p_median"), F.min("p").alias("p_least"), F.max("p").alias("p_most"), F.count("*").alias("seeds"))


def block_means(series: DataFrame, order: str, columns: dict[str, Column], block: int = 7, draws: int = 5000, each: int = 500, seed: str = "blocks") -> DataFrame:
    """column, mean, lo, hi, n: means of a series with 95 % of bootstraps of circular blocks of successive rows. A group holds the series,
    a row a day, and `each` draws, so draws spread over tasks."""
    rows = series.select(order, *(c.cast("double").alias(n) for n, c in columns.items()))
    dealt = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // each) - 1))).alias("_block"))
    names = list(columns)

    def one(ids, pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        rng, size = K.rng_of(seed, int(ids[0])), len(pdf)
        starts = rng.integers(0, size, (min(each, draws - int(ids[0]) * each), -(-size // block)))
        index = ((starts[:, :, None] + np.arange(block)) % size).reshape(len(starts), -1)[:, :size]
        out = []
        for n in names:
            x = pdf[n].to_numpy(float)
            with np.errstate(invalid="ignore"):
                out.append((n, float(np.nanmean(x)) if np.isfinite(x).any() else np.nan, np.nanmean(x[index], axis=1).tolist(), int(np.isfinite(x).sum())))
        return pd.DataFrame(out, columns=["column", "mean", "x", "n"])

    made = dealt.groupBy("_block").applyInPandas(one, "column string, mean double, x array<double>, n long")
    x = F.array_sort(F.flatten(F.collect_list("x")))  # a number a draw
    at = lambda q: F.element_at("x", F.greatest(F.lit(1), F.ceil(F.size("x") * q).cast("int")))
    return made.groupBy("column").agg(F.max("mean").alias("mean"), x.alias("x"), F.max("n").alias("n")).select("column", "mean", at(0.025).alias("lo"), at(0.975).alias("hi"), "n")


def reliability(halves: DataFrame, period: str, block: int = 8, draws: int = 500, each: int = 50, least: int = 12) -> DataFrame:
    """One row: the mean correlation of both halves' period means over splits, stepped up to full length, with 95 % of bootstraps of
    circular blocks of periods (the same periods for all splits): r, reliability, lo, hi, splits, periods. A group holds the periods'
    means of all splits, and `each` draws."""
    held = saved(halves.select("split", period, "0_m", "1_m"), "reliability-halves")
    dealt = held.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // each) - 1))))

    def one(ids, pdf):
        import pandas as pd

        a, b = (pdf.pivot(index=period, columns="split", values=c).sort_index().to_numpy(float) for c in ("0_m", "1_m"))
        n = len(a)
        if n < least:
            return pd.DataFrame()
        rng = K.rng_of("reliability", int(ids[0]))
        starts = rng.integers(0, n, (min(each, draws - int(ids[0]) * each), -(-n // block)))
        index = ((starts[:, :, None] + np.arange(block)) % n).reshape(len(starts), -1)[:, :n]

        def mean_r(rows):
            x, y = a[rows], b[rows]
            both = np.isfinite(x) & np.isfinite(y)
            k = both.sum(0)
            x, y = np.where(both, x, 0.0), np.where(both, y, 0.0)
            cov = (x * y).sum(0) / k - x.sum(0) * y.sum(0) / k**2
            v = ((x * x).sum(0) / k - (x.sum(0) / k) ** 2) * ((y * y).sum(0) / k - (y.sum(0) / k) ** 2)
            with np.errstate(invalid="ignore", divide="ignore"):
                return float(np.nanmean(cov / np.sqrt(v)))

        step = lambda r: 2 * r / (1 + r) if r > -1 else np.nan
        r = mean_r(np.arange(n))
        return pd.DataFrame([{"r": r, "reliability": step(r), "x": [step(mean_r(i)) for i in index], "splits": a.shape[1], "periods": n}])

    made = dealt.groupBy("_block").applyInPandas(one, "r double, reliability double, x array<double>, splits int, periods int")
    x = F.array_sort(F.filter(F.flatten(F.collect_list("x")), lambda v: ~F.isnan(v)))  # a number a draw
    at = lambda q: F.element_at("x", F.greatest(F.lit(1), F.ceil(F.size("x") * q).cast("int")))
    g = made.agg(*(F.max(c).alias(c) for c in ("r", "reliability", "splits", "periods")), x.alias("x"))
    return g.select("r", "reliability", at(0.025).alias("lo"), at(0.975).alias("hi"), "splits", "periods")


def excess_of_days(days: DataFrame, order: str, p: str = "p", z: str = "z", excess: str = "excess", alpha: float = 0.05) -> DataFrame:
    """One row on a series of days' one-sided p: how many lie below alpha and above 1 - alpha, against chance by the binomial and by
    circular blocks of seven days; mean excess with its interval; combined z and sign test; spread of z."""
    from ..functions.stats import sign_test

    held = saved(days.where(F.col(p).isNotNull()), "excess-days")
    low, high = (F.col(p) < alpha).cast("int"), (F.col(p) > 1 - alpha).cast("int")
    b = block_means(held, order, {"low": low, "high": high, "excess": F.col(excess)})
    wide = b.groupBy().agg(*(F.max(F.when(F.col("column") == c, F.col(k))).alias(f"{c}_{k}") for c in ("low", "high", "excess") for k in ("mean", "lo", "hi")))
    seen = held.agg(F.count("*").alias("n"), F.sum(low).alias("n_low"), F.sum(high).alias("n_high"), F.count_if(F.col(excess) > 0).alias("up"), (F.sum(z) / F.sqrt(F.count(z))).alias("stouffer_z"), F.stddev_samp(z).alias("sd_z"))
    tail = lambda k: F.aggregate(F.sequence(F.col(k), F.col("n")), F.lit(0.0), lambda a, j: a + F.exp(_ln_binomial(F.col("n"), j, alpha)))
    return seen.crossJoin(F.broadcast(wide)).select(
        "n", "n_low", "n_high", tail("n_low").alias("p_low"), tail("n_high").alias("p_high"),
        F.col("low_mean").alias("rate_low"), "low_lo", "low_hi", F.col("high_mean").alias("rate_high"), "high_lo", "high_hi", F.col("excess_mean").alias("mean_excess"), "excess_lo", "excess_hi",
        (F.col("up") / F.col("n")).alias("share_positive"), sign_test(F.col("up"), F.col("n")).alias("sign_p"), "stouffer_z", "sd_z",
    )


def _ln_binomial(n: Column, k: Column, p: float) -> Column:
    from ..functions.stats import _ln_factorial

    return _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * math.log(p) + (n - k) * math.log(1 - p)


def block_edges(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the blocks of a pool begin and end, of days of so many units one after another, each cut into blocks; and the number of
    blocks before each day."""
    many = -(-sizes // block)
    first = np.cumsum(many) - many
    inner = np.arange(many.sum()) - np.repeat(first, many)
    length = np.minimum(block, np.repeat(sizes, many) - inner * block)
    return np.r_[0, np.cumsum(length)], first


def block_counts(leaf: int, edges: np.ndarray, k: int, name: str, draws: int) -> np.ndarray:
    """How many of k places, drawn without replacement from the whole pool, lie in one of its blocks: a number a draw. The pool is halved
    down to the block, and what a half gets follows from the name and the half alone, so that blocks in different tasks agree."""
    lo, hi, count = 0, len(edges) - 1, np.full(draws, k)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        low = K.rng_of("halves", name, lo, hi).hypergeometric(edges[mid] - edges[lo], edges[hi] - edges[mid], count)
        if leaf < mid:
            count, hi = low, mid
        else:
            count, lo = count - low, mid
    return count


def synchrony(units: DataFrame, vector: str, size: int, day: str = "day", within: int = 56, draws: int = 1000, same_weekday: bool = True, least: int = 3, placed_pool: int | None = None, block: int | None = None) -> DataFrame:
    """Cohesion of each day's units against that of as many units drawn from nearby days: day, n, obs, null_mean, null_sd, excess, z, p.

    A day's pool holds the units of days within `within` days, one day's after another's, so a unit's place in a pool follows from its
    place in its own day; a place tells in which draws its unit is. A task adds up the drawn vectors by day and draw.

    In a pool of more than `placed_pool` places (PLACED_POOL) most units would find that they are in none of most draws. There each draw
    is first dealt to blocks of `block` units (BLOCK_UNITS) of a day, by hypergeometric numbers, and a block then picks that many of its
    own units without replacement: the same distribution, and no more work than there are units drawn.
    """
    from .joins import neighbourhood
    from .vectors import cohesion

    placed_pool, block = PLACED_POOL if placed_pool is None else placed_pool, BLOCK_UNITS if block is None else block
    units = saved(units.select(day, "unit_id", vector), "synchrony-units")
    seen = saved(cohesion(units, vector, [day]).where(F.col("n") >= least).withColumnRenamed("cohesion", "obs"), "synchrony-days")
    placed = in_strata(units.select(day, "unit_id", vector), "unit_id", day, [vector], [F.col("unit_id")]).select(F.col(day).alias("other"), vector, "_place", "_size")
    sizes = units.groupBy(F.col(day).alias("other")).agg(F.count("*").alias("m"))
    before = Window.partitionBy(day).orderBy("other").rowsBetween(Window.unboundedPreceding, -1)  # a row a day nearby
    near = neighbourhood(units.select(day), within, same_weekday, day).join(sizes, "other")
    near = near.withColumns({"start": F.coalesce(F.sum("m").over(before), F.lit(0)), "pool": F.sum("m").over(Window.partitionBy(day))})
    near = near.join(seen.select(day, F.col("n").alias("k")), day).where("pool >= k")
    near = saved(near.select(day, "other", "start", "pool", "k", "m"), "synchrony-pools")
    few = saved(near.where(F.col("pool") <= placed_pool).select(day, "other", "start", "pool", "k"), "synchrony-placed")
    pool = dealt_out(placed, "other", "_place").join(sized(few), "other")
    rows = pool.select(day, F.xxhash64(F.col(day).cast("string")).alias("name"), (F.col("start") + F.col("_place")).alias("place"), "pool", "k", F.col(vector).alias("x"))
    kind, arrow = units.schema[day].dataType.simpleString(), to_arrow_type(units.schema[day].dataType)

    def run(batches):
        import pyarrow as pa

        totals: dict = {}

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(totals), arrow), pa.array([t.tobytes() for t in totals.values()])], names=[day, "x"])

        for batch in batches:
            name, place, pool_, k = (np.asarray(batch.column(c)) for c in ("name", "place", "pool", "k"))
            x = np.asarray(batch.column("x").flatten(), float).reshape(-1, size)
            days = batch.column(day).to_pylist()
            for w in np.unique(name):
                mine = np.flatnonzero(name == w)
                for lo in range(0, len(mine), max(1, STEP // draws)):
                    part = mine[lo : lo + max(1, STEP // draws)]
                    inside = scattered(place[part], pool_[part], name[part].view(np.uint64), np.arange(draws)) < k[part][None]
                    made = inside.astype(float) @ x[part]
                    d = days[part[0]]
                    totals[d] = totals[d] + made if d in totals else made
            if len(totals) * draws * size > 8 * STEP:
                yield told()
                totals.clear()
        if totals:
            yield told()

    def one(ids, pdf):
        import pandas as pd

        t = np.sum([np.frombuffer(v).reshape(draws, size) for v in pdf["x"]], axis=0)
        return pd.DataFrame([{day: ids[0], "lengths": (t * t).sum(1)}])

    def picked(own, pools):
        import pandas as pd

        if not len(own) or not len(pools):
            return pd.DataFrame(columns=[day, "x"])
        x = np.stack(own.sort_values("_place")[vector].to_numpy()).astype(float)
        out = []
        for w, sizes_, turn, k, b in zip(pools[day], pools["sizes"], pools["turn"], pools["k"], pools["_block"], strict=True):
            edges, first = block_edges(np.asarray(sizes_, np.int64), block)
            leaf = int(first[turn] + b)
            rng = K.rng_of("picked", str(w), leaf)
            made = [x[rng.choice(len(x), c, replace=False, shuffle=False)].sum(0) for c in block_counts(leaf, edges, int(k), str(w), draws).tolist()]
            out.append((w, np.stack(made).tobytes()))
        return pd.DataFrame(out, columns=[day, "x"])

    made = rows.mapInArrow(run, f"{day} {kind}, x binary")
    many = near.where(F.col("pool") > placed_pool)
    if not many.isEmpty():
        pools = many.groupBy(day).agg(F.array_sort(F.collect_list(F.struct("other", "m", "k"))).alias("_p"))  # a day nearby each
        at = pools.select(day, F.transform("_p", lambda s: s["m"]).alias("sizes"), F.posexplode("_p").alias("turn", "_s"))
        blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("_s.m") - 1) / block).cast("int"))).alias("_block")
        at = at.select(F.col("_s.other").alias("other"), blocks, day, "sizes", "turn", F.col("_s.k").alias("k"))
        own = placed.select("other", F.floor(F.col("_place") / block).cast("int").alias("_block"), "_place", vector)
        keys = ("other", "_block")
        met = dealt_out(own, *keys).groupBy(*keys).cogroup(dealt_out(at, *keys).groupBy(*keys))
        made = made.unionByName(met.applyInPandas(picked, f"{day} {kind}, x binary"))
    sums = made.groupBy(day).applyInPandas(one, f"{day} {kind}, lengths array<double>")
    n = F.col("n")
    met = seen.join(sums, day).withColumn("_x", F.transform("lengths", lambda s: (s - n) / (n * (n - 1))))
    mean = F.aggregate("_x", F.lit(0.0), lambda a, v: a + v) / F.size("_x")
    met = met.withColumn("null_mean", mean)
    sd = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda a, v: a + (v - F.col("null_mean")) ** 2) / (F.size("_x") - 1))
    met = met.withColumn("null_sd", sd)
    beyond = F.size(F.filter("_x", lambda v: v >= F.col("obs") - 1e-12))
    return met.select(day, "n", "obs", "null_mean", "null_sd", (F.col("obs") - F.col("null_mean")).alias("excess"), F.try_divide(F.col("obs") - F.col("null_mean"), "null_sd").alias("z"), ((beyond + 1) / (F.size("_x") + 1)).alias("p"))
