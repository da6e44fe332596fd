"""Bootstraps, flips, matchings and synchrony made where the rows are, against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import permutations as M
from tallyhouse.operators import replicates as R
from tallyhouse.operators import sampling as S
from tallyhouse.plans import catalog
from tests.conftest import SMALL


def hashes(spark, names, *more):
    """Spark's hash of each name as text."""
    df = spark.createDataFrame([(str(n),) for n in names], "n string").select("n", F.xxhash64("n", *more).alias("h"))
    at = {r.n: r.h for r in df.collect()}
    return np.array([at[str(n)] for n in names])


def test_weights_and_signs():
    w = R.weights(np.arange(200), np.arange(2000), 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08
    assert (w[:, 3:7] == R.weights(np.arange(3, 7), np.arange(2000), 1)).all()
    assert abs(R.signs(np.arange(200), np.arange(2000), 1).mean()) < 0.01


def test_means_by_bootstraps_and_flips(spark):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0.4, 1, 60), rng.normal(0, 1, 40)]
    g = ["a"] * 60 + ["b"] * 40
    frame = spark.createDataFrame([(f"p{i}", g[i], float(v)) for i, v in enumerate(x)] + [("none", "a", None)], "who string, g string, v double").repartition(6)
    got = {r.g: r for r in R.resampled_means(frame, "who", "v", ["g"], 500, 800).collect()}
    for k, at in (("a", slice(0, 60)), ("b", slice(60, 100))):
        name, v = hashes(spark, [f"p{i}" for i in range(100)])[at], x[at]
        w, f = R.weights(name, np.arange(500), 0), R.signs(name, np.arange(800), 1)
        boot = (w @ v) / w.sum(1)
        p = (1 + (np.abs(f @ v / len(v)) >= abs(v.mean())).sum()) / 801
        r = got[k]
        assert (r.mean, r.lo, r.hi, r.p, r.n) == pytest.approx((v.mean(), *np.quantile(boot, [0.025, 0.975]), p, len(v)))
    assert got["a"].p < 0.05


def test_matchings_over_seeds(spark):
    rng = np.random.default_rng(2)
    n = 400
    side, k = (rng.random(n) < 0.35).astype(int), rng.integers(3, 7, n)
    who = np.where(side == 1, rng.integers(0, 20, n), rng.integers(20, 60, n))
    x = rng.normal(size=n) + 0.8 * side
    frame = spark.createDataFrame([(i, int(side[i]), int(k[i]), int(who[i]), float(x[i])) for i in range(n)], "i long, side int, k int, who int, x double").repartition(5)
    each = R.matched_over_seeds(frame, "i", "side", "k", "who", "x", seeds=6, draws=200)
    got = {r.seed: r for r in each.collect()}
    for s in range(6):
        drawn = []
        for y in (0, 1):
            for c in range(3, 7):
                own = np.flatnonzero((side == y) & (k == c))
                name = np.full(len(own), hashes(spark, [f"{y}|{c}"])[0]).view(np.uint64)
                to = M.scattered(np.arange(len(own)), np.full(len(own), len(own)), name, np.array([s]))[0]
                drawn += own[to < min(((side == 0) & (k == c)).sum(), ((side == 1) & (k == c)).sum())].tolist()
        d = pd.DataFrame({"side": side[drawn], "who": who[drawn], "x": x[drawn]}).groupby(["side", "who"])["x"].mean()
        a, b = d.loc[1], d.loc[0]
        boots = []
        for part, y in ((a, "1"), (b, "0")):
            name = hashes(spark, part.index.astype(str), F.lit(y))
            w = R.weights(name, np.arange(200), 0)
            boots.append((w @ part.to_numpy()) / w.sum(1))
        d = boots[0] - boots[1]
        p = min(1.0, 2 * min((1 + (d <= 0).sum()) / 201, (1 + (d >= 0).sum()) / 201))
        assert (got[s].difference, got[s].p, got[s].n_1, got[s].n_0) == pytest.approx((a.mean() - b.mean(), p, len(a), len(b)))
    told = R.over_seeds(each).first()
    assert told.seeds == 6 and told.p_least <= told.p_median <= told.p_most and told.difference == pytest.approx(np.median([r.difference for r in got.values()]))


def test_synchrony_is_the_plain_one(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(12):
        turn = rng.uniform(0, 6.28) if d == 5 else 0.0
        for u in range(int(rng.integers(2, 9))):
            a = rng.normal(turn, 0.4 if d == 5 else 2.0)
            rows.append((d, u * 100 + d, float(np.cos(a)), float(np.sin(a))))
    units = spark.createDataFrame(rows, "d int, unit_id int, x double, y double").select(F.expr("date_add(date'2024-01-01', d)").alias("day"), "unit_id", F.array("x", "y").alias("u")).repartition(3)
    got = {r.day.day - 1: r for r in R.synchrony(units, "u", 2, within=4, draws=150, same_weekday=False).collect()}
    x = pd.DataFrame(rows, columns=["d", "u", "x", "y"]).sort_values(["d", "u"])
    for d in range(12):
        own = x[x["d"] == d][["x", "y"]].to_numpy()
        k = len(own)
        pool = x[(x["d"] != d) & ((x["d"] - d).abs() <= 4)][["x", "y"]].to_numpy()
        if k < 3:
            assert d not in got
            continue
        name = np.full(len(pool), hashes(spark, [f"2024-01-{d + 1:02d}"])[0]).view(np.uint64)
        inside = M.scattered(np.arange(len(pool)), np.full(len(pool), len(pool)), name, np.arange(150)) < k
        assert (inside.sum(1) == k).all()
        null = ((inside @ pool) ** 2).sum(1)
        null, obs = (null - k) / (k * (k - 1)), ((own.sum(0) ** 2).sum() - k) / (k * (k - 1))
        r = got[d]
        assert (r.n, r.obs, r.null_mean, r.null_sd, r.p) == pytest.approx((k, obs, null.mean(), null.std(ddof=1), (1 + (null >= obs - 1e-12).sum()) / 151))


def test_draws_dealt_to_blocks():
    sizes, block = np.array([40, 7, 23]), 16
    edges, first = R.block_edges(sizes, block)
    assert edges.tolist() == [0, 16, 32, 40, 47, 63, 70] and first.tolist() == [0, 3, 4]
    counts = np.stack([R.block_counts(leaf, edges, 25, "d", 4000) for leaf in range(6)])
    size = np.diff(edges)
    assert (counts.sum(0) == 25).all() and (counts <= size[:, None]).all() and (counts >= 0).all()
    assert counts.mean(1) == pytest.approx(25 * size / 70, rel=0.02)
    spread = 25 * size / 70 * (1 - size / 70) * (45 / 69)
    assert counts.var(1) == pytest.approx(spread, rel=0.12)


def test_synchrony_of_large_pools(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(0, 1.5, 900)
    rows = [(i // 150, i, float(np.cos(v)), float(np.sin(v))) for i, v in enumerate(a)]
    units = spark.createDataFrame(rows, "d int, unit_id int, x double, y double").select(F.expr("date_add(date'2024-01-01', d)").alias("day"), "unit_id", F.array("x", "y").alias("u"))
    made = lambda parts, **kw: {r.day.day - 1: r for r in R.synchrony(units.repartition(parts), "u", 2, within=4, same_weekday=False, **kw).collect()}
    got, again, placed = made(3, placed_pool=0, block=32), made(5, placed_pool=0, block=32), made(3)
    mixed = made(3, placed_pool=700, block=32)  # the first and the last day have 600 places, the others 750
    x = np.c_[np.cos(a), np.sin(a)]
    for d in range(6):
        r, pool = got[d], x[[i for i in range(900) if i // 150 != d and abs(i // 150 - d) <= 4]]
        n = len(pool)
        mean = ((pool.sum(0) ** 2).sum() - n) / (n * (n - 1))  # of all the pool's pairs, and so of a draw's
        assert r.null_mean == pytest.approx(mean, abs=4 * r.null_sd / math.sqrt(1000))
        assert (r.n, r.obs) == (placed[d].n, placed[d].obs) and r.null_sd == pytest.approx(placed[d].null_sd, rel=0.12) and abs(r.p - placed[d].p) < 0.08
        assert again[d].null_mean == pytest.approx(r.null_mean, rel=1e-9)
        assert mixed[d].null_mean == pytest.approx((placed if d in (0, 5) else got)[d].null_mean, rel=1e-9)


def test_days_beyond_chance(spark):
    rng = np.random.default_rng(4)
    p = np.where(rng.random(90) < 0.2, 0.01, rng.random(90))
    z = rng.normal(0.3, 1.2, 90)
    frame = spark.createDataFrame([(d, float(a), float(b), float(b) * 0.01) for d, (a, b) in enumerate(zip(p, z, strict=True))], "day int, p double, z double, excess double").repartition(4)
    r = R.excess_of_days(frame, "day").first()
    low, high = int((p < 0.05).sum()), int((p > 0.95).sum())
    tail = lambda k, q: sum(math.comb(90, j) * q**j * (1 - q) ** (90 - j) for j in range(k, 91))
    assert (r.n, r.n_low, r.n_high) == (90, low, high)
    assert (r.p_low, r.p_high, r.sign_p) == pytest.approx((tail(low, 0.05), tail(high, 0.05), tail(int((z > 0).sum()), 0.5)))
    assert (r.rate_low, r.mean_excess, r.stouffer_z, r.sd_z) == pytest.approx((low / 90, z.mean() * 0.01, z.sum() / math.sqrt(90), z.std(ddof=1)))
    x = (p < 0.05).astype(float)
    means = []
    from tallyhouse.functions import kernels as K

    for b in range(10):
        starts = K.rng_of("blocks", b).integers(0, 90, (500, 13))
        means += x[((starts[:, :, None] + np.arange(7)) % 90).reshape(500, -1)[:, :90]].mean(1).tolist()
    means.sort()
    assert (r.low_lo, r.low_hi) == pytest.approx((means[math.ceil(5000 * 0.025) - 1], means[math.ceil(5000 * 0.975) - 1]))
    assert r.low_lo > 0.05  # beyond chance


def test_reliability_over_splits(spark):
    rng = np.random.default_rng(5)
    level = np.repeat(rng.normal(0, 1, 20), 30)
    rows = [(i, int(i % 20), float(level[(i % 20) * 30] + rng.normal(0, 2))) for i in range(1200)]
    frame = spark.createDataFrame(rows, "u int, d int, v double")
    got = R.reliability(S.halves(frame, "v", "d", "u", 8), "d", draws=100).first()
    each = [r.r for r in S.split_half(frame, "v", "d", "u", 8).collect()]
    r = np.mean(each)
    assert (got.r, got.reliability, got.splits, got.periods) == pytest.approx((r, 2 * r / (1 + r), 8, 20)) and got.lo < got.reliability < got.hi


@pytest.mark.parametrize("name", ["synchrony_against_near_days", "synchrony_summary", "drift_bootstrap", "matched_contrast_over_seeds", "reliability_interval"])
def test_registered(spark, name):
    rows = catalog.queries()[name](spark, SMALL).collect()
    assert rows and all(v is not None for r in rows for v in r)
