"""Clouds, arcs, networks and episodes against their nulls, and plain versions of each."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import kernels as K
from tallyhouse.operators import geometry as G
from tallyhouse.operators import nulls as N
from tallyhouse.operators import permutations as M
from tallyhouse.plans import catalog
from tallyhouse.sources.tables import daily_orders
from tests.conftest import SMALL


def test_normals():
    z = G.normals(np.arange(4000, dtype=np.uint64), 5, 1)
    assert z.shape == (4000, 5) and np.abs(z.mean(0)).max() < 0.06 and np.cov(z.T) == pytest.approx(np.eye(5), abs=0.08)
    assert (z[7:9] == G.normals(np.arange(7, 9, dtype=np.uint64), 5, 1)).all()


def test_clouds_against_copies(spark):
    rng = np.random.default_rng(1)
    flat = rng.normal(size=(700, 2))
    x = np.c_[flat, np.sin(flat[:, :1]), np.cos(flat[:, 1:]), flat[:, :1] * flat[:, 1:], rng.normal(0, 0.01, (700, 1))]  # two dimensions in six
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").repartition(4)
    got = {r.variant: r for r in G.against_nulls(frame, "i", "v", 6, sample=5000, seeds=3, thetas=(0.9, 0.97), pairs=400).collect()}
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    real = got["real"]
    assert real.n == 700 and real.seeds == 3 and real.two_nn_least == real.two_nn_most == pytest.approx(K.two_nn(u))
    plain = K.percolation(u, [0.9, 0.97])
    assert (real.giant_0, real.singletons_0, real.giant_1, real.singletons_1) == pytest.approx((plain[0][1], plain[0][4], plain[1][1], plain[1][4]))
    assert real.mean_cosine == pytest.approx((u @ u.T)[np.triu_indices(700, 1)].mean())
    assert real.two_nn_median < 3 < min(got[k].two_nn_median for k in ("shuffled", "gaussian", "sphere")) and got["sphere"].two_nn_median > 4
    assert got["sphere"].participation_ratio > 5.8 > got["gaussian"].participation_ratio > real.participation_ratio - 1


def test_samples_differ_by_seed(spark):
    frame = spark.createDataFrame([(i, [float(i), float(i * i % 7)]) for i in range(300)], "i long, v array<double>").repartition(3)
    got = G.sampled_copies(frame, "i", "v", 2, 50, 4).toPandas()
    held = got[got["variant"] == "real"].groupby("seed")["i"].agg(frozenset)
    assert all(len(s) == 50 for s in held) and len(set(held)) == 4
    cov = np.cov(np.stack(got[got["variant"] == "gaussian"]["x"]).T)
    assert cov[0, 0] == pytest.approx(np.var(np.arange(300)), rel=0.3)


def test_arcs_against_their_order(spark):
    rng = np.random.default_rng(2)
    docs = {f"d{i}": (rng.normal(0, 1, k) + 2.5 * np.linspace(-1, 1, k) * rng.normal()).tolist() for i, k in enumerate(rng.integers(5, 40, 150))}
    frame = spark.createDataFrame([(k, v) for k, v in docs.items()] + [("short", [1.0]), ("odd", [1.0, float("nan"), 2.0])], "k string, v array<double>").repartition(4)
    got = sorted(G.arc_order_control(frame, "k", "v", draws=12).collect(), key=lambda r: r.mode)
    names = {r.k: r.h for r in frame.select("k", F.xxhash64("k").alias("h")).collect()}

    def basis(values):
        a = np.array([np.interp(np.linspace(0, len(v) - 1, 20), np.arange(len(v)), v) for v in values])
        a -= a.mean(1, keepdims=True)
        m = a.mean(0)
        _, s, vt = np.linalg.svd(a - m, full_matrices=False)
        return (s**2 / (s**2).sum())[:3], vt[:3], m[-3:].mean() - m[:3].mean()

    share, modes, ends = basis(docs.values())
    shares, cosines, all_ends = [], [], []
    for b in range(12):
        dealt = []
        for k, v in docs.items():
            to = M.scattered(np.arange(len(v)), np.full(len(v), len(v)), np.full(len(v), names[k]).view(np.uint64), np.array([b]))[0]
            w = np.empty(len(v))
            w[to] = v
            dealt.append(w)
        s, m, e = basis(dealt)
        at = G.matched_modes(modes, m)
        shares.append(s[at]), cosines.append(np.abs((modes * m[at]).sum(1))), all_ends.append(e)
    for k, r in enumerate(got):
        assert (r.share, r.share_shuffled, r.cosine, r.ends, r.ends_shuffled, r.n) == pytest.approx((share[k], np.mean(shares, 0)[k], np.mean(cosines, 0)[k], ends, np.mean(all_ends), 150))
        assert r.p == pytest.approx((1 + sum(s[k] >= share[k] for s in shares)) / 13)
    assert got[0].p == pytest.approx(1 / 13) and got[0].share > 2 * got[0].share_shuffled


def test_modes_are_matched_whatever_their_sign():
    a = np.eye(3)
    assert G.matched_modes(a, -a[[2, 0, 1]]).tolist() == [1, 2, 0]


def test_networks_against_turns(spark):
    rng = np.random.default_rng(3)
    n = 600
    day = np.sort(rng.integers(0, 40, n))
    a = rng.normal(size=n)
    b = np.where((day >= 10) & (day < 20), a, 0) + rng.normal(0, 0.4, n)
    c = rng.integers(0, 5, n).astype(float)
    who = rng.integers(0, 30, n)
    frame = spark.createDataFrame([(i, int(day[i]), int(who[i]), float(a[i]), float(b[i]), float(c[i])) for i in range(n)] + [(9999, 3, 1, None, 1.0, 1.0)], "i long, d int, u int, a double, b double, c double").withColumn("d", F.expr("date_add(date'2024-03-01', d)")).repartition(4)
    got = G.rotated_networks(frame, ["a", "b", "c"], "i", "d", "u", 10, 5, 100, 5, draws=40).toPandas()
    r = pd.DataFrame({"a": a, "b": b, "c": c}).rank().to_numpy()
    turns = np.r_[0, K.rng_of("rotation", n).integers(0, n, 40)]
    wanted = 0
    for start in range(0, 31, 5):
        inside = (day >= start) & (day < start + 10)
        if inside.sum() < 100 or len(set(who[inside])) < 5:
            continue
        values = []
        for t in turns:
            values.append(K.network_scalars(np.corrcoef(np.roll(r, t, axis=0)[inside].T)))
        for name in values[0]:
            x = np.array([v[name] for v in values])
            row = got[(pd.to_datetime(got["start"]) == pd.Timestamp("2024-03-01") + pd.Timedelta(days=start)) & (got["scalar"] == name)].iloc[0]
            m = x[1:].mean()
            p = (1 + (np.abs(x[1:] - m) >= abs(x[0] - m)).sum()) / 41
            assert (row["observed"], row["null_mean"], row["p"], row["n"], row["people"]) == pytest.approx((x[0], m, p, inside.sum(), len(set(who[inside]))))
            wanted += 1
    assert wanted == len(got) > 6 and got["p"].min() < 0.06


def test_run_ups_are_the_plain_ones(spark):
    d = daily_orders(spark, SMALL)
    x = d.toPandas().sort_values("day")["v"].to_numpy(float)
    s = pd.Series(x)
    var, ac = s.rolling(28, min_periods=14).var().to_numpy(), K.rolling_ar1(x, 28)
    taus, kept = N._run_ups(x[None], 28, 42)[0]
    plain = []
    for ind in (var, ac):
        each = []
        for t in kept:
            seg = ind[max(0, t - 42) : t]
            seg = seg[np.isfinite(seg)]
            each.append(K.kendall_b(np.arange(len(seg)), seg) if len(seg) >= 10 else np.nan)
        plain.append(np.array(each))
    for got, want in zip(taus, plain, strict=True):
        assert got == pytest.approx(want, nan_ok=True)
    draws = N.warning_draws(d, "v", draws=20, families=("ar1", "bootstrap"))
    got = N.episode_jackknife(d, draws, "v").toPandas()
    null = draws.toPandas()
    assert len(null) == 2 * 2 * 21
    for (family, indicator), part in got.groupby(["family", "indicator"]):
        tau = plain[0 if indicator == "variance" else 1]
        tau = tau[np.isfinite(tau)]
        part = part.sort_values("episode")
        assert part["tau"].to_numpy() == pytest.approx(tau)
        without = np.array([np.delete(tau, k).mean() for k in range(len(tau))])
        assert part["tau_without"].to_numpy() == pytest.approx(without)
        own = null[(null["family"] == family) & (null["indicator"] == indicator) & (null["draw"] >= 0)]["tau"].to_numpy()
        assert part["p_without"].to_numpy() == pytest.approx([(1 + (own >= w).sum()) / 21 for w in without])


@pytest.mark.parametrize("name, rows", [("rotated_network", 0), ("arc_order_control", 3), ("geometry_against_nulls", 4), ("warning_pipeline", 10)])
def test_registered(spark, name, rows):
    got = catalog.queries()[name](spark, SMALL).collect()
    assert len(got) >= rows
