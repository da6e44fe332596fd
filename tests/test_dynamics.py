"""Operators without SQL, held against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyhouse.functions import kernels as K
from tallyhouse.operators import graph as G
from tallyhouse.operators import inference as I
from tallyhouse.operators import joins as J
from tallyhouse.operators import nulls as N
from tallyhouse.operators import records as Rec
from tallyhouse.operators import sampling as S
from tallyhouse.operators import vectors as V
from tallyhouse.plans import catalog
from tests.conftest import SMALL

QUERIES = catalog.queries()


def test_nearest_breaks_ties_by_key(spark, monkeypatch):
    rng = np.random.default_rng(0)
    two = rng.normal(size=(2, 8))
    x = np.r_[np.repeat(two, 200, axis=0), rng.normal(size=(100, 8)), np.repeat(two[:1] * 2, 50, axis=0)]
    frame = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 12)
    np.fill_diagonal(sim, -np.inf)
    for size in (2048, 100):
        monkeypatch.setattr(J, "BLOCK_ROWS", size)
        got = J.nearest(frame.where("id % 50 = 0"), frame, "id", "v", 5).toPandas()
        for i, part in got.groupby("id"):
            assert part.sort_values("rank")["other"].tolist() == np.lexsort((np.arange(len(x)), -sim[i]))[:5].tolist()


def test_two_way_effects_equal_least_squares(spark):
    rng = np.random.default_rng(1)
    p, d = rng.integers(0, 30, 700), rng.integers(0, 12, 700)
    y = rng.normal(size=30)[p] + rng.normal(size=12)[d] + rng.normal(size=700)
    frame = spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(p, d, y)], "person int, day int, v double")
    got = I.two_way_effects(frame, "v", "person", "day").first()
    x = np.c_[np.eye(30)[p], np.eye(12)[d]]
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    a, b, e = beta[:30][p], beta[30:][d], y - x @ beta
    assert got.n_obs == 700 and got.rounds < 20
    assert (got.var_alpha, got.var_beta, got.var_resid, got.sigma2_dof) == pytest.approx((a.var(), b.var(), e.var(), e @ e / (700 - 30 - 12 + 1)), rel=1e-6)


def plain_auc(x, y, fold, ridge=1.0):
    wins = pairs = 0.0
    for f in np.unique(fold):
        train, test = fold != f, fold == f
        m, s = x[train].mean(0), x[train].std(0)
        z = np.c_[np.ones(len(x)), (x - m) / np.where(s > 0, s, 1)]
        beta, penalty = np.zeros(z.shape[1]), ridge * np.diag([0.0, *[1.0] * x.shape[1]])
        for _ in range(50):
            q = 1 / (1 + np.exp(-z[train] @ beta))
            step = np.linalg.solve((z[train] * (q * (1 - q))[:, None]).T @ z[train] + penalty + 1e-9 * np.eye(len(beta)), z[train].T @ (y[train] - q) - penalty @ beta)
            beta = beta + step
        score = z[test] @ beta
        gap = score[y[test] == 1][:, None] - score[y[test] == 0][None]
        wins, pairs = wins + (gap > 0).sum() + (gap == 0).sum() / 2, pairs + gap.size
    return wins / pairs


def test_folded_auc_equals_plain_fits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.1]
    y = (rng.random(400) < 1 / (1 + np.exp(-x[:, 0] - x[:, 1] / 5))).astype(int)
    fold, group = rng.integers(0, 4, 400), rng.integers(0, 2, 400)
    frame = spark.createDataFrame([(*map(float, r), int(a), int(b), int(c)) for r, a, b, c in zip(x, y, fold, group)], "a double, b double, c double, y int, fold int, g int")
    assert I.folded_auc(frame, ["a", "b", "c"], "y", "fold").first().auc == pytest.approx(plain_auc(x, y, fold), abs=2e-3)
    got = {r.g: r.auc for r in I.folded_auc(frame, ["a", "b", "c"], "y", "fold", ["g"]).collect()}
    assert got == pytest.approx({g: plain_auc(x[group == g], y[group == g], fold[group == g]) for g in (0, 1)}, abs=3e-3)
    assert I.folded_auc(frame.limit(0), ["a", "b", "c"], "y", "fold").first().auc is None


def test_shuffled_positions_keep_each_positions_values(spark, monkeypatch):
    monkeypatch.setattr(V, "SHUFFLE_ROWS", 100)
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding")
    one, two = (np.stack(d.toPandas().sort_values("vec_id")["embedding"].to_numpy()) for d in (e, V.shuffled_positions(e, "vec_id", "embedding")))
    assert (np.sort(one, axis=0) == np.sort(two, axis=0)).all() and (one != two).mean() > 0.9


def test_contrast_against_a_plain_bootstrap(spark):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(1, 1, 80), 1), np.round(rng.normal(0.4, 1, 120), 1)
    frames = [spark.createDataFrame([(float(v),) for v in x], "v double") for x in (a, b)]
    got = N.contrast(*frames, "v").first()
    d = np.array([rng.choice(a, 80).mean() - rng.choice(b, 120).mean() for _ in range(4000)])
    assert got.difference == pytest.approx(a.mean() - b.mean()) and (got.n_a, got.n_b) == (80, 120)
    assert (got.lo, got.hi) == pytest.approx(tuple(np.quantile(d, [0.025, 0.975])), abs=0.05)
    again = N.contrast(*(f.repartition(3) for f in frames), "v").first()
    assert tuple(again) == pytest.approx(tuple(got))


def test_power_by_injection_equals_loops(spark):
    rng = np.random.default_rng(4)
    n, at = 120, [20, 47, 90]
    v = rng.normal(size=n)
    days = pd.date_range("2020-01-01", periods=n)
    series = spark.createDataFrame([(d.date(), float(x)) for d, x in zip(days, v)], "day date, v double")
    events = spark.createDataFrame([(days[k].date(),) for k in at], "day date")
    got = {r.delta: r for r in N.injected_power(series, events, "v", [0.0, 1.0, 5.0], rotations=n).collect()}

    def effect(x):
        return np.mean([x[k : k + 7].mean() - x[k - 7 : k].mean() for k in at])

    turned = [np.roll(v, -t) for t in range(n)]
    sd = np.std([effect(x) for x in turned], ddof=1)
    for delta in (0.0, 1.0, 5.0):
        hits = []
        for x in turned:
            x = x.copy()
            for k in at:
                x[k : k + 7] += delta
            hits.append(abs(effect(x)) > 1.96 * sd)
        assert got[delta].power == pytest.approx(np.mean(hits)) and got[delta].null_sd == pytest.approx(sd)
    assert got[5.0].power > 0.9


def test_nulls_of_associations_equal_single_ones():
    rng = np.random.default_rng(5)
    y, x = rng.normal(size=60).cumsum(), rng.normal(size=60).cumsum()
    for kind in ("iaaft", "phase", "shuffle", "ar1", "bootstrap"):
        xs = K.surrogates(kind, x, np.random.default_rng(6), 7)
        assert xs.shape == (7, 60)
        for name, f in K.ASSOCIATIONS.items():
            assert K.association_null(name, y, xs) == pytest.approx([f(y, r) for r in xs])
        if kind in ("iaaft", "shuffle"):
            assert (np.sort(xs, axis=1) == np.sort(x)).all()
    wanted = np.abs(np.fft.rfft(x))[1:8]
    assert np.abs(np.fft.rfft(K.surrogates("iaaft", x, np.random.default_rng(6), 5)))[:, 1:8] == pytest.approx(np.tile(wanted, (5, 1)), rel=0.35)


def test_scan_takes_all_draws_where_it_is_close(spark):
    from tallyhouse.operators import coupling as C

    rng = np.random.default_rng(7)
    x = rng.normal(size=80)
    rows = [("tied", t, float(x[t] + 0.1 * rng.normal()), float(x[t])) for t in range(80)] + [("free", t, float(rng.normal()), float(x[t])) for t in range(80)]
    frame = spark.createDataFrame(rows, "name string, t int, y double, x double")
    got = {(r.name, r.statistic): r for r in C.surrogate_scan(frame, ["name"], ("pearson", "dcor"), screen=50, refine=1000, block=300).collect()}
    assert got["tied", "pearson"].n_null == 1000 and got["tied", "pearson"].p == pytest.approx(1 / 1001)
    assert {r.n_null for r in got.values()} <= {50, 1000} and got["free", "pearson"].observed == pytest.approx(np.corrcoef([r[2] for r in rows[80:]], x)[0, 1])


def test_wave_and_axes_equal_plain_ones(spark):
    o = pd.read_parquet(f"{SMALL}/orders.parquet")
    o["week"] = pd.to_datetime(o["o_orderdate"]).dt.to_period("W-SUN").dt.start_time
    pri = o["o_orderpriority"].str[0]
    i = o.assign(r=pri.astype(int)).groupby("week").agg(volume=("o_totalprice", "size"), rank=("r", "mean"), total=("o_totalprice", "sum")).astype(float)
    z = (i - i.mean()) / i.std()
    v = np.linalg.eigh(z.T @ z)[1][:, -1]
    wave = z @ (v if v[0] > 0 else -v)
    got = {r.axis: r for r in QUERIES["cohort_axes_against_wave"](spark, SMALL).collect()}
    for axis, part in o.groupby(pri):
        both = pd.concat([part.groupby("week")["o_totalprice"].mean().rename("y"), wave.rename("w")], axis=1).dropna()
        assert got[axis].r == pytest.approx(np.corrcoef(both["y"], both["w"])[0, 1], abs=1e-6) and got[axis].n == len(both)
        rolled = [np.corrcoef(np.roll(both["y"], k), both["w"])[0, 1] for k in range(len(both))]
        assert got[axis].p == pytest.approx(np.mean(np.abs(rolled) >= abs(rolled[0]) - 1e-9), abs=1e-6)


def test_scalars_of_long_correlations(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4))
    frame = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, a double, b double, c double, d double")
    got = G.scalars(G.correlations(frame, list("abcd"), ["g"]), ["g"]).first()
    want = K.network_scalars(K.rank_correlations(x))
    assert (got.mean_abs_rho, got.lambda1_share, got.participation_ratio) == pytest.approx((want["mean_abs_rho"], want["lambda1_share"], want["participation_ratio"]))


def test_numbers_follow_the_order_without_one_task(spark):
    frame = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(6)
    numbered = S.numbered(frame, "k", [-F.col("k")])
    assert [r.number for r in numbered.orderBy(F.desc("k")).collect()] == list(range(1, 5001))
    assert S.numbered(frame.limit(0), "k", [F.col("k")]).count() == 0


def test_scores_that_do_not_match_sentences_are_an_error(spark):
    scores = spark.createDataFrame([(1, k, float(k)) for k in range(5)] + [(2, k, float("nan")) for k in range(4)], "id int, pos int, s double")
    counts = spark.createDataFrame([(1, 5), (2, 4)], "id int, n_sent int")
    assert [(r.id, r.vals) for r in Rec.true_records(scores, counts, "id", "s").collect()] == [(1, [0.0, 1.0, 2.0, 3.0, 4.0])]
    with pytest.raises(PySparkException):
        Rec.true_records(scores, counts.withColumn("n_sent", F.lit(6)), "id", "s").collect()
    some = Rec.sentence_build(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id", "text", limit=7)
    assert some.select("doc_id").distinct().count() <= 7


def test_no_rows_of_texts_meet_in_one_task(spark):
    for name in ("length_matched_texts", "shuffled_spectrum", "forward_against_reversed", "network_scalars"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.split("\n") if "SinglePartition" in line and "text" in line], name
