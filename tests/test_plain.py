"""Registered queries without SQL, held against plain numpy, pandas and Python versions over whole tables."""

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import kernels as K
from tallyhouse.functions import scoring
from tallyhouse.functions import text as X
from tallyhouse.operators import nulls as N
from tallyhouse.operators import vectors as V
from tallyhouse.plans import catalog
from tests.conftest import SMALL

QUERIES = catalog.queries()


def parquet(name):
    return pd.read_parquet(f"{SMALL}/{name}.parquet")


def events():
    e = parquet("events")
    e["day"] = pd.to_datetime(e["ts"]).dt.normalize()
    return e


def daily():
    o = parquet("orders")
    o["day"] = pd.to_datetime(o["o_orderdate"])
    return o.groupby("day")["o_totalprice"].agg(["mean", "size", "std"]).sort_index()


def weekly():
    o = parquet("orders")
    o["week"] = pd.to_datetime(o["o_orderdate"]).dt.to_period("W-SUN").dt.start_time
    o["x"] = o["o_orderpriority"].str[0].astype(int)
    return o.groupby("week").agg(y=("o_totalprice", "mean"), x=("x", "mean")).sort_index()


def shift_p(x, y):
    r = [np.corrcoef(x, np.roll(y, k))[0, 1] for k in range(len(x))]
    return r[0], np.mean(np.abs(r) >= abs(r[0]) - 1e-9)


def test_level_and_difference(spark):
    got = QUERIES["level_and_difference_coupling"](spark, SMALL).first()
    w = weekly()
    r, p = shift_p(w["x"].to_numpy(), w["y"].to_numpy())
    d = w.diff().dropna()
    rd, pd_ = shift_p(d["x"].to_numpy(), d["y"].to_numpy())
    assert (got.r_level, got.p_level, got.r_diff, got.p_diff) == pytest.approx((r, p, rd, pd_), abs=1e-6)
    n = len(w)
    lags = {k: np.corrcoef(w["y"][max(k, 0) : n + min(k, 0)], w["x"][max(-k, 0) : n - max(k, 0)])[0, 1] for k in range(-8, 9)}
    best = min(lags, key=lambda k: (-abs(lags[k]), k))
    assert got.best_lag == best and got.best_r == pytest.approx(lags[best])


def test_weekday_models(spark):
    e = events()
    d = e.groupby("day")["value"].mean().sort_index()
    t = (d.index - d.index.min()).days.to_numpy(float)
    trend = (t - t.mean()) / (t.std() + 1e-9)
    dow = np.stack([(d.index.weekday == k).astype(float) for k in range(1, 7)], 1)
    full, less = np.c_[np.ones(len(d)), trend, dow], np.c_[np.ones(len(d)), trend]

    def ssr(x):
        e_ = d.to_numpy() - x @ np.linalg.lstsq(x, d.to_numpy(), rcond=None)[0]
        return e_ @ e_

    f = ((ssr(less) - ssr(full)) / 6) / (ssr(full) / (len(d) - 8))
    assert QUERIES["weekday_joint_f"](spark, SMALL).first().f == pytest.approx(f)

    two = e[e["day"].dt.weekday.isin([0, 4])]
    x, y = np.c_[np.ones(len(two)), (two["day"].dt.weekday == 4).astype(float)], two["value"].to_numpy()
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    u = y - x @ beta

    def covariance(groups):
        s = pd.DataFrame(x * u[:, None]).groupby(np.asarray(groups)).sum().to_numpy()
        g = len(s)
        return inverse @ s.T @ s @ inverse * (g / (g - 1)) * ((len(y) - 1) / (len(y) - 2))

    a, b, both = covariance(two["user_id"]), covariance(two["day"]), covariance(two["user_id"].astype(str) + "|" + two["day"].astype(str))
    got = {r.term: r for r in QUERIES["weekday_contrast_two_way"](spark, SMALL).collect()}["friday"]
    assert (got.beta, got.se_0, got.se_1, got.se_two_way) == pytest.approx((beta[1], math.sqrt(a[1, 1]), math.sqrt(b[1, 1]), math.sqrt(max(0, (a + b - both)[1, 1]))))
    seen = QUERIES["weekday_label_permutation"](spark, SMALL).first()
    assert seen.observed == pytest.approx(two[two["day"].dt.weekday == 4]["value"].mean() - two[two["day"].dt.weekday == 0]["value"].mean())


def test_deseasonalised_residual(spark):
    d = daily()
    d = d[d["size"] >= 3]
    t = (d.index - d.index.min()).days.to_numpy(float)
    n = d["size"].to_numpy(float)
    a = 2 * np.pi * d.index.dayofyear.to_numpy() / 365.25
    x = np.c_[np.ones(len(d)), (t - t.mean()) / (t.std() + 1e-9), np.log(n), np.stack([(d.index.weekday == k).astype(float) for k in range(1, 7)], 1), np.sin(a), np.cos(a), np.sin(2 * a), np.cos(2 * a)]
    w = np.sqrt(n)[:, None]
    beta = np.linalg.lstsq(x * w, d["mean"].to_numpy() * w[:, 0], rcond=None)[0]
    want = (d["mean"] - x @ beta) / (d["std"] / np.sqrt(n) + 1e-9)
    got = QUERIES["deseasonalised_residual"](spark, SMALL).toPandas().set_index("day")
    seen = got[got["observed"].astype(bool)]["resid"]
    assert seen.to_numpy() == pytest.approx(want.loc[pd.to_datetime(seen.index)].to_numpy(), rel=1e-6, abs=1e-6)
    full = want.reindex(pd.date_range(want.index.min(), want.index.max())).interpolate()
    assert got.sort_index()["resid"].to_numpy() == pytest.approx(full.to_numpy(), rel=1e-6, abs=1e-6)


def test_principal_directions(spark):
    e = parquet("embeddings")
    x = np.stack(e["embedding"].to_numpy()).astype(float)
    lam = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]
    got = QUERIES["principal_spectrum"](spark, SMALL).first()
    share = np.cumsum(lam) / lam.sum()
    assert got.participation_ratio == pytest.approx(lam.sum() ** 2 / (lam**2).sum()) and (got.dims50, got.dims80, got.dims90) == tuple(int(np.searchsorted(share, q)) + 1 for q in (0.5, 0.8, 0.9))
    y = e["label"].to_numpy(float)
    c = x - x.mean(0)
    beta = np.linalg.solve(c.T @ c + 10 * np.eye(64), c.T @ (y - y.mean()))
    assert QUERIES["ridge_valence_axis"](spark, SMALL).first().r == pytest.approx(np.corrcoef(x @ beta, y)[0, 1])


def test_components_of_sparse_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)) * [9, 6, 4, 2] @ rng.normal(size=(4, 30)) * (rng.random((60, 30)) < 0.7)
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    values, basis = V.leading_directions(spark.createDataFrame(rows, "r int, f int, w double"), "r", "f", "w", 30, 3, rounds=40)
    _, s, vt = np.linalg.svd(x)
    assert values == pytest.approx(s[:3], rel=1e-3) and np.abs(np.sum(basis * vt[:3].T, axis=0)) == pytest.approx(np.ones(3), abs=1e-2)


def test_grams_of_whole_texts():
    texts = ["the cat", "", None, "Ab  cd\nefgh " * 400, "é日本語 x"]
    for text, (feature, count) in zip(texts, X.gram_counts(texts, features=1 << 40)):
        want = Counter()
        for word in (text or "").lower().split():
            for n in (3, 4, 5):
                padded = f" {word} "
                want.update(padded[k : k + n] for k in range(len(padded) - n + 1))
        assert sorted(count.tolist()) == sorted(want.values()) and len(set(feature.tolist())) == len(want)


def test_arcs(spark):
    arcs = np.array([r.arc for r in trajectories_resampled(spark)])
    c = np.cov((arcs - arcs.mean(1, keepdims=True)).T, bias=True)
    lam = np.sort(np.linalg.eigvalsh(c))[::-1]
    got = sorted(QUERIES["arc_modes"](spark, SMALL).collect(), key=lambda r: r.mode)
    assert [r.share for r in got] == pytest.approx((lam / lam.sum())[:3]) and np.linalg.norm(got[0].shape) == pytest.approx(1)
    counted = QUERIES["arc_classes"](spark, SMALL).toPandas()
    a, z = arcs[:, :3].mean(1), arcs[:, -3:].mean(1)
    assert counted["n"].sum() >= len(arcs) and counted[counted["shape"].str.startswith("rise")]["n"].sum() >= (z - a > 0.15).sum()


def trajectories_resampled(spark):
    from tallyhouse.functions import arrays as A
    from tallyhouse.plans.text import trajectories

    return trajectories(spark, SMALL, 5).select(A.resample(F.col("v")).alias("arc")).collect()


def test_person_shuffles_keep_each_persons_sum(spark):
    e = events()
    frame = spark.createDataFrame(e[["user_id", "value"]].assign(day=e["day"].dt.date))
    sums = N.shuffled_sums(frame, "user_id", "day", [F.col("value"), F.lit(1.0)], 120).toPandas()
    by_draw = sums.groupby("draw")["s"].apply(lambda s: np.sum(np.stack(s), axis=0))
    assert len(by_draw) == 121 and np.stack(by_draw)[:, 0] == pytest.approx(np.full(121, e["value"].sum())) and (np.stack(by_draw)[:, 1] == len(e)).all()
    counts = sums.groupby("draw")["n"].sum()
    assert (counts == len(e)).all()
    seen = {str(r.day): r.s[0] for r in sums[sums["draw"] == -1].itertuples()}
    assert seen == pytest.approx({str(d.date()): v for d, v in e.groupby("day")["value"].sum().items()})
    again = N.shuffled_sums(frame.repartition(5), "user_id", "day", [F.col("value"), F.lit(1.0)], 120).toPandas()
    key = ["draw", "day"]
    assert np.stack(again.sort_values(key)["s"]) == pytest.approx(np.stack(sums.sort_values(key)["s"]))
    # a person with one report keeps it: what a day sums to varies with the others' reports alone
    spread = np.stack(sums[sums["draw"] >= 0].groupby("day")["s"].apply(lambda s: np.stack(s)[:, 0].std()))
    assert (spread > 0).all()


def test_day_effects_against_shuffles(spark):
    rng = np.random.default_rng(2)
    rows = [(u, d, float(rng.normal() + (3 if d == 4 else 0))) for u in range(20) for d in range(8)]
    frame = spark.createDataFrame(rows, "u int, d int, v double")
    got = N.day_effect_null(frame, "v", "d", "u", 200).first()
    x = pd.DataFrame(rows, columns=["u", "d", "v"])
    g = x.groupby("d")["v"]
    msb = (g.size() * (g.mean() - x["v"].mean()) ** 2).sum() / 7
    msw = ((x["v"] - g.transform("mean")) ** 2).sum() / (160 - 8)
    assert got.observed == pytest.approx(msb / msw) and got.p == pytest.approx(1 / 201) and 0.5 < got.null_mean < 1.6


def test_neighbours_that_stay(spark):
    rng = np.random.default_rng(3)
    x = {p: rng.normal(size=(30, 3)) for p in (1, 2)}
    x[2] = x[1] + 0.3 * x[2]
    frame = spark.createDataFrame([(u, p, *map(float, x[p][u])) for p in (1, 2) for u in range(30)], "u int, p int, a double, b double, c double")

    def near(m):
        z = (m - m.mean(0)) / (m.std(0) + 1e-9)
        z = z / np.linalg.norm(z, axis=1, keepdims=True)
        s = z @ z.T
        np.fill_diagonal(s, -9)
        return [set(np.argsort(-r, kind="stable")[:5]) for r in s]

    kept = sum(len(a & b) for a, b in zip(near(x[1]), near(x[2])))
    for step in (512, 7):
        got = N.neighbour_overlap(frame, "u", "p", ["a", "b", "c"], draws=50, step=step).first()
        assert got.overlap == pytest.approx(kept / 150) and got.edge_jaccard == pytest.approx(kept / (300 - kept)) and got.p == pytest.approx(1 / 51)
        assert got.null_mean == pytest.approx(5 / 29, abs=0.05)


def test_corpora_that_share_texts(spark):
    got = {r.key: (r.documents, r.benchmark, r.shared) for r in QUERIES["corpus_overlap"](spark, SMALL).collect()}

    frame = spark.read.parquet(f"{SMALL}/documents.parquet").select(X.normal(F.col("text")).alias("t")).collect()
    other = spark.read.parquet(f"{SMALL}/benchmark.parquet").select(X.normal(F.col("text")).alias("t")).collect()
    sides = [[r.t for r in rows_] for rows_ in (frame, other)]
    for name, f in (("exact", lambda t: t), ("prefix", lambda t: t[:150]), ("bag", lambda t: " ".join(sorted(set(t.split(" ")), key=lambda w: w.encode())))):
        a, b = ({hashlib.sha256(f(t).encode()).hexdigest() for t in side} for side in sides)
        assert got[name] == (len(a), len(b), len(a & b))


def test_scorers_score_whole_lists(spark):
    d = parquet("documents")
    got = QUERIES["lexicon_scores"](spark, SMALL).toPandas()
    assert len(got) == len(d)
    name = [c for c in got.columns if c != "doc_id"][0]
    want = dict(zip(d["doc_id"], scoring.valence(d["text"].fillna("").tolist())))
    assert got.set_index("doc_id")[name].to_dict() == pytest.approx(want)


def test_drift_of_authors(spark):
    from tallyhouse.plans.text import trajectories

    t = trajectories(spark, SMALL).toPandas()
    m = t.assign(x=[v[-1] - v[0] for v in t["v"]]).groupby("source")["x"].mean()
    got = QUERIES["drift_bootstrap"](spark, SMALL).first()
    assert got.drift == pytest.approx(m.mean()) and got.lo <= m.mean() <= got.hi


def test_interrupted_and_lags(spark):
    o = parquet("orders")
    o["week"] = pd.to_datetime(o["o_orderdate"]).dt.to_period("W-SUN").dt.start_time
    o["x"] = o["o_orderpriority"].str[0].astype(int)
    series = {s: g.groupby("week").agg(y=("o_totalprice", "mean"), x=("x", "mean")).sort_index() for s, g in o.groupby("o_orderstatus")}
    for r in QUERIES["interrupted_series"](spark, SMALL).collect():
        y = series[r.series]["y"].to_numpy()
        t = np.arange(len(y), dtype=float)
        x = np.c_[np.ones(len(y)), t, t >= r.cut, np.maximum(t - r.cut, 0)]
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        assert (r.level, r.trend) == pytest.approx((beta[2], beta[3]), rel=1e-4, abs=1e-3)
    lags = QUERIES["prewhitened_lags"](spark, SMALL).toPandas()
    assert set(lags["lag"]) == set(range(-8, 9)) and lags["r"].abs().max() <= 1


def test_graphs_of_words(spark):
    lines = QUERIES["network_export"](spark, SMALL).orderBy("section", "name").toPandas()["line"].tolist()
    import xml.etree.ElementTree as ET

    root = ET.fromstring("".join(lines))
    nodes = {n.attrib["id"] for n in root.iter() if n.tag.endswith("node")}
    assert len(nodes) == 12 and all({e.attrib["source"], e.attrib["target"]} <= nodes for e in root.iter() if e.tag.endswith("edge"))
    c = QUERIES["network_communities"](spark, SMALL).toPandas()
    assert c["node"].is_unique and -0.5 <= c["modularity"].iloc[0] <= 1


def test_surrogates_of_volatility_are_fitted_once():
    rng = np.random.default_rng(4)
    y = rng.normal(size=200).cumsum()
    one, many = K.garch(y, np.random.default_rng(5)), K.surrogates("garch", y, np.random.default_rng(5), 3)
    assert one.shape == (200,) and many.shape == (3, 200) and np.isfinite(many).all()
    phi = [np.corrcoef(a[:-1], a[1:])[0, 1] for a in K.surrogates("ar1", y, np.random.default_rng(6), 40)]
    assert np.mean(phi) > 0.8 and all(np.std(a) > 0 for a in many)
