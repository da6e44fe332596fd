"""Permutations by place: bijections, restricted groups, and the nulls made of them, against plain versions."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import nulls as N
from tallyhouse.operators import permutations as M
from tests.conftest import SMALL


def name_of(text):
    return np.full(1, text, np.uint64)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 32, 33, 34, 50, 100, 1000, 4099])
def test_each_draw_is_a_permutation(n):
    to = M.scattered(np.arange(n), np.full(n, n), np.full(n, 7), np.arange(20))
    assert (np.sort(to, 1) == np.arange(n)).all()
    # a part of the rows goes where all the rows would have sent it
    some = np.arange(0, n, 3)
    assert (M.scattered(some, np.full(len(some), n), np.full(len(some), 7), np.arange(20)) == to[:, some]).all()


def test_permutations_are_even_handed():
    to = M.scattered(np.arange(3), np.full(3, 3), np.full(3, 1), np.arange(6000))
    seen = Counter(map(tuple, to.tolist()))
    assert len(seen) == 6 and all(abs(v - 1000) < 150 for v in seen.values())
    n = 200
    to = M.scattered(np.arange(n), np.full(n, n), np.full(n, 1), np.arange(4000))
    fixed = (to == np.arange(n)).sum(1)  # one on average, with a variance of one
    assert abs(fixed.mean() - 1) < 0.1 and abs(fixed.var() - 1) < 0.15
    apart = np.abs(to[:, 1:] - to[:, :-1]).mean()
    assert abs(apart - (n + 1) / 3) < 1
    first, second = to[:, 0], to[:, 1]
    assert abs(np.corrcoef(first, second)[0, 1] + 1 / (n - 1)) < 0.05


@pytest.mark.parametrize("n", [5, 40, 101])
def test_blocks_stay_together(n):
    to = M.dealt_places(np.arange(n), np.full(n, n), np.full(n, 3), np.arange(50), 4)
    assert (np.sort(to, 1) == np.arange(n)).all()
    for lo in range(0, n, 4):
        part = to[:, lo : lo + 4]
        assert (np.diff(part, axis=1) == 1).all()
    assert len({tuple(r) for r in to.tolist()}) > 1


@pytest.mark.parametrize("n", [1, 2, 9, 32, 33, 50, 66, 81, 101, 1000, 4099])
@pytest.mark.parametrize("block", [1, 3, 4])
def test_what_comes_is_what_was_sent(n, block):
    name, draws = np.uint64(2**63 + 17 * n), np.arange(40)
    whence = M.dealt_whence(n, name, draws, block)
    come = np.concatenate([whence(np.arange(lo, min(n, lo + 25))) for lo in range(0, n, 25)])
    to = M.dealt_places(np.arange(n), np.full(n, n), np.full(n, name), draws, block)
    assert (np.take_along_axis(come.T, to, 1) == np.arange(n)).all()


def test_a_whole_group_hashes_halves_not_rows(monkeypatch):
    """A person's rows in a draw cost look-ups; hashes are of about sqrt(n) halves a step, where each row had its own."""
    made, usual = [], M._moves
    monkeypatch.setattr(M, "_moves", lambda *a: made.append(usual(*a)) or made[-1])
    n, draws = 4096, 10
    M.Whence(n, np.uint64(5), np.arange(draws))(np.arange(n))
    assert sum(m.size for m in made) == M.ROUNDS * 64 * draws


def shuffled(frame, **more):
    s = N.shuffled_sums(frame, "u", "d", [F.col("v"), F.lit(1.0)], 40, **more).toPandas().sort_values(["draw", "d"])
    return s["draw"].tolist(), s["d"].tolist(), s["n"].tolist(), np.stack(s["s"])


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(4)
    rows = [(int(u), int(d), float(v)) for u, d, v in zip(np.where(rng.random(700) < 0.4, 0, rng.integers(1, 60, 700)), rng.integers(0, 21, 700), rng.normal(size=700), strict=True)]
    return pd.DataFrame(rows, columns=["u", "d", "v"]), spark.createDataFrame(rows, "u int, d int, v double").repartition(5)


@pytest.mark.parametrize("kind", ["plain", "stratum", "block"])
def test_hot_people_are_dealt_alike(people, kind):
    """Brought together or dealt by place, rows go to the same places; sums of persons and strata stay."""
    x, frame = people
    more = {"plain": {}, "stratum": {"stratum": F.col("d") % 7}, "block": {"block": 3}}[kind]
    usual, hot = shuffled(frame, **more), shuffled(frame, hot=10, **more)
    assert usual[:3] == hot[:3] and usual[3] == pytest.approx(hot[3])
    draws, days, n, s = usual
    table = pd.DataFrame({"draw": draws, "d": days, "v": s[:, 0], "k": s[:, 1]})
    assert table.groupby("draw")["v"].sum().to_numpy() == pytest.approx(np.full(41, x["v"].sum())) and (table["k"].to_numpy() == n).all()
    if kind == "stratum":  # what falls on a weekday is dealt over its own days
        week = table.assign(w=table["d"] % 7).groupby(["draw", "w"])["v"].sum().unstack()
        assert week.to_numpy() == pytest.approx(np.tile(x.groupby(x["d"] % 7)["v"].sum().to_numpy(), (41, 1)))


def test_shuffles_are_the_plain_ones(spark, people):
    x, frame = people
    got = N.shuffled_sums(frame, "u", "d", [F.col("v")], 30).toPandas()
    names = {r.u: r.name for r in frame.select("u", F.xxhash64(F.lit("within"), F.col("u").cast("string"), F.lit("")).alias("name")).distinct().collect()}
    want = np.zeros((30, 21))
    for u, part in x.groupby("u"):
        part = part.sort_values(["d", "v"])
        n, d, v = len(part), part["d"].to_numpy(), part["v"].to_numpy()
        to = M.scattered(np.arange(n), np.full(n, n), np.full(n, names[u]).view(np.uint64), np.arange(30))
        for b in range(30):
            np.add.at(want[b], d[to[b]], v)
    made = got[got["draw"] >= 0].assign(x=lambda t: [s[0] for s in t["s"]]).pivot(index="draw", columns="d", values="x")
    assert made.to_numpy() == pytest.approx(want)


def test_dealing_keeps_its_number_of_tasks(people):
    """Rows of a thousand draws each are few bytes and much work: their tasks are not put together by size."""
    plan = N.shuffled_sums(people[1], "u", "d", [F.col("v")], 30)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan


def test_a_rhythm_is_no_day_effect_within_weekdays(spark):
    """A weekly rhythm is found by the plain shuffle and not by the one that keeps weekdays."""
    rng = np.random.default_rng(6)
    rows = [(u, d, float(rng.normal() + 2 * (d % 7 == 0))) for u in range(40) for d in range(35)]
    frame = spark.createDataFrame(rows, "u int, d int, v double")
    assert N.day_effect_null(frame, "v", "d", "u", 200).first().p == pytest.approx(1 / 201)
    assert N.day_effect_null(frame, "v", "d", "u", 200, stratum=F.col("d") % 7).first().p > 0.05


def test_permuted_labels(spark):
    rng = np.random.default_rng(8)
    n, k = 400, 12
    centre = rng.normal(size=(k, 5))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    who = rng.integers(0, k, n)
    x = centre[who] + rng.normal(0, 0.6, (n, 5))
    test = spark.createDataFrame([(1000 - i, int(w), v.tolist()) for i, (w, v) in enumerate(zip(who, x, strict=True))], "id long, who int, v array<double>")
    people = spark.createDataFrame([(w, c.tolist()) for w, c in enumerate(centre)], "who int, v array<double>")
    near = M.nearest_people(test, people, "id", "who", "v")
    order = np.argsort(-(x @ centre.T), axis=1, kind="stable")
    by_id = {r.id: r for r in near.collect()}
    for i in range(n):
        r = by_id[1000 - i]
        assert r.best == order[i, :5].tolist() and r["rank"] == int(np.flatnonzero(order[i] == who[i])[0]) + 1
    got = {r.top: r for r in M.label_permutation(near, "id", "who", draws=300).collect()}
    place = np.argsort([1000 - i for i in range(n)]).argsort()  # rows in the order of their keys
    to = M.scattered(place, np.full(n, n), np.zeros(n, np.uint64), np.arange(300))
    owner = np.sort(who)  # people hold successive places
    for top in (1, 5):
        seen = np.mean([who[i] in order[i, :top] for i in range(n)])
        null = np.array([np.mean([owner[t] in order[i, :top] for i, t in enumerate(to[b])]) for b in range(300)])
        r = got[top]
        assert (r.observed, r.null_mean, r.p, r.n, r.draws) == pytest.approx((seen, null.mean(), (1 + (null >= seen - 1e-12).sum()) / 301, n, 300))
        assert abs(r.null_mean - np.mean([np.isin(owner, order[i, :top]).mean() for i in range(n)])) < 0.01


def test_greatest_difference_of_networks(spark):
    rng = np.random.default_rng(9)
    n = 500
    label, month = (rng.random(n) < 0.4).astype(int), rng.integers(0, 6, n)
    a = rng.normal(size=n)
    b = np.where(label == 1, a, 0) + rng.normal(0, 0.5, n)
    c = rng.normal(size=n).round(1)
    frame = spark.createDataFrame([(i, int(label[i]), f"m{month[i]}", float(a[i]), float(b[i]), float(c[i])) for i in range(n)], "i long, y int, m string, a double, b double, c double").repartition(4)
    got = {(r.a, r.b): r for r in M.network_contrast(frame, ["a", "b", "c"], "i", "y", "m", draws=100).collect()}
    h = lambda i, seed: ((i % 2**31) * 2654435761 + seed * 40503) % 2**32
    least = min(label.sum(), n - label.sum())
    held = [i for y in (0, 1) for i in sorted(np.flatnonzero(label == y), key=lambda i: (h(int(i), 0), i))[:least]]
    r = pd.DataFrame({k: v[held] for k, v in (("a", a), ("b", b), ("c", c))}).rank().to_numpy()
    names = {x.m: x.h for x in spark.createDataFrame([(f"m{k}",) for k in range(6)], "m string").select("m", F.xxhash64("m").alias("h")).collect()}
    lab = np.zeros((101, len(held)), bool)
    lab[0] = label[held] == 1
    for m in range(6):
        own = [k for k, i in enumerate(held) if month[i] == m]
        own.sort(key=lambda k: (h(int(held[k]), 1), held[k]))
        to = M.scattered(np.arange(len(own)), np.full(len(own), len(own)), np.full(len(own), names[f"m{m}"]).view(np.uint64), np.arange(100))
        lab[1:, own] = to < len(own) // 2
    pairs = [(0, 1), (0, 2), (1, 2)]
    delta = np.array([[np.corrcoef(r[one].T)[p] - np.corrcoef(r[~one].T)[p] for p in pairs] for one in lab])
    most = np.abs(delta[1:]).max(1)
    for (i, j), d in zip(pairs, delta[0], strict=True):
        x = got["abc"[i], "abc"[j]]
        assert (x.delta, x.p, x.threshold) == pytest.approx((d, (1 + (most >= abs(d)).sum()) / 101, np.sort(most)[94])) and x.n == least
    assert got["a", "b"].p < 0.02 < got["a", "c"].p


@pytest.mark.parametrize("name", ["reidentification_null", "network_contrast", "weekday_preserving_null", "block_shuffle_null"])
def test_registered(spark, name):
    from tallyhouse.plans import catalog

    rows = catalog.queries()[name](spark, SMALL).collect()
    assert rows and all(0 < r.p <= 1 for r in rows)
