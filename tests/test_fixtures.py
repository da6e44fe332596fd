"""Hand-computed cases of scalar and array expressions, series operators and kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import arrays as A
from tallyhouse.functions import kernels as K
from tallyhouse.functions import stats
from tallyhouse.functions import text as X
from tallyhouse.operators import panel as P
from tallyhouse.operators import windows as W


def one(spark, expr, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(expr.alias("r")).first().r


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.20, None))], "i int, p double")
    q = [r.q for r in stats.benjamini_hochberg(df).orderBy("i").collect()]
    assert q[:4] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.20]) and q[4] is None


def test_leave_one_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "user_id string, v double")
    assert sorted(((r.user_id, r.dev) for r in W.loo_deviation(df, "v").collect()), key=str) == [("a", -2.0), ("a", 2.0), ("b", None)]


def test_negativity_with_a_missing_axis(spark):
    row = (None, 0.4, 0.2, 0.6, 0.1, 0.3)
    got = one(spark, stats.negativity(), "fear double, anger double, sadness double, disgust double, joy double, trust double", row)
    assert got == pytest.approx(0.2)


@pytest.mark.parametrize(("t", "name"), [((0, 1, 2), "rise"), ((2, 1, 0), "fall"), ((0, 2, 1), "peak"), ((1, 0, 1), "trough"), ((1, 1, 1), "rise")])
def test_arc_class(spark, t, name):
    assert one(spark, A.arc_class(*map(F.lit, t))) == name


def test_sentences(spark):
    got = one(spark, X.sentences(F.col("t")), "t string", ("One two. Three! four five\nsix seven",))
    assert got == ["One two.", "four five", "six seven"]


def test_shortest_prefix(spark):
    rows = [(i, i % 4) for i in range(20)] + [(20, 4), (21, 5)]
    df = spark.createDataFrame(rows, "i int, user_id int")
    assert W.shortest_prefix(df, ["i"]).first().min_prefix == 21


def test_spacing(spark):
    assert one(spark, W.spaced(F.array(*map(F.lit, (50, 0, 10, 28, 56))), 28)) == [0, 28, 56]


def test_disclosure(spark):
    df = spark.createDataFrame([(1, 19, 9, 0.5), (2, 19, 9, None), (3, 20, 4, 0.5), (4, 20, 5, 0.5)], "i int, n_reports int, n_users int, m double")
    assert sorted(r.i for r in P.violations(df, ["m"]).collect()) == [1, 3]
    assert P.violations(P.gate(df, ["m"]), ["m"]).count() == 0


def test_slope_runs_from_0_to_1(spark):
    assert one(spark, A.slope(F.array(*map(F.lit, (0.0, 1.0, 2.0))))) == pytest.approx(2.0)


def test_language(spark):
    rows = [("  ", "unknown"), ("Мне снился дом", "ru"), ("plain text", "en"), ("ééééé aaaaa", "other")]
    got = spark.createDataFrame(rows, "t string, w string").select(X.language(F.col("t")).alias("g"), "w").collect()
    assert all(r.g == r.w for r in got)


def test_quoted_lists(spark):
    assert one(spark, X.quoted_list(F.col("t")), "t string", ('"A","b c"',)) == ["a", "b c"]
    assert one(spark, X.quoted_list(F.col("t")), "t string", ("X, y ,,",)) == ["x", "y"]


def test_unicode_normal_form(spark):
    assert one(spark, X.normal(F.col("t")), "t string", ("ﬁne,  STRAẞE!",)) == "fine strasse"


def test_tail_probabilities():
    assert K.t_p(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert K.f_p(4.103, 2, 10) == pytest.approx(0.05, abs=2e-4)
    assert K.chi2_p(3.841, 1) == pytest.approx(0.05, abs=2e-4)
    assert K.t_quantile(0.975, 10) == pytest.approx(2.228, abs=1e-3)
    assert K.binomial_upper(3, 10, 0.1) == pytest.approx(1 - sum(math.comb(10, k) * 0.1**k * 0.9 ** (10 - k) for k in range(3)))


def test_exact_shift_null_equals_enumeration():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=40), rng.normal(size=40)
    r, p = K.shift_correlation(x, y)
    every = [np.corrcoef(x, np.roll(y, s))[0, 1] for s in range(40)]
    assert r == pytest.approx(every[0]) and p == pytest.approx(np.mean(np.abs(every) >= abs(r) - 1e-12))
    assert K.shift_correlation(np.ones(10), y[:10]) == (0.0, 1.0)


def test_surrogates_keep_what_they_promise():
    x = np.cumsum(np.random.default_rng(1).normal(size=200))
    s = K.SURROGATES["iaaft"](x, np.random.default_rng(2))
    assert np.allclose(np.sort(s), np.sort(x))
    f = K.SURROGATES["phase"](x, np.random.default_rng(2))
    assert np.allclose(np.abs(np.fft.rfft(f)), np.abs(np.fft.rfft(x)), atol=1e-6)


def test_change_points_are_recovered():
    y = np.r_[np.zeros(40), np.full(40, 5.0), np.full(40, -3.0)] + np.random.default_rng(3).normal(0, 0.3, 120)
    assert K.segments(y) == [40, 80]


def test_injected_step_is_found():
    y = np.random.default_rng(4).normal(size=120)
    y[60:] += 3
    assert K.interrupted(y, 60)["p"] < 1e-6 < K.interrupted(np.random.default_rng(5).normal(size=120), 60)["p"]


def test_communities_of_two_cliques():
    w = np.zeros((6, 6))
    for block in ((0, 1, 2), (3, 4, 5)):
        for i in block:
            for j in block:
                w[i, j] = i != j
    w[2, 3] = w[3, 2] = 0.1
    label = K.communities(w)
    assert len(set(label[:3])) == len(set(label[3:])) == 1 and label[0] != label[5]
    assert K.modularity(w, label) > 0.4


def test_ranks_dimension_and_entropy():
    rng = np.random.default_rng(6)
    assert 1.5 < K.two_nn(np.c_[rng.random((300, 2)), np.zeros((300, 3))]) < 2.6
    assert K.permutation_entropy(np.arange(50.0)) == 0
    assert K.kendall_b(np.arange(10.0), np.arange(10.0)) == 1
    assert K.distance_correlation(np.arange(30.0), np.arange(30.0) * 2) == pytest.approx(1)


def test_lexicons(spark):
    from tallyhouse.functions import lexicons as L

    rows = [("I woke up in a hospital, the virus was gone", 1, 1, True), ("covid again", 0, 0, False), ("Я проснулась дома", 0, 0, True), (None, 0, 0, False), ("nothing", 0, 0, False)]
    got = spark.createDataFrame(rows, "t string, contagion int, illness int, awake boolean")
    p = L.presence(F.col("t"))
    for r in got.select("*", p["contagion"].alias("c"), p["illness"].alias("i"), L.awakening(F.col("t")).alias("a"), L.without_explicit(F.col("t")).alias("w"), L.threat_rate(F.col("t")).alias("r")).collect():
        assert (r.c, r.i, r.a) == (r.contagion, r.illness, r.awake), r
        assert r.w == (r.t != "covid again")
    assert L.family_of("death") == "latent" and len(L.ALL) == 14 and len(L.version()) == 12
