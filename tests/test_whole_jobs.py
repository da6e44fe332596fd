"""Queries that once did less than the whole job."""

import numpy as np
import pandas as pd
import pytest

from tallyhouse.functions import kernels as K
from tallyhouse.plans import catalog
from tallyhouse.sources.tables import daily_orders
from tests.conftest import SMALL

QUERIES = catalog.queries()


def test_rolling_ar1_equals_loop():
    x = np.random.default_rng(3).normal(size=90).cumsum()
    want = pd.Series(x).rolling(28, min_periods=14).apply(lambda a: np.corrcoef(a[:-1], a[1:])[0, 1], raw=True).to_numpy()
    assert K.rolling_ar1(x, 28) == pytest.approx(want, nan_ok=True)


def test_warning_pipeline_takes_every_day(spark):
    x = daily_orders(spark, SMALL).toPandas().sort_values("day")["v"].astype(float).reset_index(drop=True)
    ahead = x.shift(-14).rolling(14).mean() - x.rolling(7).mean()
    kept = []
    for t in np.flatnonzero(ahead >= np.nanquantile(ahead, 0.9)):
        if not kept or t - kept[-1] >= 42:
            kept.append(t)
    assert {r.episodes for r in QUERIES["warning_pipeline"](spark, SMALL).collect()} == {len(kept)}


def test_query_cosines_meet_every_vector(spark):
    ids = {r.vec_id for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id").collect()}
    got = QUERIES["query_cosines"](spark, SMALL).toPandas()
    assert set(got["other"]) == ids
    assert (got.groupby("vec_id").size() == len(ids) - 1).all() and set(got["vec_id"]) == {i for i in ids if i % 100 == 0}


def least_reached(near: np.ndarray) -> list[int]:
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None], len(near)).min(1))
        if (new == label).all():
            return label.tolist()
        label = new


def unit_rows() -> np.ndarray:
    x = np.stack(pd.read_parquet(f"{SMALL}/embeddings.parquet").sort_values("vec_id")["embedding"].to_numpy()).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_components_are_those_of_all_vectors(spark, monkeypatch):
    from tallyhouse.operators import graph as G
    from tallyhouse.operators import joins as J

    x = unit_rows()
    s = x @ x.T
    np.fill_diagonal(s, 0)
    got = {r.vec_id: r.component for r in QUERIES["graph_components"](spark, SMALL).collect()}
    assert got == dict(enumerate(least_reached(s > 0.5)))
    monkeypatch.setattr(J, "BLOCK_ROWS", 120)
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = {r.vec_id: r.component for r in G.components(J.cosine_links(e, "vec_id", "embedding", 0.3), e.select("vec_id"), "vec_id").collect()}
    assert got == dict(enumerate(least_reached(s > 0.3)))


def test_percolation_of_all_rows(spark):
    got = {r.theta: r for r in QUERIES["percolation_curve"](spark, SMALL).collect()}
    x = unit_rows()
    s = x @ x.T
    np.fill_diagonal(s, 0)
    assert len(got) == 30
    for theta in (0.2, 0.32, 0.44):
        size = np.bincount(least_reached(s > theta))
        want = (size.max() / len(x), (size > 0).sum(), (s > theta).sum() / len(x), (size == 1).sum(), len(x))
        r = got[theta]
        assert (r.giant_frac, r.n_components, r.mean_degree, r.n_singletons, r.n) == pytest.approx(want)


def test_two_nn_takes_more_rows_and_copies():
    x = np.random.default_rng(1).normal(size=(900, 8))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert K.nearest_two(x) == pytest.approx(np.sort(d, axis=1)[:, :2])
    assert K.nearest_two(np.r_[x, x[:1]])[0, 0] == 0


def test_coherence_of_equal_values_is_unknown(spark):
    from tallyhouse.operators import vectors as V

    # equal values added up with weights -4, -2, 0, 2, 4 need not give 0
    rows = [(k, i, x) for k, x in ((5, 2 / 3 - 0.33), (6, 1 / 6 - 0.33), (8, 5 / 7 - 0.33)) for i in range(k)] + [(1, i, x) for i, x in enumerate((0.5, 0.1, 0.4, 0.1))]
    got = {r.doc: r.ratio for r in V.order_coherence(spark.createDataFrame(rows, "doc int, pos int, x double"), "doc", "pos", "x").collect()}
    assert got[5] is None and got[6] is None and got[8] is None
    assert got[1] == pytest.approx((0.4 + 0.3 + 0.3) / 3 / ((0.4 + 0.1 + 0.4 + 0.3 + 0.0 + 0.3) / 6))


def test_gaps_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    def table(path, turn):
        rows = [(1, "click", (0.1, 0.2, 0.3)), (1, "view", (0.3, 0.2, 0.1)), (2, "click", (0.7, 0.1, 0.3)), (2, "view", (0.1, 0.1, 0.2)), (3, "click", (0.2, 0.1, 0.1)), (3, "view", (0.3, 0.7, 0.1)), (4, "click", (5.0,)), (4, "view", (float("inf"),))]
        flat = [(u, e, v, "{}") for u, e, vs in rows for v in (vs[::-1] if turn else vs)]
        spark.createDataFrame(flat, "user_id long, event_type string, value double, props string").selectExpr("monotonically_increasing_id() AS event_id", "timestamp '2024-01-01' AS ts", "*").coalesce(1).write.parquet(f"{path}/events.parquet")
        return [tuple(r) for r in QUERIES["within_person_gap"](spark, str(path)).collect()]

    # person 1 has no gap, persons 2 and 3 the same one either way (ranks 1.5 each), person 4 an infinite one
    assert table(tmp_path / "a", False) == table(tmp_path / "b", True) == [(3, 1.5)]


def test_grams_are_a_row_a_text_and_are_not_moved(spark):
    from tallyhouse.functions import text as X
    from tallyhouse.operators import vectors as V

    texts = ["the cat sat on the mat", None, "a cat and a hat", "", "sat on that"]
    held = V.gram_rows(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), ["id"], "text", 500)
    seen = {r.id: (np.cumsum(r.gaps).tolist(), list(r.counts)) for r in held.collect()}
    assert seen == {k: tuple(v.tolist() for v in X.gram_counts([t], features=500)[0]) for k, t in enumerate(texts)}
    m = np.zeros((len(texts), 500))
    for k, (f, c) in seen.items():
        m[k, f] = c
    held = held.where("size(gaps) > 0")
    assert V.texts_with(held, 500).tolist() == (m > 0).sum(0).tolist()
    idf = np.linspace(0.5, 2, 500)
    m *= idf
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    values, basis = V.leading_directions_of_rows(held, idf, 2, rounds=60)
    assert values == pytest.approx(np.linalg.svd(m, compute_uv=False)[:2], rel=1e-6)
    assert basis.T @ basis == pytest.approx(np.eye(2), abs=1e-9)


@pytest.mark.parametrize("often", [0.0, 1.3, 9.0])
def test_frequent_and_rare_grams_are_multiplied_alike(spark, monkeypatch, often):
    from tallyhouse.operators import vectors as V

    # none, some or all features go the dense way; texts have some of either kind or one kind alone
    monkeypatch.setattr(V, "OFTEN", often)
    rng = np.random.default_rng(2)
    m = np.where(rng.random((150, 40)) < 0.3, rng.integers(1, 5, (150, 40)), 0)
    m[:20, 20:], m[20:40, :20], m[:, 7] = 0, 0, 0
    m = m[m.any(1)]
    rows = [(np.diff(np.flatnonzero(r), prepend=0).tolist(), r[r > 0].tolist()) for r in m]
    held = spark.createDataFrame(rows, "gaps array<int>, counts array<int>")
    idf = np.where(np.arange(40) == 7, 0, np.where(np.arange(40) < 20, 1.1, 2.0))
    w = m * idf
    w = w / np.linalg.norm(w, axis=1, keepdims=True)
    entries = spark.createDataFrame([(int(k), int(f), float(w[k, f])) for k, f in zip(*np.nonzero(w))], "r int, f int, w double")
    (values, basis), (want, directions) = V.leading_directions_of_rows(held, idf, 3), V.leading_directions(entries, "r", "f", "w", 40, 3)
    assert values == pytest.approx(want) and basis == pytest.approx(directions)


def test_packed_grams_are_the_same(spark):
    from tallyhouse.operators import vectors as V

    texts = [(0, "the cat sat on the mat"), (1, None), (2, "a" * 90_000), (3, ""), (4, "ÀÉ x " * 300)]
    df = spark.createDataFrame(texts, "id int, text string")
    plain, packed = (V.gram_rows(df, ["id"], "text", 500, packed=p) for p in (False, True))
    want = {r.id: [*r.gaps, *r.counts] for r in plain.collect()}
    assert {r.id: V._unpack(bytes(r.grams)).tolist() for r in packed.collect()} == want and max(want[2]) > 65_536
    plain, packed = plain.where("size(gaps) > 0"), packed.where("length(grams) > 0")
    assert V.texts_with(packed, 500).tolist() == V.texts_with(plain, 500).tolist()
    for a, b in zip(V.leading_directions_of_rows(packed, np.ones(500), 2), V.leading_directions_of_rows(plain, np.ones(500), 2), strict=True):
        assert np.abs(a) == pytest.approx(np.abs(b))
    assert dict(packed.dtypes)["grams"] == "binary" and "gaps" not in V._held(packed).columns


def test_gram_products_equal_dense_ones():
    from tallyhouse.operators import vectors as V

    m = np.array([[0, 2.0, 0, 1], [0, 0, 0, 0], [3, 0, 0, 0.5]])
    code, f = np.nonzero(m)
    basis = np.arange(8.0).reshape(2, 4)
    assert V.products(basis, code, f, m[code, f], 3).tolist() == (m @ basis.T).T.tolist()
    assert V.products(basis, code[:0], f[:0], m[code, f][:0], 3).tolist() == np.zeros((2, 3)).tolist()


def test_gram_spectrum_writes_less_than_a_row_a_gram(spark, monkeypatch):
    from tallyhouse.sources import shared

    kept, real = [], shared.saved
    monkeypatch.setattr(shared, "saved", lambda df, label: kept.append(real(df, label)) or kept[-1])
    QUERIES["char_ngram_spectrum"](spark, SMALL).collect()
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert [k.count() for k in kept] == [n]


def test_nearest_directions_equal_all_pairs():
    rng = np.random.default_rng(5)
    for n in (3, 9, 40, 700):
        x = rng.normal(size=(n, 2))
        x[n // 2 :] = x[: n - n // 2] * rng.choice([1.0, 2.0], (n - n // 2, 1))  # the same directions
        x[:2] = 0
        u = x / np.maximum(np.hypot(x[:, 0], x[:, 1]), 1e-300)[:, None]
        sim = u[:, :1] * u[:, 0] + u[:, 1:] * u[:, 1]
        np.fill_diagonal(sim, -np.inf)
        assert (K.nearest_directions(x, 5) == np.argsort(-sim, axis=1, kind="stable")[:, :5][:, : n - 1]).all()


def test_nearest_directions_of_many_people_take_no_pairs():
    import time

    x = np.random.default_rng(6).normal(size=(60_000, 2))
    x[30_000:] = x[0]
    began = time.process_time()
    assert K.nearest_directions(x, 5).shape == (60_000, 5)
    assert time.process_time() - began < 30  # all pairs take minutes


def test_near_own_rows_meet_in_blocks(spark):
    from tallyhouse.operators import joins as J

    rng = np.random.default_rng(8)
    vectors = [v.tolist() for v in rng.normal(size=(400, 3))]
    vectors[0], vectors[1], vectors[2] = [0.0, 0.0, 0.0], None, [1.0, None, 0.0]
    rows = [(k, None if k == 5 else int(k % 3), v) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, who int, v array<float>")
    kept = J.drop_near_own(df.where("id % 4 = 0"), df.where("id % 4 <> 0"), "id", "who", "v", 0.9)
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    usable = lambda v: v is not None and None not in v and any(v)
    want = {k for k, who, v in rows if k % 4 == 0 and all(cos(v, u) <= 0.9 for j, w, u in rows if j % 4 and w == who and usable(u) and usable(v))}
    assert {r.id for r in kept.collect()} == want
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Join Inner" not in plan  # no row a pair


def test_one_per_group_makes_no_row_a_draw(spark):
    from pyspark.sql import functions as F

    from tallyhouse.operators import sampling as S

    rows = [(k, None if k % 11 == 0 else k % 7 if k > 400 else 100, None if k % 5 == 0 else k / 4) for k in range(12_000, 0, -1)] + [(7, 3, 1.0), (7 + 2**31, 3, 2.0)]
    df = spark.createDataFrame(rows, "id long, who int, v double")
    want = S.one_per_group(df, "who", "id", 30, 9).groupBy("draw").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
    made = S.mean_of_one_per_group(df, "who", "id", "v", 30, 9)
    key = lambda f: sorted((r.draw, round(r.mean, 9), r.n) for r in f.collect())
    assert key(made) == key(want)
    assert "Generate" not in QUERIES["one_report_per_person"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_of_pairs_stay_small(spark, monkeypatch):
    from tallyhouse.operators import joins as J

    real, used = J.in_blocks, []
    monkeypatch.setattr(J, "in_blocks", lambda q, b, fn, schema, rows=None: used.append(rows) or real(q, b, lambda x, y: fn(x, y).assign(sim=float(len(x) * len(y))), schema, rows))
    df = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(1500)], "vec_id long, embedding array<float>")
    got = J.cosines_to_all(df, df, "vec_id", "embedding").agg({"sim": "max", "*": "count"}).first()
    assert got["count(1)"] == 1500 * 1499
    assert used == [256] and got["max(sim)"] < 1500 * 512
