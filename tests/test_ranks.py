"""Ranks, quantiles and running sums by ranges, against pandas; and no plan that orders rows in one task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import ranks as K
from tallyhouse.plans import catalog
from tallyhouse.sources import shared
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = pd.DataFrame({"g": rng.choice(["a", "b", None], 600, p=[0.7, 0.2, 0.1]), "v": np.where(rng.random(600) < 0.33, 5.0, rng.normal(0, 9, 600).round(1)), "w": rng.integers(0, 40, 600)})
    x.loc[rng.random(600) < 0.05, "v"] = np.nan
    rows = [(None if pd.isna(g) else g, None if pd.isna(v) else float(v), int(w), i) for i, (g, v, w) in enumerate(x.itertuples(index=False))]
    return x.assign(i=range(600)), spark.createDataFrame(rows, "g string, v double, w long, i long").repartition(7)


@pytest.mark.parametrize("most", [32 << 20, -1])
def test_ranks_are_pandas(table, monkeypatch, most):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", most)
    x, df = table
    for by in ([], ["g"]):
        got = K.ranked(df, ["v", "w"], by).toPandas().sort_values("i")
        groups = x["g"].fillna("~") if by else pd.Series("all", index=x.index)
        for c in ("v", "w"):
            assert got[f"_r_{c}"].to_numpy() == pytest.approx(x.groupby(groups)[c].rank().to_numpy(), nan_ok=True)


def test_quantiles_are_pandas(table):
    x, df = table
    probabilities = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = K.quantiles(df, "v", probabilities).first()
    assert list(got) == pytest.approx(x["v"].quantile(probabilities).tolist())
    by = {r.g: list(r)[1:] for r in K.quantiles(df, "v", probabilities, ["g"]).collect()}
    assert by["a"] == pytest.approx(x[x["g"] == "a"]["v"].quantile(probabilities).tolist()) and by[None] == pytest.approx(x[x["g"].isna()]["v"].quantile(probabilities).tolist())
    none = K.quantiles(df.where("v > 1e9"), "v", [0.5]).collect()
    assert [tuple(r) for r in none] in ([], [(None,)])


def test_running_sums(table):
    x, df = table
    got = K.cumulated(df.select("i", "w"), ["i"], {"before": "w"}).toPandas().sort_values("i")
    assert got["before"].tolist() == (x["w"].cumsum() - x["w"]).tolist()


@pytest.mark.parametrize("name", ["rank_sum", "within_person_gap", "slope_against_marker", "spearman_by_stratum", "feature_rank_correlations", "heaps_exponent", "quantile_bins"])
def test_no_row_is_ordered_in_one_task(spark, name):
    plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):
        if "Window [" in line or "Window (" in line:
            keys = line.split("], [")[1] if "], [" in line else ""
            assert keys.strip() and not keys.strip().startswith("isnull"), line
