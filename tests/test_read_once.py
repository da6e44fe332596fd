"""Texts are worked on once by what passes over them many times."""

import importlib

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import scoring
from tallyhouse.operators import graph as G
from tallyhouse.operators import nulls as N
from tallyhouse.operators import permutations as M
from tallyhouse.plans import catalog
from tallyhouse.plans import text as T
from tests.conftest import SMALL


def counting(spark, df, key):
    """df with its key passed through Python, and how many rows have been."""
    seen = spark.sparkContext.accumulator(0)

    def passed(x):
        seen.add(1)
        return x

    return df.withColumn(key, F.udf(passed, df.schema[key].dataType).asNondeterministic()(key)), seen


@pytest.mark.parametrize("name, module, extra", [("arc_clusters", "text", ()), ("grouped_folds_auc", "extra", ("doc_id",)), ("matched_contrast_over_seeds", "nulls", ("doc_id",))])
def test_sentences_are_cut_once(spark, monkeypatch, name, module, extra):
    counts = []

    def counted(spark, sf, least=4):
        df, seen = counting(spark, made(spark, sf, least), "doc_id")
        counts.append((seen, made(spark, sf, least).count()))
        return df

    made = T.trajectories
    monkeypatch.setattr(importlib.import_module(f"tallyhouse.plans.{module}"), "trajectories", counted)
    assert catalog.queries()[name](spark, SMALL).collect()
    assert [seen.value for seen, _ in counts] == [rows for _, rows in counts]


def test_correlations_read_rows_once(spark):
    rows = [(i, i % 3, float(i * 7 % 11), float(i * i % 13), float(i % 5)) for i in range(120)]
    df, seen = counting(spark, spark.createDataFrame(rows, "i long, p int, a double, b double, c double"), "a")
    got = G.matrix_persistence(G.correlations(df, ["a", "b", "c"], ["p"]), "p").collect()
    assert len(got) == 2 and seen.value == 120


def test_vocabulary_grows_without_sorting_tokens(spark):
    rows = [(d, f"w{(d * k) % 97}", 1) for d in range(1, 60) for k in range(1, 9)]
    t = spark.createDataFrame(rows, "d long, token string, freq int")
    got = N.heaps(t, ["d"]).first()
    twice = N.heaps(t.withColumn("e", F.lit(0)), ["d", "e"]).first()
    assert (got.exponent, got.documents) == (twice.exponent, twice.documents)
    seen = []
    real = N.cumulated
    try:
        N.cumulated = lambda df, *rest: seen.append(df._jdf.queryExecution().toString()) or real(df, *rest)
        N.heaps(t, ["d"])
    finally:
        N.cumulated = real
    assert "SortAggregate" not in seen[0]


def test_scorers_hold_few_texts_at_once(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else "x" * (i % 5)) for i in range(1500)], "i long, t string").coalesce(1)
    got = scoring.scored(df, "t", lambda texts: [len(texts)] * len(texts), batch=10_000, keep=["i"]).collect()
    assert [r.i for r in got] == list(range(1500)) and max(r.score for r in got) <= scoring.ROWS
    e = scoring.scored(df, "t", scoring.hashed_embedding, "e", kind="array<double>", keep=["i"]).collect()
    assert [(r.i, len(r.e)) for r in e] == [(i, 64) for i in range(1500)]


def test_network_contrast_reads_rows_once(spark):
    rows = [(i, i % 2, i % 3, float(i * 7 % 31), float(i * i % 29)) for i in range(120)]
    df, seen = counting(spark, spark.createDataFrame(rows, "i long, y int, m int, a double, b double"), "i")
    assert len(M.network_contrast(df, ["a", "b"], "i", "y", "m", draws=10).collect()) == 1 and seen.value == 120


def test_components_broadcast_no_labels(spark, monkeypatch):
    seen, real = [], G.saved
    monkeypatch.setattr(G, "saved", lambda df, label: seen.append(df._jdf.queryExecution().toString()) or real(df, label))
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in range(1, 8)], "k long")
    got = {r.k: r.component for r in G.components(edges, nodes, "k").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    assert len(seen) > 2 and not any("BroadcastHashJoin" in p for p in seen)
