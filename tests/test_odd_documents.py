"""Networks of text statistics on documents that are empty, missing, or all alike in their group."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyhouse.operators import graph as G
from tests.conftest import SMALL
from tests.oracle import rows

QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
ODD = [
    ("Only one of its tongue, here.", "it", "forum"),
    *[("Same words, twice over.", "pt", "wiki0")] * 3,
    *[("Same words, twice over.", "en", "wiki0")] * 3,
    *[("", "en", "news"), ("", "fr", "news"), ("", "xx", "void"), ("", "xx", "void")],
    *[(None, "en", "news"), (None, "de", "wiki0"), (None, None, "none"), (None, None, None)],
    *[("No tongue named, But Read.", None, None), ("Nor here.", None, "news"), ("A b C d, e f.", None, None)],
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    made = spark.createDataFrame([(10**6 + k, t, lang, s, None if t is None else len(t)) for k, (t, lang, s) in enumerate(ODD)], docs.schema)
    docs.union(made).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["feature_rank_correlations", "strongest_edges", "edge_persistence", "matrix_persistence", "edge_changes", "network_strength"])
def test_odd_documents_equal_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    got = QUERIES[name](spark, odd).toPandas()
    assert rows(got) == rows(con.sql(ORACLES[name]).df()) and len(got)


@pytest.mark.parametrize("name", ["network_scalars", "theme_networks"])
def test_odd_documents_stay(spark, odd, name):
    langs = {r.lang for r in QUERIES[name](spark, odd).collect()}
    assert langs == {r.lang for r in spark.read.parquet(f"{odd}/documents.parquet").select("lang").distinct().collect()}


def test_odd_documents_are_clustered(spark, odd):
    got = QUERIES["cluster_labels"](spark, odd).collect()
    assert sum(r.n for r in got) == spark.read.parquet(f"{odd}/documents.parquet").count() and all(r.vowels == r.vowels for r in got)


def test_constant_columns_correlate_by_zero(spark):
    df = spark.createDataFrame([("g", 1.0, 2.0), ("g", 1.0, 3.0), ("h", 4.0, 2.0), ("h", 5.0, 3.0), ("i", 1.0, 1.0)], "p string, a double, b double")
    made = G.correlations(df, ["a", "b"], ["p"])
    assert {(r.p, r.n, r.rho) for r in made.collect()} == {("g", 2, 0.0), ("h", 2, 1.0), ("i", 1, 0.0)}
    undefined = G.correlations(df, ["a", "b"], ["p"], float("nan"))
    assert {r.p for r in undefined.where(F.isnan("rho")).collect()} == {"g", "i"}
    assert {r.p: r.mean_abs_rho for r in G.scalars(undefined, ["p"]).collect()} == {"g": None, "h": 1.0, "i": None}
