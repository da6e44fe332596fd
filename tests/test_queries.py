"""Every registered query runs; those with SQL equal it; plans keep to DataFrame operations where they can."""

import pytest

import __spark_entry__
from tests.conftest import SMALL
from tests.oracle import connect, rows
from tallyhouse.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["lang", "day", "value_mean", "k_mean", "n_reports", "n_users"]
    assert frame.count() > 0


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_columns_are_pruned_and_filters_pushed(spark):
    from pyspark.sql import functions as F

    from tallyhouse.sources.tables import reports

    plan = reports(spark, SMALL).where(F.col("lang") == "click").select("value")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan
    assert "ReadSchema: struct<event_type:string,value:double>" in plan
