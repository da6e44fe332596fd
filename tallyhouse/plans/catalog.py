"""Every query of the library outside the optional subpackage, and the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dynamics, events, extra, inference, nulls, panel, text, vectors
from .registry import ORACLES, QUERIES

#: Modules whose import registers their queries.
AREAS = (panel, events, text, vectors, inference, nulls, extra, dynamics)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.daily_panel(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
