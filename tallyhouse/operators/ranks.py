"""Ranks, quantiles and running sums over orders that no single task could hold.

Rows are dealt out by ranges of the order and written; each range adds up its own rows, and only the ranges' totals, a row for each,
meet in one place. What is ranked are the different values with their counts, so that a value which a third of all rows share is one row,
and ties need no care.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved, sized


def cumulated(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with, for each entry name: column of sums, the column's sum over all rows before this one in the order, which must tell rows
    apart (NULLs first)."""
    placed = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    ranges = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = placed.groupBy("_part").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    earlier = totals.select("_part", *(F.coalesce(F.sum(f"_t_{n}").over(ranges), F.lit(0)).alias(f"_b_{n}") for n in sums))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = placed.join(F.broadcast(earlier), "_part")
    return met.select(*df.columns, *((F.col(f"_b_{n}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(n) for n, c in sums.items()))


def counted(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """_column (the place in columns), by, _value (as a double), _n, _before and _total: each different value with how many rows have it,
    how many of its group have a smaller one, and how many there are. NULLs don't count."""
    by = by or []
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("_column"), F.col(c).cast("double").alias("_value")) for k, c in enumerate(columns)))).alias("_e")
    long = df.select(*by, each).select(*by, "_e._column", "_e._value").where("_value IS NOT NULL")
    keys = ["_column", *by]
    counts = long.groupBy(*keys, "_value").agg(F.count("*").alias("_n"))
    ordered = saved(cumulated(counts, [*keys, "_value"], {"_all": "_n"}), "value-counts")
    groups = saved(ordered.groupBy(*keys).agg(F.min("_all").alias("_first"), F.sum("_n").alias("_total")), "value-groups")
    met = ordered.alias("l").join(sized(groups).alias("r"), _same(keys, "l", "r"))
    return met.select(*(F.col(f"l.{k}").alias(k) for k in keys), "_value", "_n", (F.col("_all") - F.col("_first")).alias("_before"), "_total")


def _same(keys: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def ranked(df: DataFrame, columns: list[str], by: list[str] | None = None, prefix: str = "_r_") -> DataFrame:
    """df with the rank of each column's value within by, ties averaged, as prefix + column; NULLs are unranked."""
    by = by or []
    table = saved(counted(df, columns, by).select("_column", *by, "_value", (F.col("_before") + (F.col("_n") + 1) / 2).alias("_rank")), "ranks")
    for k, c in enumerate(columns):
        side = sized(table).where(F.col("_column") == k).alias("r")
        on = F.col(f"l.{c}").cast("double") == F.col("r._value")
        df = df.alias("l").join(side, on & _same(by, "l", "r") if by else on, "left").select("l.*", F.col("_rank").alias(prefix + c))
    return df


def quantiles(df: DataFrame, column: str, probabilities: list[float], by: list[str] | None = None, prefix: str = "_q") -> DataFrame:
    """by, prefix + 0, 1, ...: the column's quantiles, interpolated between the two values at either side; one row without by."""
    by = by or []
    at = [p * (F.col("_total") - 1) for p in probabilities]
    value = lambda place: F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_n")), F.col("_value")))
    ends = counted(df, [column], by).groupBy(*by).agg(F.max("_total").alias("_total"), *(f for k, h in enumerate(at) for f in (value(F.floor(h)).alias(f"_lo{k}"), value(F.ceil(h)).alias(f"_hi{k}"))))
    return ends.select(*by, *(F.when(F.col(f"_lo{k}") == F.col(f"_hi{k}"), F.col(f"_lo{k}")).otherwise((F.ceil(h) - h) * F.col(f"_lo{k}") + (h - F.floor(h)) * F.col(f"_hi{k}")).alias(f"{prefix}{k}") for k, h in enumerate(at)))
