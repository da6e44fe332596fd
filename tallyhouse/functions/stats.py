"""Scalar and window expressions of statistics; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_mean(*cols: Column | str) -> Column:
    """Mean over the columns that are neither NULL nor NaN; NULL where none is."""
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    held = [F.when(~F.isnan(c), c) for c in cols]
    total = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in held))
    number = reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in held))
    return F.when(number > 0, total / number)


def negativity(fear="fear", anger="anger", sadness="sadness", disgust="disgust", joy="joy", trust="trust") -> Column:
    return row_mean(fear, anger, sadness, disgust) - row_mean(joy, trust)


def nightmare_index(fear="fear", danger="danger", sadness="sadness", joy="joy") -> Column:
    return row_mean(fear, danger, sadness) - F.col(joy)


def corr(x: str, y: str) -> Column:
    """Aggregate: Pearson's correlation of two columns without NULLs; NaN where a side is constant, at which F.corr divides by zero."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread == 0, F.lit(float("nan"))).otherwise(F.covar_pop(x, y) / spread)


def spearman_brown(r: Column) -> Column:
    return F.when(r > -1, 2 * r / (1 + r))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: rows with a NULL value or a weight that isn't positive don't count."""
    ok = value.isNotNull() & weight.isNotNull() & (weight > 0)
    return F.sum(F.when(ok, value * weight)) / F.sum(F.when(ok, weight))


def entropy(shares: Column) -> Column:
    """Shannon entropy (nats) of an array of shares; zeros add nothing."""
    return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log(p)).otherwise(0.0))


def benjamini_hochberg(df: DataFrame, p: str = "p", q: str = "q", family: list[str] | None = None) -> DataFrame:
    """Adds q, within families; the rows of one family are few, one for each hypothesis. NULL p get NULL q and don't count."""
    part = Window.partitionBy(*(family or []), F.col(p).isNull())
    rank = F.row_number().over(part.orderBy(F.col(p).asc()))
    scaled = df.withColumns({"_rank": rank, "_m": F.count("*").over(part)}).withColumn("_s", F.col(p) * F.col("_m") / F.col("_rank"))
    tail = part.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return scaled.withColumn(q, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.min("_s").over(tail))))).drop("_rank", "_m", "_s")


def tier(q: Column) -> Column:
    # fixed values: the labels
    return F.when(q.isNull() | F.isnan(q), "n/a").when(q < 0.05, "headline (q<0.05)").when(q < 0.20, "suggestive (q<0.20)").otherwise("not significant")


def sign_test(up: Column, n: Column) -> Column:
    """The chance of `up` or more of n signs above 0 if either is as likely."""
    ln_choose = lambda k: _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)
    return F.aggregate(F.sequence(up, n), F.lit(0.0), lambda a, k: a + F.exp(ln_choose(k) - n * F.log(F.lit(2.0))))


def _ln_factorial(n: Column) -> Column:
    return F.when(n > 1, F.aggregate(F.sequence(F.lit(2).cast("long"), F.greatest(n.cast("long"), F.lit(2).cast("long"))), F.lit(0.0), lambda a, k: a + F.log(k.cast("double")))).otherwise(0.0)


def tier_of_interval(n: Column, lo: Column, sign_p: Column, combined_p: Column) -> Column:
    """How well an effect stands by its interval's lower end and two p."""
    # fixed values: the labels
    return F.when(n == 0, "n/a").when((lo > 0) & (sign_p < 0.05), "robust positive").when((lo > 0) | (combined_p < 0.05), "suggestive").otherwise("null")


def average_rank(value: str, by: list[str] | None = None) -> Column:
    """Rank with ties averaged, NULLs unranked, for groups that one task may hold (a series, a table of pairs); operators.ranks has no such bound."""
    part = Window.partitionBy(*(by or []), F.col(value).isNull())
    first = F.rank().over(part.orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*(by or []), F.col(value)))
    return F.when(F.col(value).isNotNull(), first + (ties - 1) / 2)


def robust_z(value: str, by: list[str], order: str, window: int = 28, least: int = 14) -> Column:
    """(x - median) / (1.4826 MAD) of the rows before this one; NULL with fewer than `least` of them or a MAD of 0."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-window, -1)
    middle = F.percentile(value, F.lit(0.5)).over(frame)
    held = F.filter(F.collect_list(value).over(frame), lambda x: x.isNotNull())

    def half(a: Column) -> Column:
        s, n = F.sort_array(a), F.size(a)
        lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
        return (F.get(s, lo) + F.get(s, hi)) / 2

    mad = half(F.transform(held, lambda x: F.abs(x - middle)))
    return F.when((F.size(held) >= least) & (mad > 0), (F.col(value) - middle) / (1.4826 * mad))
