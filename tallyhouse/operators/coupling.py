"""Coupling of weekly series: lags, exact shift nulls, differences, design residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.stats import benjamini_hochberg
from ..sources.shared import saved
from .joins import lagged


def shift_null(pairs: DataFrame, x: str = "x", y: str = "y", t: str = "t") -> DataFrame:
    """r at every circular shift of y: shift, r. n squared rows: for series of some hundred points."""
    stats = pairs.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), F.count("*").alias("n"))
    z = pairs.crossJoin(F.broadcast(stats)).select((F.row_number().over(Window.orderBy(t)) - 1).alias("i"), ((F.col(x) - F.col("mx")) / F.col("sx")).alias("zx"), ((F.col(y) - F.col("my")) / F.col("sy")).alias("zy"), "n")
    moved = z.select("zx", "n", "i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("shift")).withColumn("j", F.pmod(F.col("i") + F.col("shift"), F.col("n")))
    return moved.join(z.select(F.col("i").alias("j"), F.col("zy")), "j").groupBy("shift").agg((F.sum(F.col("zx") * F.col("zy")) / F.max("n")).alias("r"))


def shift_p(null: DataFrame) -> DataFrame:
    """Observed r (shift 0) and the share of all shifts at least as far from 0: r, p, n."""
    seen = null.where("shift = 0").select(F.col("r").alias("_r"))
    return null.crossJoin(F.broadcast(seen)).groupBy("_r").agg(F.avg((F.abs("r") >= F.abs("_r") - 1e-12).cast("int")).alias("p"), F.count("*").alias("n")).select(F.col("_r").alias("r"), "p", "n")


def lag_scan(pairs: DataFrame, by: list[str], t: str = "t", most: int = 8, least: int = 12) -> DataFrame:
    """by, lag, r, p (exact over all shifts), n and q within each series: one group of some hundred points a series, by FFT."""
    key = pairs.select(*by, t, "y", "x").where("y IS NOT NULL AND x IS NOT NULL")
    fields = [pairs.schema[b].simpleString().replace(":", " ") for b in by]

    def one(ids, pdf):
        pdf = pdf.sort_values(t)
        out = K.lag_scan(pdf["y"].to_numpy(float), pdf["x"].to_numpy(float), most, least)
        for k, b in enumerate(by):
            out.insert(k, b, ids[k])
        return out

    scanned = key.groupBy(*by).applyInPandas(one, ", ".join([*fields, "lag int", "r double", "p double", "n long"]))
    return benjamini_hochberg(scanned, family=by)


def differenced(pairs: DataFrame, t: str = "t") -> DataFrame:
    w = Window.orderBy(t)
    return pairs.select(t, *((F.col(c) - F.lag(c).over(w)).alias(c) for c in ("y", "x"))).where("y IS NOT NULL AND x IS NOT NULL")


def level_and_difference(pairs: DataFrame) -> DataFrame:
    """One row: r and exact p of levels and of first differences, weeks, and the best lag."""
    a = shift_p(shift_null(pairs)).select(F.col("r").alias("r_level"), F.col("p").alias("p_level"), F.col("n").alias("n_weeks"))
    b = shift_p(shift_null(differenced(pairs))).select(F.col("r").alias("r_diff"), F.col("p").alias("p_diff"))
    best = lagged(pairs).orderBy(F.abs("r").desc(), "lag").limit(1).select(F.col("lag").alias("best_lag"), F.col("r").alias("best_r"))
    return a.crossJoin(b).crossJoin(best)  # one row each


def distance_correlation(pairs: DataFrame, x: str = "x", y: str = "y", t: str = "t") -> DataFrame:
    """Distance correlation of one pair of series of some hundred points, from all pairs' distances: dcor, n."""
    a = pairs.select(F.col(t).alias("i"), F.col(x).alias("xi"), F.col(y).alias("yi"))
    b = pairs.select(F.col(t).alias("j"), F.col(x).alias("xj"), F.col(y).alias("yj"))
    d = a.join(F.broadcast(b)).select("i", "j", F.abs(F.col("xi") - F.col("xj")).alias("a"), F.abs(F.col("yi") - F.col("yj")).alias("b"))  # a stated, bounded series
    row, col, everything = Window.partitionBy("i"), Window.partitionBy("j"), Window.partitionBy()
    centred = d.select(*((F.col(c) - F.avg(c).over(row) - F.avg(c).over(col) + F.avg(c).over(everything)).alias(c) for c in "ab"), F.lit(1).alias("one"))
    s = centred.agg(F.avg(F.col("a") * F.col("b")).alias("ab"), F.avg(F.col("a") * F.col("a")).alias("aa"), F.avg(F.col("b") * F.col("b")).alias("bb"), F.sqrt(F.count("*")).alias("n"))
    return s.select(F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.sqrt(F.greatest(F.col("ab"), F.lit(0.0)) / F.sqrt(F.col("aa") * F.col("bb")))).otherwise(0.0).alias("dcor"), F.col("n").cast("long").alias("n"))


def kendall(rows: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    """Kendall's tau-b of position against value within groups of some dozen points: by, tau, n."""
    a = rows.select(*by, F.col(order).alias("i"), F.col(value).alias("u")).where("u IS NOT NULL")
    b = a.select(*by, F.col("i").alias("j"), F.col("u").alias("v"))
    pairs = a.join(b, by).where("i < j")
    s = pairs.groupBy(*by).agg(F.sum(F.signum(F.col("v") - F.col("u"))).alias("s"), F.count_if(F.col("u") != F.col("v")).alias("untied"), F.count("*").alias("pairs"))
    return s.select(*by, F.when(F.col("untied") > 0, F.col("s") / F.sqrt(F.col("pairs") * F.col("untied"))).alias("tau"), ((1 + F.sqrt(1 + 8 * F.col("pairs"))) / 2).cast("long").alias("n"))


def volatility(series: DataFrame, value: str, order: str = "day") -> DataFrame:
    """Lag-1 correlations of a series, its absolute values and its squares: raw, absolute, squared."""
    w = Window.orderBy(order)
    v = F.col(value)
    rows = series.select(v.alias("a"), F.lag(v).over(w).alias("b"))
    return rows.where("b IS NOT NULL").agg(F.corr("a", "b").alias("raw"), F.corr(F.abs("a"), F.abs("b")).alias("absolute"), F.corr(F.col("a") ** 2, F.col("b") ** 2).alias("squared"))


def best_split(series: DataFrame, value: str, order: str = "t", least: int = 4) -> DataFrame:
    """The single mean shift that takes most of the sum of squares: pos (rows before it), gain; the first of ties."""
    w = Window.orderBy(order)
    everything = Window.partitionBy()
    rows = series.select(F.row_number().over(w).alias("k"), F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("l"), F.sum(value).over(everything).alias("s"), F.count("*").over(everything).alias("n"))
    gain = F.col("l") ** 2 / F.col("k") + (F.col("s") - F.col("l")) ** 2 / (F.col("n") - F.col("k")) - F.col("s") ** 2 / F.col("n")
    return rows.where((F.col("k") >= least) & (F.col("k") <= F.col("n") - least)).select(F.col("k").alias("pos"), gain.alias("gain")).orderBy(F.desc("gain"), "pos").limit(1)


def regime_summary(segments: DataFrame, value: str, segment: str, order: str) -> DataFrame:
    """One row on a partition of a series into segments: change points, share between, shifts, dwell times."""
    g = segments.groupBy(segment).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.min(order).alias("o"))
    total = segments.agg(F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("sst"))
    rows = g.withColumn("shift", F.abs(F.col("m") - F.lag("m").over(Window.orderBy("o")))).crossJoin(F.broadcast(total))
    a = rows.agg((F.count("*") - 1).alias("k_changepoints"), F.sum("n").alias("n"), (F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2) / F.max("sst")).alias("between_share"), F.coalesce(F.avg("shift"), F.lit(0.0)).alias("mean_abs_shift"), F.coalesce(F.max("shift"), F.lit(0.0)).alias("max_abs_shift"), F.percentile("n", F.lit(0.5)).alias("median_dwell"), F.min("n").alias("min_dwell"))
    return a


def surrogate_scan(pairs: DataFrame, by: list[str], statistics: tuple[str, ...] = tuple(K.ASSOCIATIONS), kinds: tuple[str, ...] = ("phase",), t: str = "t", screen: int = 200, refine: int = 5000, at: float = 0.10, block: int = 500) -> DataFrame:
    """by, statistic, surrogate, observed, p, n_null, n: each statistic of y with x against `screen` surrogates of x; where p is at most
    `at` against `refine` instead. A group holds one series of some hundred points and one block of draws, so draws spread over tasks."""
    held = pairs.select(*by, t, "y", "x").where("y IS NOT NULL AND x IS NOT NULL")
    kinds_of = [f"{b} {held.schema[b].dataType.simpleString()}" for b in by]
    keys = [*by, "statistic", "surrogate", "block"]

    def one(ids, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(t)
        y, x, (statistic, kind, part), draws = pdf["y"].to_numpy(float), pdf["x"].to_numpy(float), ids[-3:], int(pdf["draws"].iloc[0])
        seen = K.ASSOCIATIONS[statistic](y, x)
        null = K.association_null(statistic, y, K.surrogates(kind, x, K.rng_of(*map(str, ids[:-1]), draws, part), draws))
        return pd.DataFrame([(*ids, seen, int((np.abs(null) >= abs(seen) - 1e-12).sum()), draws, len(y))], columns=[*keys, "observed", "beyond", "draws", "n"])

    def counted(rows: DataFrame) -> DataFrame:
        each = rows.groupBy(*keys).applyInPandas(one, ", ".join([*kinds_of, "statistic string, surrogate string, block int, observed double, beyond long, draws long, n long"]))
        return each.groupBy(*keys[:-1]).agg(F.first("observed").alias("observed"), F.sum("beyond").alias("_b"), F.sum("draws").alias("n_null"), F.first("n").alias("n")).select(*keys[:-1], "observed", ((F.col("_b") + 1) / (F.col("n_null") + 1)).alias("p"), "n_null", "n")

    asked = F.explode(F.array(*(F.struct(F.lit(s).alias("statistic"), F.lit(k).alias("surrogate")) for s in statistics for k in kinds))).alias("_a")
    first = saved(counted(held.select("*", asked).select(*held.columns, "_a.*").withColumns({"block": F.lit(0), "draws": F.lit(screen).cast("long")})), "surrogate-screen")
    if refine <= screen:
        return first
    near = first.where(F.col("p") <= at)
    blocks = -(-refine // block)
    again = held.join(near.select(*keys[:-1]), by).withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(blocks)))).withColumn("draws", F.when(F.col("block") == blocks, refine - (blocks - 1) * block).otherwise(block).cast("long"))
    return first.where(F.col("p") > at).unionByName(counted(again))
