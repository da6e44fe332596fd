"""Event studies on daily series: observed effects by windows of running sums, nulls by seeded pseudo-events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import near_days
from .ranks import quantiles
from .windows import calendar

START = "1970-01-01"


def _offsets(days: DataFrame, day: str, n: str, value: str, least: int) -> DataFrame:
    """Running sum and count of the values of eligible days, on every offset 0..span (before the day of that offset)."""
    good = days.where(F.col(n) >= least).select(day, value)
    dense = calendar(good, day)
    w = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)  # one row a day of one series
    base = F.min(day).over(Window.partitionBy())
    rows = dense.select(F.datediff(day, base).alias("at"), F.col(day).alias("day"), F.col(value).isNotNull().alias("eligible"), F.coalesce(F.sum(F.coalesce(value, F.lit(0.0))).over(w), F.lit(0.0)).alias("c"), F.count(value).over(w).alias("m"), F.coalesce(F.col(value), F.lit(0.0)).alias("v"))
    last = rows.orderBy(F.desc("at")).limit(1).select((F.col("at") + 1).alias("at"), F.lit(None).cast("date").alias("day"), F.lit(False).alias("eligible"), (F.col("c") + F.col("v")).alias("c"), (F.col("m") + F.col("eligible").cast("long")).alias("m"), F.lit(0.0).alias("v"))
    return rows.union(last).select("at", "day", "eligible", "c", "m")


def window_means(anchors: DataFrame, prefix: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """anchors (at, …) with the mean of each window at+lo..at+hi, clipped to the series; NULL for a window without eligible days."""
    span = prefix.agg(F.max("at").alias("_span"))
    rows = anchors.crossJoin(F.broadcast(span))  # one row
    p = F.broadcast(prefix.select("at", "c", "m"))  # a row for each day of one series
    for name, (lo, hi) in windows.items():
        clip = lambda x: F.greatest(F.lit(0), F.least(F.col("_span"), x))
        rows = rows.withColumns({"_a": clip(F.col("at") + lo), "_b": clip(F.col("at") + hi + 1)})
        a, b = (p.select(F.col("at").alias(f"_{x}"), F.col("c").alias(f"_c{x}"), F.col("m").alias(f"_m{x}")) for x in "ab")
        rows = rows.join(a, "_a").join(b, "_b")
        rows = rows.withColumn(name, F.when(F.col("_mb") > F.col("_ma"), (F.col("_cb") - F.col("_ca")) / (F.col("_mb") - F.col("_ma")))).drop("_a", "_b", "_ca", "_cb", "_ma", "_mb")
    return rows.drop("_span")


def event_effects(days: DataFrame, events: DataFrame, value: str, n: str = "n", day: str = "day", post: tuple[int, int] = (1, 7), pre: tuple[int, int] = (-21, -4), least: int = 15) -> DataFrame:
    """Each event on an eligible day with its post and pre means and their difference: event, post, pre, effect."""
    prefix = _offsets(days, day, n, value, least)
    at = prefix.where("eligible").join(events.select(F.col(day).alias("day")).distinct(), "day", "left_semi").select("at", F.col("day").alias("event"))
    return window_means(at, prefix, {"post": post, "pre": pre}).select("event", "post", "pre", (F.col("post") - F.col("pre")).alias("effect"))


def event_study(days: DataFrame, events: DataFrame, value: str, n: str = "n", day: str = "day", post: tuple[int, int] = (1, 7), pre: tuple[int, int] = (-21, -4), least: int = 15, permutations: int = 20_000, seed: int = 0) -> DataFrame:
    """One row: events used and dropped, effect, null mean and spread, two-sided p. Pseudo-events are drawn by hash, with replacement, from the eligible days."""
    spark = days.sparkSession
    prefix = _offsets(days, day, n, value, least)
    asked = events.select(F.col(day).alias("day")).distinct()
    real = prefix.where("eligible").join(asked, "day", "left_semi").select("at")
    windows = {"post": post, "pre": pre}
    observed = window_means(real, prefix, windows).agg(F.count(F.col("post") - F.col("pre")).alias("n_events"), F.avg(F.col("post") - F.col("pre")).alias("effect"), F.count("*").alias("k"))
    # what a pseudo-event would show is the same in every draw: made once for each eligible day
    shown = window_means(prefix.where("eligible").select("at"), prefix, windows)
    pool = shown.select((F.row_number().over(Window.orderBy("at")) - 1).alias("i"), (F.col("post") - F.col("pre")).alias("x"))
    sizes = observed.crossJoin(pool.agg(F.count("*").alias("pool"))).crossJoin(asked.agg(F.count("*").alias("asked")))  # one row each
    draws = spark.range(permutations).withColumnRenamed("id", "perm").crossJoin(F.broadcast(sizes.select("k", "pool"))).where("k > 0")
    draws = draws.select("perm", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("j"), "pool").withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "perm", "j"), F.col("pool")))
    null = draws.join(F.broadcast(pool), "i").groupBy("perm").agg(F.avg("x").alias("x")).where("x IS NOT NULL")  # a row a day of one series
    told = null.crossJoin(F.broadcast(sizes)).groupBy("n_events", "effect", "k", "asked").agg(F.avg("x").alias("null_mean"), F.stddev_pop("x").alias("null_sd"), F.count("*").alias("n_null"), F.count_if(F.abs("x") >= F.abs("effect")).alias("beyond"))
    return told.select("n_events", (F.col("asked") - F.col("k")).alias("n_dropped"), "effect", "null_mean", "null_sd", F.try_divide("effect", "null_sd").alias("z"), ((F.col("beyond") + 1) / (F.col("n_null") + 1)).alias("p"))


def aligned_curve(days: DataFrame, events: DataFrame, value: str, lo: int = -21, hi: int = 21, base: tuple[int, int] = (-21, -4), day: str = "day") -> DataFrame:
    """Mean and standard error over events at each offset, each event less its own mean over the base offsets: offset, mean, sem, n."""
    rows = near_days(events.select(day).distinct(), lo, hi, day).join(days.select(day, value), day)
    own = F.avg(F.when(F.col("offset").between(*base), F.col(value))).over(Window.partitionBy("event"))
    rows = rows.withColumn("_x", F.col(value) - own).where("_x IS NOT NULL")
    return rows.groupBy("offset").agg(F.avg("_x").alias("mean"), (F.stddev_samp("_x") / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("n"))


def pair_correlation(events: DataFrame, most: int = 14, day: str = "day") -> DataFrame:
    """g(r): event pairs r days apart over those expected of events spread evenly over the span: lag, pairs, g."""
    e = events.select(F.datediff(day, F.lit(START).cast("date")).alias("d")).distinct()
    size = e.agg(F.count("*").alias("k"), (F.max("d") - F.min("d") + 1).alias("span"))
    ahead = e.select(F.col("d").alias("d0"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("lag")).withColumn("d", F.col("d0") + F.col("lag"))
    found = ahead.join(e, "d", "left_semi").groupBy("lag").agg(F.count("*").alias("pairs"))
    lags = days_range(events.sparkSession, 1, most, "lag")
    expected = F.col("k") * (F.col("k") - 1) / 2 * 2 * (F.col("span") - F.col("lag")) / (F.col("span") * (F.col("span") - 1))
    return lags.join(found, "lag", "left").crossJoin(F.broadcast(size)).select("lag", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.try_divide(F.coalesce("pairs", F.lit(0)), expected).alias("g"))


def days_range(spark, lo: int, hi: int, name: str) -> DataFrame:
    return spark.range(lo, hi + 1).select(F.col("id").cast("int").alias(name))


def branching(days: DataFrame, value: str, quantile: float = 0.90, ahead: int = 3, day: str = "day") -> DataFrame:
    """Share of the `ahead` days after a top day that are top days themselves, over the base rate of top days: n_spikes, post_rate, base_rate, ratio."""
    cut = days.agg(F.percentile(value, F.lit(quantile)).alias("_cut"))
    d = days.crossJoin(F.broadcast(cut)).select(day, (F.col(value) >= F.col("_cut")).alias("top"))
    after = d.where("top").select(day, F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("o")).select(F.date_add(day, F.col("o")).alias(day))
    post = after.join(d, day).agg(F.avg(F.col("top").cast("int")).alias("post_rate"))
    base = d.agg(F.count_if("top").alias("n_spikes"), F.avg(F.col("top").cast("int")).alias("base_rate"))
    return base.crossJoin(post).withColumn("ratio", F.try_divide("post_rate", "base_rate"))


def displaced_branching(days: DataFrame, value: str, step: int = 7, quantile: float = 0.90, ahead: int = 3, day: str = "day") -> DataFrame:
    """The same with the after-days taken from the series shifted by every multiple of `step` (modulo the span): shift, ratio. Shift 0 is the observed one."""
    cut = days.agg(F.percentile(value, F.lit(quantile)).alias("_cut"), F.min(day).alias("_lo"), (F.datediff(F.max(day), F.min(day)) + 1).alias("_span"))
    d = days.crossJoin(F.broadcast(cut)).select(F.datediff(day, "_lo").alias("at"), (F.col(value) >= F.col("_cut")).cast("int").alias("top"), "_span")
    spikes = d.where("top = 1").select("at", "_span", F.explode(F.expr(f"sequence(0, _span - 1, {step})")).alias("shift"))
    after = spikes.select("shift", F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("o"), "at", "_span").select("shift", F.pmod(F.col("at") + F.col("o") + F.col("shift"), F.col("_span")).alias("at"))
    base = d.agg(F.avg("top").alias("base"))
    return after.join(d.select("at", "top"), "at").groupBy("shift").agg(F.avg("top").alias("post")).crossJoin(F.broadcast(base)).select("shift", F.try_divide("post", "base").alias("ratio"))


def placebo_days(days: DataFrame, events: DataFrame, count: int, exclusion: int = 30, seed: int = 0, day: str = "day") -> DataFrame:
    """`count` days at least `exclusion` days from every event, in the order of a seeded hash."""
    near = near_days(events, -exclusion + 1, exclusion - 1, day).select(day).distinct()
    d = F.datediff(day, F.lit(START).cast("date")).cast("long")
    return days.select(day).distinct().join(near, day, "left_anti").orderBy(F.pmod(d * 2654435761 + seed, F.lit(4294967296)), day).limit(count)


def phase_portrait(rows: DataFrame, stage: Column, level: str, nxt: str, person: str, bands: int = 5, least_reports: int = 20, least_people: int = 5) -> DataFrame:
    """Occupancy and mean next step by stage and quantile band of level, blanked below the floor: stage, band, n, people, step."""
    cuts = quantiles(rows, level, [k / bands for k in range(1, bands)])
    band = sum(((F.col(level) > F.col(f"_q{k}")).cast("int") for k in range(bands - 1)), F.lit(0))
    placed = rows.crossJoin(F.broadcast(cuts)).select(stage.alias("stage"), band.alias("band"), (F.col(nxt) - F.col(level)).alias("_s"), F.col(person).alias("_p"))
    g = placed.groupBy("stage", "band").agg(F.count("*").alias("n"), F.count_distinct("_p").alias("people"), F.avg("_s").alias("step"))
    return g.withColumn("step", F.when((F.col("n") >= least_reports) & (F.col("people") >= least_people), F.col("step")))
