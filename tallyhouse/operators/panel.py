"""Cleaning and aggregation: from reports to contributor-days, days, weeks and months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles


def first_per_key(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def clean(df: DataFrame, key: str, ts: str, start: str, end: str, order: list[Column | str]) -> DataFrame:
    """One row a key (the first), with a time, between the dates start and end; `day` is the time's date."""
    one = first_per_key(df, [key], order)
    return one.where(F.col(ts).isNotNull()).withColumn("day", F.to_date(ts)).where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def dropped(df: DataFrame, key: str, ts: str, start: str, end: str) -> DataFrame:
    """How many rows clean() leaves out, by reason, in one pass."""
    seen = df.groupBy(key).agg(F.count("*").alias("n"), F.min(ts).alias("t"))
    day = F.to_date("t")
    out = ~day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return seen.agg(F.sum(F.col("n") - 1).alias("repeated"), F.count_if(F.col("t").isNull()).alias("no_time"), F.count_if(out).alias("out_of_range"))


def daily(df: DataFrame, axes: list[str], day: str = "day", stratum: str = "lang", person: str = "user_id", unknown: str = "unknown") -> DataFrame:
    """Means, reports and contributors by day for all strata together ('all', which holds the unknown) and each known stratum, in one pass."""
    ids = df.groupingSets([[F.col(day)], [F.col(stratum), F.col(day)]], F.col(stratum), F.col(day))
    agg = ids.agg(F.grouping(stratum).alias("_all"), *(F.avg(a).alias(f"{a}_mean") for a in axes), F.count("*").alias("n_reports"), F.count_distinct(person).alias("n_users"))
    named = agg.withColumn(stratum, F.when(F.col("_all") == 1, "all").otherwise(F.col(stratum))).drop("_all")
    return named.where((F.col(stratum) != unknown) & F.col(stratum).isNotNull())


def weekly(days: DataFrame, means: list[str], day: str = "day", stratum: str = "lang") -> DataFrame:
    """Means weighted by reports (one day's NULL makes the week's NULL), reports, and contributor-days."""

    def weighted(m: str) -> Column:
        return F.when(F.count_if(F.col(m).isNull()) == 0, F.sum(F.col(m) * F.col("n_reports")) / F.sum("n_reports")).alias(m)

    week = F.to_date(F.date_trunc("week", day)).alias("week")
    return days.groupBy(stratum, week).agg(*(weighted(m) for m in means), F.sum("n_reports").alias("n_reports"), F.sum("n_users").alias("n_userdays"))


def to_weekly(series: DataFrame, value: str, how: str = "mean", day: str = "day", by: list[str] | None = None) -> DataFrame:
    """A daily series by week: its mean, its sum, or its last value."""
    agg = {"mean": F.avg(value), "sum": F.sum(value), "last": F.max_by(value, day)}[how]
    return series.groupBy(*(by or []), F.to_date(F.date_trunc("week", day)).alias("week")).agg(agg.alias(value))


def returns(weeks: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Adds the relative change to the week before (by position)."""
    before = F.lag(value).over(Window.partitionBy(*(by or [])).orderBy("week"))
    return weeks.withColumn(f"{value}_return", F.try_divide(F.col(value), before) - 1)


def two_stage_mean(df: DataFrame, value: str, unit: str, day: str = "day") -> DataFrame:
    """The mean over units of a day, then over the days of a week."""
    by_day = df.groupBy(day, unit).agg(F.avg(value).alias(value)).groupBy(day).agg(F.avg(value).alias(value))
    return to_weekly(by_day, value, "mean", day)


def person_day(df: DataFrame, value: str, person: str = "user_id", day: str = "day") -> DataFrame:
    return df.groupBy(person, day).agg(F.avg(value).alias(value), F.count("*").alias("n_rep"))


def stable_people(df: DataFrame, person: str = "user_id", day: str = "day") -> DataFrame:
    """People seen in the first and in the last third of the whole span of days."""
    span = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    third = F.datediff("hi", "lo") / 3
    placed = df.crossJoin(F.broadcast(span)).select(person, (F.datediff(day, "lo") < third).alias("early"), (F.datediff("hi", day) < third).alias("late"))  # one row of span
    return placed.groupBy(person).agg(F.bool_or("early").alias("e"), F.bool_or("late").alias("l")).where("e AND l").select(person)


def mean_of_people(df: DataFrame, value: str, person: str = "user_id", by: list[str] | None = None) -> DataFrame:
    """Each person's mean, then the unweighted mean of those."""
    one = df.groupBy(*(by or []), person).agg(F.avg(value).alias("m"))
    return one.groupBy(*(by or [])).agg(F.avg("m").alias(value), F.count("*").alias("n_people"))


def period_moments(df: DataFrame, value: str, period: str, tail: float = 0.10, arc: str | None = None) -> DataFrame:
    """n, mean, population spread, share at or below the pooled quantile; with arc also its entropy and share of 'fall'."""
    cut = quantiles(df, value, [tail]).withColumnRenamed("_q0", "_cut")
    rows = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(cut))  # one row
    agg = [F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.avg((F.col(value) <= F.col("_cut")).cast("int")).alias("tail_rate")]
    if arc:
        shares = [F.avg((F.col(arc) == a).cast("int")) for a in ("fall", "rise", "peak", "trough")]
        agg += [-sum((F.when(s > 0, s * F.log(s)).otherwise(0.0) for s in shares), F.lit(0.0)), shares[0]]
        agg[-2], agg[-1] = agg[-2].alias("arc_entropy"), agg[-1].alias("p_fall")
    return rows.groupBy(period).agg(*agg)


def weighted_variance(df: DataFrame, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """Variance of values about their weighted mean, with the same weights."""
    w, v = F.col(weight), F.col(value)
    mean = F.sum(w * v) / F.sum(w)
    return df.groupBy(*(by or [])).agg((F.sum(w * v * v) / F.sum(w) - mean * mean).alias("wvar"))


def within_between(df: DataFrame, value: str, day: str = "day", person: str = "user_id") -> DataFrame:
    """By day: variance of all reports, of people's means, and pooled within people with max(n - people, 1) degrees of freedom."""
    one = df.groupBy(day, person).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    total = df.groupBy(day).agg(F.var_samp(value).alias("total"))
    pooled = one.groupBy(day).agg(F.sum("n").alias("n"), F.count("*").alias("people"), F.var_samp("m").alias("between"), (F.sum(F.col("v") * F.col("n")) / F.greatest(F.sum("n") - F.count("*"), F.lit(1))).alias("within"))
    return pooled.join(total, day)


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way analysis of variance by group: mean squares, F, the balanced size n0, and the group's spread and share."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    s = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    more = F.greatest(F.col("k") - 1, F.lit(1))
    s = s.withColumns({"msb": (F.col("nmm") - F.col("nm") * F.col("nm") / F.col("n")) / more, "msw": F.col("ssw") / F.greatest(F.col("n") - F.col("k"), F.lit(1)), "n0": (F.col("n") - F.col("nn") / F.col("n")) / more})
    n0 = F.greatest(F.col("n0"), F.lit(1e-9))
    gain = F.greatest(F.col("msb") - F.col("msw"), F.lit(0.0))
    return s.select("n", "k", "msb", "msw", F.when(F.col("msw") > 0, F.col("msb") / F.col("msw")).alias("f"), "n0", F.sqrt(gain / n0).alias("sd_day"), (gain / F.greatest(F.col("msb") + (n0 - 1) * F.col("msw"), F.lit(1e-12))).alias("icc_day"))


def top_items(df: DataFrame, items: str, value: str, n: int) -> DataFrame:
    """The n most frequent items of an array column, with frequency and mean value; ties by item."""
    e = df.select(F.explode(items).alias("item"), value)
    return e.groupBy("item").agg(F.count("*").alias("freq"), F.avg(value).alias("mean")).orderBy(F.desc("freq"), "item").limit(n)


def prevalence_slope(df: DataFrame, items: str, period: str, least: int = 20, periods: int = 6) -> DataFrame:
    """For each item the slope of its share of reports over the periods of `least` reports or more, if it is in `periods` of them."""
    size = df.groupBy(period).agg(F.count("*").alias("size")).where(F.col("size") >= least)
    counted = df.select(period, F.explode(F.array_distinct(items)).alias("item")).groupBy(period, "item").agg(F.count("*").alias("c"))
    share = counted.join(size, period).withColumn("prev", F.col("c") / F.col("size"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(period))
    return share.withColumn("t", rank).groupBy("item").agg(F.regr_slope("prev", "t").alias("slope"), F.count("*").alias("periods")).where(F.col("periods") >= periods)


def cooccurrence(df: DataFrame, key: str, items: str, among: DataFrame, least: int) -> DataFrame:
    """Pairs a < b of the items in `among` that share `least` rows or more; rows hold few of them, so pairs stay few."""
    e = df.select(key, F.explode(F.array_distinct(items)).alias("item")).join(among.select("item"), "item", "left_semi")
    held = e.groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("s"))
    pairs = held.select(F.explode(F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def token_counts(df: DataFrame, tokens: Column, by: list[str] | None = None) -> DataFrame:
    return df.select(*(by or []), F.explode(tokens).alias("token")).groupBy(*(by or []), "token").agg(F.count("*").alias("freq"))


def shares(df: DataFrame, row: Column, col: str, values: list) -> DataFrame:
    """Row-normalised cross table."""
    t = df.groupBy(row.alias("row")).pivot(col, values).count().na.fill(0)
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return t.select("row", *((F.col(f"`{v}`") / total).alias(str(v)) for v in values))


def profile(df: DataFrame, day: str = "day", person: str = "user_id", value: str = "value") -> DataFrame:
    """One row: reports, people, active days, span, medians."""
    per_day = df.groupBy(day).agg(F.count("*").alias("n"))
    a = df.agg(F.count("*").alias("n_reports"), F.count_distinct(person).alias("n_people"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    b = per_day.agg(F.count("*").alias("active_days"), F.percentile("n", F.lit(0.5)).alias("median_per_day"))
    m = quantiles(df, value, [0.5]).withColumnRenamed("_q0", "median_value")
    return a.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(b))  # one row each


def centroids(df: DataFrame, vector: list[str], person: str, period: str, least_reports: int = 3, least_people: int = 20) -> DataFrame:
    """Mean vectors of each person and period with enough reports, in periods with enough such people."""
    g = df.groupBy(person, period).agg(*(F.avg(v).alias(v) for v in vector), F.count("*").alias("n_period")).where(F.col("n_period") >= least_reports)
    return g.withColumn("_p", F.count("*").over(Window.partitionBy(period))).where(F.col("_p") >= least_people).drop("_p")


def composition(df: DataFrame, week: str = "week", person: str = "user_id", day: str = "day", flag: Column | None = None, among: Column | None = None, words: Column | None = None) -> DataFrame:
    """By week, over the rows in `among`: posts, authors, mean words, share by authors new that week; the flag's rate over all rows."""
    among = F.lit(True) if among is None else among
    rows = df.withColumns({"_in": among, "_flag": F.lit(False) if flag is None else flag, "_words": F.lit(None).cast("double") if words is None else words})
    first = F.min(F.when(F.col("_in"), F.col(day))).over(Window.partitionBy(person))
    rows = rows.withColumn("_new", (F.to_date(F.date_trunc("week", first)) == F.col(week)))
    return rows.groupBy(week).agg(
        F.count_if("_in").alias("n_posts"),
        F.count_distinct(F.when(F.col("_in"), F.col(person))).alias("n_authors"),
        F.avg(F.when(F.col("_in"), F.col("_words"))).alias("mean_words"),
        F.avg(F.when(F.col("_in"), F.col("_new").cast("int"))).alias("new_author_share"),
        F.avg(F.col("_flag").cast("int")).alias("flag_rate"),
    )


def presence_rates(df: DataFrame, axes: list[str], by: list[str], person: str = "user_id", adjusted: bool = False) -> DataFrame:
    """Mean of 0/1 axes by group; adjusted: of each report's difference from its person's mean."""
    own = Window.partitionBy(person)
    rows = df.withColumns({a: F.col(a) - F.avg(a).over(own) for a in axes}) if adjusted else df
    return rows.groupBy(*by).agg(*(F.avg(a).alias(a) for a in axes), F.count("*").alias("n"), F.count_distinct(person).alias("n_users"))


def gate(df: DataFrame, statistics: list[str], reports: str = "n_reports", people: str = "n_users", least_reports: int = 20, least_people: int = 5) -> DataFrame:
    """The disclosure floor: statistics of cells drawn from too few reports or people are blanked, counts stay."""
    enough = (F.col(reports) >= least_reports) & (F.col(people) >= least_people)
    return df.withColumns({s: F.when(enough, F.col(s)) for s in statistics})


def violations(df: DataFrame, statistics: list[str], reports: str = "n_reports", people: str = "n_users", least_reports: int = 20, least_people: int = 5) -> DataFrame:
    """Cells below the floor that still show a statistic."""
    shown = F.greatest(*(F.col(s).isNotNull() for s in statistics), F.lit(False))
    below = (F.coalesce(F.col(reports) < least_reports, F.lit(False))) | (F.coalesce(F.col(people) < least_people, F.lit(False)))
    return df.where(below & shown)


def composition_adjusted(df: DataFrame, value: str, mix: list[str], period: str, least: int) -> DataFrame:
    """period, raw, adj, n: means as they are and less what the period's mix explains (each report less its cell's mean, plus the mean of
    all), of periods with `least` reports."""
    cells = df.groupBy(*mix).agg(F.avg(value).alias("_cell"))
    everything = df.agg(F.avg(value).alias("_all"))
    adjusted = df.join(cells, mix).crossJoin(F.broadcast(everything))  # one row
    g = adjusted.groupBy(period).agg(F.avg(value).alias("raw"), F.avg(F.col(value) - F.col("_cell") + F.col("_all")).alias("adj"), F.count("*").alias("n"))
    return g.where(F.col("n") >= least)
