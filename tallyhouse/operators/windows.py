"""Series operators: calendars, rolling statistics, gaps, anchors, ranks, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import robust_z
from .ranks import ranked


def rolling_z(series: DataFrame, value: str, by: list[str], order: str = "day", window: int = 28, least: int = 14) -> DataFrame:
    return series.withColumn("z", robust_z(value, by, order, window, least))


def anomalies(days: DataFrame, features: list[str], by: list[str], day: str = "day", least_reports: int = 20, least_people: int = 5, threshold: float = 3.0) -> DataFrame:
    """Days of enough reports and people on which a feature lies `threshold` robust z or more from its past."""
    ids = [*by, day, "n_reports", "n_users"]
    long = days.where((F.col("n_reports") >= least_reports) & (F.col("n_users") >= least_people)).unpivot(ids, features, "feature", "value")
    return rolling_z(long, "value", [*by, "feature"], day).where(F.abs("z") >= threshold)


def calendar(series: DataFrame, day: str = "day", by: list[str] | None = None) -> DataFrame:
    """Every day from the first to the last, with the series' columns where it has them."""
    by = by or []
    span = series.groupBy(*by).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    days = span.select(*by, F.explode(F.sequence("_lo", "_hi")).alias(day))
    return days.join(series, [*by, day], "left")


def prefix_sums(series: DataFrame, value: str, day: str = "day", by: list[str] | None = None) -> DataFrame:
    """On the dense calendar, running sum and count of the known values up to each day: the difference of two rows gives any window's mean."""
    w = Window.partitionBy(*(by or [])).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    dense = calendar(series, day, by)
    return dense.withColumns({"csum": F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w), "ccount": F.count(value).over(w)})


def rolling(series: DataFrame, value: str, before: int, after: int = 0, least: int = 1, how: str = "mean", order: str = "day", by: list[str] | None = None, name: str = "rolling") -> DataFrame:
    """A statistic over rows -before..+after; NULL with fewer than `least` known values."""
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(-before, after)
    stat = {"mean": F.avg(value), "median": F.percentile(value, F.lit(0.5)), "var": F.var_samp(value), "max": F.max(value), "min": F.min(value), "sum": F.sum(value)}[how]
    return series.withColumn(name, F.when(F.count(value).over(w) >= least, stat.over(w)))


def detrend_local(series: DataFrame, value: str, window: int = 61, least: int = 20, order: str = "day", by: list[str] | None = None) -> DataFrame:
    """value less its centred rolling median."""
    r = rolling(series, value, window // 2, window // 2, least, "median", order, by, "_m")
    return r.withColumn(f"{value}_dt", F.col(value) - F.col("_m")).drop("_m")


def warning_indicators(series: DataFrame, value: str, window: int = 28, order: str = "day", by: list[str] | None = None) -> DataFrame:
    """Rolling sample variance and lag-1 autocorrelation over `window` rows, from half of them on; the latter needs six values."""
    part = Window.partitionBy(*(by or [])).orderBy(order)
    rows = series.withColumn("_lag", F.lag(value).over(part))
    w, pairs = part.rowsBetween(1 - window, 0), part.rowsBetween(2 - window, 0)
    known = F.count(value).over(w)
    # the first pair of a frame reaches one row back, so the frame of pairs is one row shorter
    ar1 = F.corr(value, "_lag").over(pairs)
    return rows.withColumns({"variance": F.when(known >= window // 2, F.var_samp(value).over(w)), "ar1": F.when((known >= window // 2) & (known > 5), ar1)}).drop("_lag")


def forward_excursion(series: DataFrame, value: str, ahead: int = 14, behind: int = 7, order: str = "day", by: list[str] | None = None) -> DataFrame:
    """Mean of the next `ahead` rows less the mean of the last `behind`, where both are whole."""
    part = Window.partitionBy(*(by or [])).orderBy(order)
    f, b = part.rowsBetween(1, ahead), part.rowsBetween(1 - behind, 0)
    whole = (F.count(value).over(f) == ahead) & (F.count(value).over(b) == behind)
    return series.withColumn("excursion", F.when(whole, F.avg(value).over(f) - F.avg(value).over(b)))


def spaced(positions: Column, gap: int) -> Column:
    """Of sorted integers those that lie `gap` or more after the last one kept; the first is kept."""
    empty = F.array().cast("array<int>")

    def step(kept: Column, p: Column) -> Column:
        return F.when((F.size(kept) == 0) | (p - F.element_at(kept, -1) >= gap), F.concat(kept, F.array(p))).otherwise(kept)

    return F.aggregate(F.array_sort(positions.cast("array<int>")), empty, step)


def anchors(series: DataFrame, value: str, gap: int = 42, quantile: float = 0.90, order: str = "day", by: list[str] | None = None) -> DataFrame:
    """Rows whose forward excursion lies in the top decile, thinned to a gap: by, pos (0-based row)."""
    by = by or []
    rows = forward_excursion(series, value, order=order, by=by).withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    cut = rows.groupBy(*by).agg(F.percentile("excursion", F.lit(quantile)).alias("cut"))
    top = (rows.join(cut, by) if by else rows.crossJoin(F.broadcast(cut))).where(F.col("excursion") >= F.col("cut"))
    return top.groupBy(*by).agg(F.collect_list("pos").alias("p")).select(*by, F.explode(spaced(F.col("p"), gap)).alias("pos"))


def space_events(events: DataFrame, day: str = "day", gap: int = 28, by: list[str] | None = None) -> DataFrame:
    """Event days thinned to `gap` days or more after the last one kept."""
    by = by or []
    start = F.lit("1970-01-01").cast("date")
    listed = events.select(*by, F.datediff(day, start).alias("d")).distinct().groupBy(*by).agg(F.collect_list("d").alias("p"))
    return listed.select(*by, F.explode(spaced(F.col("p"), gap)).alias("_d")).select(*by, F.date_add(start, F.col("_d")).alias(day))


def split_by_time(df: DataFrame, person: str, order: list[str], share: float = 0.6) -> DataFrame:
    """Adds test: whether a row comes after the first ceil(share n) of its person's rows."""
    own = Window.partitionBy(person)
    return df.withColumn("test", (F.row_number().over(own.orderBy(*order)) - 1) >= F.ceil(share * F.count("*").over(own)))


def loo_deviation(df: DataFrame, value: str, person: str = "user_id", name: str = "dev") -> DataFrame:
    """value less the mean of the same person's other rows; NULL for a person of one row."""
    own = Window.partitionBy(person)
    n, s = F.count(value).over(own), F.sum(value).over(own)
    return df.withColumn(name, F.when(n > 1, F.col(value) - (s - F.col(value)) / (n - 1)))


def loo_matrix(df: DataFrame, values: list[str], person: str = "user_id", least: int = 3) -> DataFrame:
    """loo_deviation of many columns, for people of `least` rows or more."""
    own = Window.partitionBy(person)
    rows = df.withColumn("_n", F.count("*").over(own)).where(F.col("_n") >= least)
    sums = {f"{v}_dev": F.col(v) - (F.sum(v).over(own) - F.col(v)) / (F.col("_n") - 1) for v in values}
    return rows.withColumns(sums).drop("_n")


def past_only(df: DataFrame, values: list[str], person: str, period: str) -> DataFrame:
    """Each value less the person's value in the eligible period before."""
    w = Window.partitionBy(person).orderBy(period)
    return df.withColumns({f"{v}_state": F.col(v) - F.lag(v).over(w) for v in values})


def first_seen(df: DataFrame, person: str = "user_id", day: str = "day") -> DataFrame:
    first = F.min(day).over(Window.partitionBy(person))
    return df.withColumns({"first_seen": first, "is_new": F.col(day) == first})


def tenure_quarters(df: DataFrame, person: str = "user_id", day: str = "day") -> DataFrame:
    first = F.min(day).over(Window.partitionBy(person))
    quarter = lambda c: F.year(c) * 4 + F.quarter(c)
    return df.withColumn("tenure", quarter(F.col(day)) - quarter(first))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*(by or []), x, y)
    return ranked(known, [x, y], by).groupBy(*(by or [])).agg(F.corr(f"_r_{x}", f"_r_{y}").alias("rho"), F.count("*").alias("n"))


def volume_tercile(days: DataFrame, n: str, day: str = "day", by: list[str] | None = None) -> DataFrame:
    """0, 1, 2 by linearly interpolated thirds of the rank of volume (ties by day)."""
    part = Window.partitionBy(*(by or []))
    rank, size = F.row_number().over(part.orderBy(n, day)), F.count("*").over(part)
    return days.withColumn("tercile", F.when(rank <= 1 + (size - 1) / 3, 0).when(rank <= 1 + 2 * (size - 1) / 3, 1).otherwise(2))


def eligible_days(days: DataFrame, n: str = "n_reports", day: str = "day", least: int = 15) -> DataFrame:
    """Days of enough reports with weekday (Monday 0), month and volume tercile."""
    return volume_tercile(days.where(F.col(n) >= least).withColumns({"weekday": F.weekday(day), "month": F.month(day)}), n, day)


def filled(series: DataFrame, value: str, day: str = "day", by: list[str] | None = None) -> DataFrame:
    """On the dense calendar, gaps filled linearly between neighbours, ends by the nearest value; observed says which days were known."""
    by = by or []
    part = Window.partitionBy(*by).orderBy(day)
    back, ahead = part.rowsBetween(Window.unboundedPreceding, 0), part.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(day))
    d = calendar(series, day, by).withColumns({"_v0": F.last(value, True).over(back), "_v1": F.first(value, True).over(ahead), "_d0": F.last(at, True).over(back), "_d1": F.first(at, True).over(ahead)})
    share = F.datediff(day, "_d0") / F.datediff("_d1", "_d0")
    full = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_v0").isNull(), F.col("_v1")).when(F.col("_v1").isNull(), F.col("_v0")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share)
    return d.withColumns({"observed": F.col(value).isNotNull(), "filled": full}).drop("_v0", "_v1", "_d0", "_d1")


def step_fill(series: DataFrame, value: str, day: str = "day", limit: int = 40, by: list[str] | None = None) -> DataFrame:
    """On the dense calendar, the last known value of at most `limit` days ago."""
    w = Window.partitionBy(*(by or [])).orderBy(day).rowsBetween(-limit, 0)
    return calendar(series, day, by).withColumn(value, F.last(value, True).over(w))


def shortest_prefix(df: DataFrame, order: list[str], person: str = "user_id", least_reports: int = 20, least_people: int = 5, by: list[str] | None = None) -> DataFrame:
    """Length of the shortest beginning that holds enough reports of enough people; NULL where none does."""
    by = by or []
    seq = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(Window.partitionBy(*by, person).orderBy(*order)) == 1
    rows = df.withColumns({"_first": first.cast("int"), "_n": F.row_number().over(seq)})
    rows = rows.withColumn("_people", F.sum("_first").over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    ok = (F.col("_n") >= least_reports) & (F.col("_people") >= least_people)
    return rows.groupBy(*by).agg(F.min(F.when(ok, F.col("_n"))).alias("min_prefix"))


def top_edges(edges: DataFrame, strength: str, density: float = 0.15, by: list[str] | None = None) -> DataFrame:
    """The strongest max(1, round(density E)) edges by absolute strength; ties by a, b."""
    part = Window.partitionBy(*(by or []))
    keep = F.greatest(F.lit(1), F.bround(density * F.count("*").over(part)))
    return edges.withColumn("_r", F.row_number().over(part.orderBy(F.abs(strength).desc(), "a", "b"))).withColumn("_k", keep).where("_r <= _k").drop("_r", "_k")


def impact(effect: Column, q: Column, weight: Column) -> Column:
    return F.abs(effect) * -F.log10(F.least(F.greatest(F.coalesce(q, F.lit(1.0)), F.lit(1e-6)), F.lit(1.0))) * weight


def ranked_findings(findings: DataFrame) -> DataFrame:
    """Findings (category, effect, q, …) by impact, with rank and a scale to 100; one row a finding, so one task orders them."""
    scored = findings.withColumn("impact", impact(F.col("effect"), F.col("q"), F.when(F.col("category") == "event_study", 1.2).otherwise(1.0)))
    top = F.max("impact").over(Window.partitionBy())
    order = Window.orderBy(F.desc("impact"), *[c for c in findings.columns if c not in ("effect", "q")])
    return scored.withColumns({"rank": F.row_number().over(order), "impact_0_100": F.when(top > 0, F.round(100 * F.col("impact") / top, 1)).otherwise(0.0)})
