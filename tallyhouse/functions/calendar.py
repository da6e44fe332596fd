"""Calendar expressions: period keys, n-th weekdays, holidays, clock changes, regressors of a day."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Holidays as (month, day) and as (month, weekday with Monday 0, n from 0, -1 for the last).
FIXED = {
    "en": ((1, 1), (7, 4), (12, 24), (12, 25), (12, 26), (12, 31)),
    "ru": (*((1, d) for d in range(1, 9)), (2, 23), (3, 8), (5, 1), (5, 9), (6, 12), (11, 4)),
}
MOVING = {"en": ((11, 3, 3), (9, 0, 0), (5, 0, -1)), "ru": ()}
#: Clock changes as moving days: (spring, autumn); none in ru.
CLOCK = {"en": ((3, 6, 1), (11, 6, 0)), "ru": ()}
YEAR = 365.25


def period(day: Column, unit: str) -> Column:
    """First day of the day, week (Monday), month or quarter."""
    return F.to_date(day) if unit == "D" else F.to_date(F.date_trunc({"W": "week", "M": "month", "Q": "quarter"}[unit], day))


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """Date of the n-th (from 0; -1: last) weekday (Monday 0) of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n < 0:
        last = F.last_day(first)
        return F.date_sub(last, F.pmod(F.weekday(last) - weekday, F.lit(7)) - 7 * (n + 1))
    return F.date_add(first, F.pmod(weekday - F.weekday(first), F.lit(7)) + 7 * n)


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def is_holiday(day: Column, region: str) -> Column:
    y = F.year(day)
    fixed = [(F.month(day) == m) & (F.dayofmonth(day) == d) for m, d in FIXED[region]]
    return _any(fixed + [day == nth_weekday(y, *m) for m in MOVING[region]])


def after_clock_change(day: Column, region: str, which: int) -> Column:
    """In the seven days from the spring (0) or autumn (1) change on."""
    if not CLOCK[region]:
        return F.lit(False)
    gap = F.datediff(day, nth_weekday(F.year(day), *CLOCK[region][which]))
    return gap.between(0, 6)


def harmonics(day: Column) -> dict[str, Column]:
    a = 2 * math.pi * F.dayofyear(day) / YEAR
    return {f"{n}{k}": f(a * k) for k in (1, 2) for n, f in (("s", F.sin), ("c", F.cos))}


def calendar_design(days: DataFrame, day: str = "day", n: str | None = None) -> DataFrame:
    """Adds trend (standardised with the population spread), two annual harmonics, six weekday columns and, if asked, centred log volume.

    One row a day, so the whole-series window holds few rows.
    """
    everything = Window.partitionBy()
    t = F.datediff(F.col(day), F.min(day).over(everything))
    out = days.withColumn("_t", t).withColumn("trend", (F.col("_t") - F.avg("_t").over(everything)) / (F.stddev_pop("_t").over(everything) + 1e-9)).drop("_t")
    out = out.withColumns({**harmonics(F.col(day)), **{f"dow{k}": (F.weekday(day) == k).cast("double") for k in range(1, 7)}})
    if n:
        out = out.withColumn("logn", F.log(n) - F.avg(F.log(n)).over(everything))
    return out


def social_design(days: DataFrame, region: str, day: str = "day") -> DataFrame:
    """calendar_design with holiday, holiday_eve (no holiday itself), clock-change weeks and summer."""
    d = F.col(day)
    own, eve = is_holiday(d, region), is_holiday(F.date_add(d, 1), region)
    more = {"holiday": own, "holiday_eve": eve & ~own, "dst_spring": after_clock_change(d, region, 0), "dst_fall": after_clock_change(d, region, 1), "summer": F.month(d).between(7, 8)}
    return calendar_design(days, day).withColumns({k: v.cast("double") for k, v in more.items()})
