"""Expressions over arrays of doubles: trajectories and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return F.when(F.size(v) > 0, total(v) / F.size(v))


def sd(v: Column, ddof: int = 0) -> Column:
    def of(x: Column) -> Column:
        m = mean(x)
        return let(m, lambda mm: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, y: a + (y - mm) * (y - mm)) / (F.size(x) - ddof)))

    return F.when(F.size(v) > ddof, let(v, of))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, least: float = 1e-12) -> Column:
    """v over its length; NULL for a length below `least`."""
    return let(v, lambda x: let(norm(x), lambda n: F.when(n >= least, F.transform(x, lambda y: y.cast("double") / n))))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def slope(v: Column) -> Column:
    """OLS slope over positions that run evenly from 0 to 1."""

    def of(x: Column) -> Column:
        k = F.size(x).cast("double")
        mid = (k - 1) / 2
        top = F.aggregate(F.zip_with(x, F.sequence(F.lit(0), F.size(x) - 1), lambda y, i: y * (i - mid)), F.lit(0.0), lambda a, y: a + y)
        return (k - 1) * top / (k * (k * k - 1) / 12.0)

    return F.when(F.size(v) > 1, let(v, of))


def first_argmax(v: Column) -> Column:
    """0-based position of the greatest value, the first of ties."""
    return F.array_position(v, F.array_max(v)) - 1


def first_argmin(v: Column) -> Column:
    return F.array_position(v, F.array_min(v)) - 1


def arc_class(t1: Column, t2: Column, t3: Column) -> Column:
    up1, up2 = t2 >= t1, t3 >= t2
    return F.when(up1 & up2, "rise").when(~up1 & ~up2, "fall").when(up1, "peak").otherwise("trough")


def thirds(v: Column) -> tuple[Column, Column, Column]:
    """Means of the first, middle and last third (k div 3 values at either end, one at least); an empty middle is the whole."""
    k = F.size(v)
    n = F.greatest(F.floor(k / 3).cast("int"), F.lit(1))
    middle = F.when(k - 2 * n > 0, mean(F.slice(v, n + 1, F.greatest(k - 2 * n, F.lit(1))))).otherwise(mean(v))
    return mean(F.slice(v, 1, n)), middle, mean(F.slice(v, k - n + 1, n))


def trajectory(v: Column) -> dict[str, Column]:
    """What a report's series of sentence values amounts to; for series of two values or more."""
    k = F.size(v)
    half = F.floor(k / 2).cast("int")
    t1, t2, t3 = thirds(v)
    return {
        "n_sent": k,
        "drift": F.try_element_at(v, F.lit(-1)) - F.try_element_at(v, F.lit(1)),
        "drift_trim": F.when(k >= 3, F.try_element_at(v, F.lit(-2)) - F.try_element_at(v, F.lit(1))),
        "slope": slope(v),
        "half": mean(F.slice(v, half + 1, k - half)) - mean(F.slice(v, 1, F.greatest(half, F.lit(1)))),
        "third": t3 - t1,
        "level": mean(v),
        "sd": sd(v),
        "argmax": first_argmax(v) / F.greatest(k - 1, F.lit(1)),
        "argmin": first_argmin(v) / F.greatest(k - 1, F.lit(1)),
        "arc": arc_class(t1, t2, t3),
    }


def increment_skew(v: Column, least: float = 1e-12) -> Column:
    """Population skewness of successive differences; NULL for a spread below `least`."""

    def of(x: Column) -> Column:
        d = F.zip_with(F.slice(x, 2, F.size(x) - 1), F.slice(x, 1, F.size(x) - 1), lambda b, a: b - a)
        return let(d, lambda y: let(mean(y), lambda m: let(sd(y), lambda s: F.when(s >= least, F.aggregate(y, F.lit(0.0), lambda a, z: a + (z - m) * (z - m) * (z - m)) / F.size(y) / (s * s * s)))))

    return F.when(F.size(v) > 2, let(v, of))


def resample(v: Column, points: int = 20) -> Column:
    """Linear interpolation at `points` places from the first to the last value."""

    def of(x: Column) -> Column:
        def at(i: Column) -> Column:
            where = i * (F.size(x) - 1) / (points - 1)
            lo = F.least(F.floor(where), F.size(x) - 2).cast("int")
            return let(lo, lambda a: F.get(x, a) + (F.get(x, a + 1) - F.get(x, a)) * (where - a))

        return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)

    return F.when(F.size(v) > 1, let(v, of))


def stage(position: Column, size: Column, stages: int = 6) -> Column:
    return F.floor((position + 0.5) / size * stages).cast("int")


def residual_sd(sd_: Column, slope_: Column, k: Column) -> Column:
    """Spread about a series' own line, from its sample spread and its slope over positions from 0 to 1."""
    k = k.cast("double")
    line = slope_ * slope_ * k * (k + 1) / (12.0 * (k - 1))
    return F.sqrt(F.greatest((k - 1) * sd_ * sd_ - line, F.lit(0.0)) / (k - 2))


def shape_name(v: Column, edge: float = 0.15, middle: float = 0.10) -> Column:
    """A name for a resampled arc from the means of its first three, middle two and last three points."""
    k = F.size(v)
    a, z, m = mean(F.slice(v, 1, 3)), mean(F.slice(v, k - 2, 3)), mean(F.slice(v, F.floor(k / 2).cast("int"), 2))
    # fixed values: the names
    named = F.when(z - a > edge, "rise (rags→riches)").when(a - z > edge, "fall (tragedy)").when((m < a - middle) & (m < z - middle), "U / man-in-a-hole").when((m > a + middle) & (m > z + middle), "∩ / Icarus").otherwise("flat/other")
    return F.when(k >= 4, named)


def order_features(v: Column) -> dict[str, Column]:
    t = trajectory(v)
    return {"slope": t["slope"], "half": t["half"], "ends": t["drift"], "argmax": t["argmax"], "argmin": t["argmin"]}


def closing_step(v: Column) -> dict[str, Column]:
    """The last step against what went before it."""
    k = F.size(v)
    half = F.floor(k / 2).cast("int")
    pre = F.slice(v, 1, k - 1)
    return {
        "step": F.try_element_at(v, F.lit(-1)) - F.try_element_at(v, F.lit(-2)),
        "pre": F.try_element_at(pre, F.lit(-1)) - F.try_element_at(pre, F.lit(1)),
        "drift": F.try_element_at(v, F.lit(-1)) - F.try_element_at(v, F.lit(1)),
        "flatten": slope(F.slice(v, half + 1, k - half)) - slope(F.slice(v, 1, half)),
        "slope": slope(v),
        "v0": F.try_element_at(v, F.lit(1)),
        "sd": sd(v, 1),
        "vbar": mean(v),
        "head": mean(F.slice(v, 1, F.least(k, F.lit(5)))),
        "tail": mean(F.slice(v, F.greatest(k - 4, F.lit(1)), F.least(k, F.lit(5)))),
    }


#: Parts of a series that are kept; `wake` is an array of booleans of the same length.
TRIMS = {
    "full": lambda v, wake: v,
    "no_wake": lambda v, wake: F.filter(F.zip_with(v, wake, lambda x, w: F.when(~w, x)), lambda x: x.isNotNull()),
    "drop_last": lambda v, wake: F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))),
    "drop_last2": lambda v, wake: F.slice(v, 1, F.greatest(F.size(v) - 2, F.lit(0))),
    "interior": lambda v, wake: F.slice(v, 2, F.greatest(F.size(v) - 2, F.lit(0))),
    "not_ending_awake": lambda v, wake: F.when(~F.try_element_at(wake, F.lit(-1)), v),
    "ending_awake": lambda v, wake: F.when(F.try_element_at(wake, F.lit(-1)), v),
}
