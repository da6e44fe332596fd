"""Statistics against permutation, shift and bootstrap nulls, and power by injection.

Replicates are rows or groups: a replicate's seed comes from its number and the group's name, so results don't depend on how rows are
partitioned. What a group holds is a panel's period, an event list or one mean a contributor, never raw reports of a whole corpus.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.arrays import let, mean
from ..sources.shared import saved
from .graph import correlations, scalars
from .panel import weighted_variance
from .permutations import shuffled_sums
from .ranks import cumulated, quantiles
from .vectors import mean_vectors


def stouffer(df: DataFrame, z: str = "z") -> DataFrame:
    """One row: combined z, share above 0, days."""
    return df.where(F.col(z).isNotNull()).agg((F.sum(z) / F.sqrt(F.count("*"))).alias("stouffer_z"), F.avg((F.col(z) > 0).cast("int")).alias("share_positive"), F.count("*").alias("n"))


#: Draws of surrogates that a task makes at once.
DRAW_BLOCK = 100


def beyond_null(df: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """by, observed (draw -1), null_mean, null_q95 and p, one-sided and two-sided about the null's mean, over the draws."""
    g = df.groupBy(*by).agg(F.max(F.when(F.col("draw") < 0, F.col(x))).alias("observed"), F.collect_list(F.when(F.col("draw") >= 0, F.col(x))).alias("_x"))  # a number a draw
    m = F.aggregate("_x", F.lit(0.0), lambda a, v: a + v) / F.size("_x")
    g = g.withColumn("null_mean", m)
    above = F.size(F.filter("_x", lambda v: v >= F.col("observed")))
    far = F.size(F.filter("_x", lambda v: F.abs(v - F.col("null_mean")) >= F.abs(F.col("observed") - F.col("null_mean"))))
    size = F.size("_x") + 1
    return g.select(*by, "observed", "null_mean", F.element_at(F.array_sort("_x"), F.ceil(F.size("_x") * 0.95).cast("int")).alias("null_q95"), ((above + 1) / size).alias("p"), ((far + 1) / size).alias("p_two_sided"), F.size("_x").alias("n_null"))


def distribution_dynamics(df: DataFrame, value: str, period: str, person: str, draws: int = 1000, least: int = 30, tail: float = 0.10) -> DataFrame:
    """Weighted variance across periods of mean, spread and lower-tail rate, against shuffles of each person's values over the person's own reports: statistic, observed, null_mean, null_q95, p."""
    base = df.where(F.col(value).isNotNull())
    cut = quantiles(base, value, [tail]).withColumnRenamed("_q0", "_cut")
    rows = base.crossJoin(F.broadcast(cut))  # one row
    v = F.col(value)
    sums = shuffled_sums(rows, person, period, [v, v * v, (v <= F.col("_cut")).cast("int")], draws).where(F.col("n") >= least)
    mean_ = F.get("s", F.lit(0)) / F.col("n")
    told = {"mean": mean_, "sd": F.sqrt(F.greatest(F.get("s", F.lit(1)) / F.col("n") - mean_ * mean_, F.lit(0.0))), "tail_rate": F.get("s", F.lit(2)) / F.col("n")}
    long_ = sums.select("draw", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("statistic"), c.alias("x")) for k, c in told.items()))).alias("m")).select("draw", "n", "m.*")
    return beyond_null(weighted_variance(long_, "x", "n", ["statistic", "draw"]).withColumnRenamed("wvar", "x"), ["statistic"]).drop("p_two_sided")


def day_effect_null(df: DataFrame, value: str, period: str, person: str, draws: int = 1000, stratum: Column | None = None, block: int = 1) -> DataFrame:
    """F of the periods' means against shuffles of each person's values over the person's own rows (of a stratum, in blocks): observed, null_mean, null_q95, p."""
    sums = shuffled_sums(df.where(F.col(value).isNotNull()), person, period, [F.col(value), F.col(value) * F.col(value)], draws, stratum=stratum, block=block)
    total, square = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    g = sums.groupBy("draw").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(total).alias("t"), F.sum(total * total / F.col("n")).alias("b"), F.sum(square).alias("q"))
    msb = (F.col("b") - F.col("t") * F.col("t") / F.col("n")) / F.greatest(F.col("k") - 1, F.lit(1))
    msw = (F.col("q") - F.col("b")) / F.greatest(F.col("n") - F.col("k"), F.lit(1))
    return beyond_null(g.select("draw", F.when(msw > 0, msb / msw).alias("x")), []).drop("p_two_sided")


def contrast(a: DataFrame, b: DataFrame, value: str, draws: int = 4000) -> DataFrame:
    """Difference of the means of two sets of contributor means, with a bootstrap interval, its ratio and how far the variance may grow before 0 is in reach.

    Each task weighs its rows for every draw by Poisson numbers and gives their sums, so nothing but sums of draws moves.
    """
    both = a.select(F.lit(1).alias("side"), F.col(value).cast("double").alias("v")).unionByName(b.select(F.lit(0).alias("side"), F.col(value).cast("double").alias("v"))).where("v IS NOT NULL")
    # a row's weights come from its hash and its turn among equal rows, which stand for each other
    numbered = both.groupBy("side", "v").agg(F.count("*").alias("k"))

    def weighed(batches):
        import pyarrow as pa

        for batch in batches:
            side, v, k = (np.asarray(batch.column(c)) for c in range(3))
            total = np.zeros((2, 2, draws + 1))
            for s, x, n in zip(side.tolist(), v.tolist(), k.tolist(), strict=True):
                w = np.r_[n, K.rng_of("contrast", s, x).poisson(n, draws)]
                total[s, 0] += w
                total[s, 1] += w * x
            for s in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(draws + 1, s, np.int32)), pa.array(np.arange(draws + 1, dtype=np.int32)), pa.array(total[s, 0]), pa.array(total[s, 1])], names=["side", "draw", "w", "wv"])

    sums = numbered.mapInArrow(weighed, "side int, draw int, w double, wv double").groupBy("draw").pivot("side", [0, 1]).agg(F.sum("w").alias("w"), F.sum("wv").alias("wv"))

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("draw")
        n = pdf[["1_w", "0_w"]].iloc[0].to_numpy(float)
        x, y = (pdf[f"{s}_wv"].to_numpy(float) / np.maximum(pdf[f"{s}_w"].to_numpy(float), 1e-300) for s in (1, 0))
        gap, d = x[0] - y[0], (x - y)[1:]
        lo, hi = np.quantile(d, [0.025, 0.975])
        far = (gap - lo) if gap > 0 else (hi - gap)
        p = 2 * min((1 + (d <= 0).sum()) / (draws + 1), (1 + (d >= 0).sum()) / (draws + 1))
        return pd.DataFrame([{"difference": gap, "lo": lo, "hi": hi, "p": min(1.0, p), "ratio": x[0] / y[0] if y[0] else np.nan, "inflation_to_overturn": (abs(gap) / far) ** 2 if far > 0 else np.nan, "n_a": int(n[0]), "n_b": int(n[1])}])

    # a row for each draw
    return sums.groupBy().applyInPandas(one, "difference double, lo double, hi double, p double, ratio double, inflation_to_overturn double, n_a long, n_b long")


def date_block_permutation(df: DataFrame, value: str, day: str, wanted: tuple[int, int] = (4, 0), draws: int = 500) -> DataFrame:
    """Difference of two weekdays' report means when the labels are dealt anew over dates, whole days at a time: observed, null_sd, p."""
    d = df.where(F.weekday(day).isin(*wanted)).groupBy(day).agg(F.sum(value).alias("s"), F.count(value).alias("n"))

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values(day)
        s, n = pdf["s"].to_numpy(float), pdf["n"].to_numpy(float)
        label = pd.to_datetime(pdf[day]).dt.weekday.to_numpy() == wanted[0]

        def gap(m):
            return s[m].sum() / n[m].sum() - s[~m].sum() / n[~m].sum()

        rng = K.rng_of("weekday", len(pdf))
        null = np.array([gap(rng.permutation(label)) for _ in range(draws)])
        return pd.DataFrame([{"observed": gap(label), "null_sd": null.std(), "p": (1 + (abs(null) >= abs(gap(label))).sum()) / (draws + 1), "n_days": len(pdf)}])

    return d.groupBy().applyInPandas(one, "observed double, null_sd double, p double, n_days long")


FAMILIES = ("ar1", "phase", "garch", "bootstrap", "iaaft")


def _rolling(v: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling sample variance (from half a window on) and lag-1 correlation (from half a window, and six values, on) of each row."""
    v = v - v.mean(1, keepdims=True)
    t = v.shape[1]
    ends = np.arange(1, t + 1)
    lo = np.maximum(ends - window, 0)
    run = lambda x: np.concatenate([np.zeros((len(x), 1)), x.cumsum(1)], 1)
    s, q, p = run(v), run(v * v), run(v[:, 1:] * v[:, :-1])
    n = ends - lo
    sums, squares = s[:, ends] - s[:, lo], q[:, ends] - q[:, lo]
    with np.errstate(invalid="ignore", divide="ignore"):
        var = np.where(n >= max(window // 2, 2), np.maximum(squares - sums**2 / n, 0) / (n - 1), np.nan)
        m = n - 1  # pairs: rows lo .. end - 2 with lo + 1 .. end - 1
        first = s[:, ends - 1] - s[:, lo]
        second = s[:, ends] - s[:, np.minimum(lo + 1, t)]
        both = p[:, ends - 1] - p[:, lo]
        a = q[:, ends - 1] - q[:, lo] - first**2 / m
        b = q[:, ends] - q[:, np.minimum(lo + 1, t)] - second**2 / m
        ar1 = np.where(n >= max(6, window // 2), (both - first * second / m) / np.sqrt(a * b), np.nan)
    return var, ar1


def _run_ups(v: np.ndarray, window: int, runup: int) -> list[tuple[list[np.ndarray], list[int]]]:
    """For each row of v, Kendall's tau of rolling variance and lag-1 correlation over the run-up to each top-decile excursion; and the
    excursions' places."""
    indicators = _rolling(v, window)
    t = v.shape[1]
    run = np.concatenate([np.zeros((len(v), 1)), v.cumsum(1)], 1)
    at = np.arange(13, t - 14)  # the next 14 rows less the last 7, from the fourteenth row on
    ahead = np.full(v.shape, np.nan)
    if len(at):
        ahead[:, at] = (run[:, at + 15] - run[:, at + 1]) / 14 - (run[:, at + 1] - run[:, at - 6]) / 7
    with np.errstate(invalid="ignore"):
        top = ahead >= np.nanquantile(ahead, 0.90, axis=1, keepdims=True) if len(at) else np.zeros(v.shape, bool)
    places, owner, kept = [], [], []
    for k, row in enumerate(top):
        found, where = [], np.flatnonzero(row)
        while len(where):
            found.append(int(where[0]))
            where = where[np.searchsorted(where, where[0] + runup) :]
        kept.append(found)
        places += found
        owner += [k] * len(found)
    owner, places = np.array(owner, int), np.array(places, int)
    i, j = np.triu_indices(runup, 1)
    taus = []
    for ind in indicators:
        tau = np.full(len(places), np.nan)
        whole = np.flatnonzero(places >= runup)
        seg = ind[owner[whole][:, None], places[whole][:, None] - runup + np.arange(runup)]
        full = np.isfinite(seg).all(1)
        for lo in range(0, len(seg), 2048):
            x = seg[lo : lo + 2048]
            sign = np.sign(x[:, j] - x[:, i])
            with np.errstate(invalid="ignore", divide="ignore"):
                tau[whole[lo : lo + 2048]] = sign.sum(1) / np.sqrt(len(i) * np.abs(sign).sum(1))
        rest = np.r_[np.flatnonzero(places < runup), whole[~full]]
        for r in rest:
            x = ind[owner[r], max(0, places[r] - runup) : places[r]]
            x = x[np.isfinite(x)]
            tau[r] = K.kendall_b(np.arange(len(x)), x) if len(x) >= 10 else np.nan
        taus.append(tau)
    cuts = np.r_[0, np.cumsum([len(f) for f in kept])]
    return [([tau[cuts[k] : cuts[k + 1]] for tau in taus], kept[k]) for k in range(len(v))]


def _mean(x: np.ndarray) -> float:
    known = x[np.isfinite(x)]
    return float(known.mean()) if len(known) else np.nan


def warning_draws(series: DataFrame, value: str, order: str = "day", window: int = 28, runup: int = 42, families: tuple[str, ...] = FAMILIES, draws: int = 1000) -> DataFrame:
    """family, indicator, draw (-1 as observed), tau, episodes: the mean Kendall tau of rolling variance and lag-1 correlation over the run-up to a
    series' own top-decile excursions, of the series and of its surrogates put through the same steps.

    A group holds the daily series and a block of draws of one family, so draws spread over tasks.
    """

    def one(ids, pdf):
        import pandas as pd

        x = pdf.sort_values(order)[value].to_numpy(float)
        family, block = ids
        made = K.surrogates(family, x, K.rng_of(family, block), min(DRAW_BLOCK, draws - block * DRAW_BLOCK))
        first = -1 if not block else 0
        every = np.r_[x[None], made] if not block else made
        rows = [(family, name, block * DRAW_BLOCK + k if k >= 0 else -1, _mean(t), len(kept)) for k, (taus, kept) in enumerate(_run_ups(every, window, runup), first) for name, t in zip(("variance", "ar1"), taus, strict=True)]
        return pd.DataFrame(rows, columns=["family", "indicator", "draw", "tau", "episodes"])

    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-draws // DRAW_BLOCK) - 1))).alias("block")
    rows = series.select(order, value, F.explode(F.array(*map(F.lit, families))).alias("family")).select("*", blocks)
    return saved(rows.groupBy("family", "block").applyInPandas(one, "family string, indicator string, draw int, tau double, episodes int"), "warning-draws")


def warning_pipeline(draws: DataFrame) -> DataFrame:
    """family, indicator, tau, null_mean, null_q95, p (one-sided), draws, episodes: warning_draws' rows, summed up."""
    told = beyond_null(draws.where(~F.isnan("tau")).withColumnRenamed("tau", "x"), ["family", "indicator"])
    seen = draws.where("draw < 0").select("family", "indicator", "episodes")
    return told.join(F.broadcast(seen), ["family", "indicator"]).select("family", "indicator", F.col("observed").alias("tau"), "null_mean", "null_q95", "p", F.col("n_null").alias("draws"), "episodes")


def episode_jackknife(series: DataFrame, draws: DataFrame, value: str, order: str = "day", window: int = 28, runup: int = 42) -> DataFrame:
    """family, indicator, episode (its day), tau (its own), tau_without (the mean of the others), p_without: each episode left out, against
    every family's surrogates. Means without an episode come from the episodes' sum; a group holds one daily series."""
    kind = series.schema[order].dataType.simpleString()

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        taus, kept = _run_ups(pdf[value].to_numpy(float)[None], window, runup)[0]
        days = pdf[order].to_numpy()[kept]
        out = []
        for name, t in zip(("variance", "ar1"), taus, strict=True):
            known = np.isfinite(t)
            for k in np.flatnonzero(known):
                n = int(known.sum()) - 1
                out.append((name, days[k], t[k], (t[known].sum() - t[k]) / n if n else np.nan))
        return pd.DataFrame(out, columns=["indicator", "episode", "tau", "tau_without"])

    episodes = series.select(order, value).groupBy().applyInPandas(one, f"indicator string, episode {kind}, tau double, tau_without double")
    null = draws.where((F.col("draw") >= 0) & ~F.isnan("tau")).groupBy("family", "indicator").agg(F.collect_list("tau").alias("_x"))  # a number a draw
    beyond = F.size(F.filter("_x", lambda v: v >= F.col("tau_without")))
    return episodes.join(F.broadcast(null), "indicator").select("family", "indicator", "episode", "tau", "tau_without", ((beyond + 1) / (F.size("_x") + 1)).alias("p_without"))


def arc_modes(arcs: DataFrame, arc: str, size: int, top: int = 3) -> DataFrame:
    """Principal shapes of level-free arcs with their share of variance: mode, share, shape. The covariance is formed where the rows are."""
    from .vectors import covariance, matrix_of

    flat = arcs.select(let(F.col(arc), lambda v: let(mean(v), lambda m: F.transform(v, lambda x: x - m))).alias("a"))
    lam, v = np.linalg.eigh(matrix_of(covariance(flat, "a", size).collect(), size))
    order = np.argsort(lam)[::-1][:top]
    rows = []
    for k, i in enumerate(order):
        shape = v[:, i] * (1 if v[:, i] @ (np.arange(size) - (size - 1) / 2) >= 0 else -1)
        rows.append((k + 1, float(lam[i] / lam.sum()), [float(x) for x in shape]))
    return arcs.sparkSession.createDataFrame(rows, "mode int, share double, shape array<double>")


def heaps(tokens: DataFrame, order: list[str], token: str = "token", points: int = 20) -> DataFrame:
    """Growth of vocabulary over a stated order of documents: exponent of distinct tokens against tokens. tokens: order columns, token, freq."""
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)  # the least of one column is found by hashing, that of a struct by sorting
    first = tokens.groupBy(token).agg(F.min(place).alias("o"))
    new = first.groupBy("o").agg(F.count("*").alias("new"))
    size = tokens.groupBy(place.alias("o")).agg(F.sum("freq").alias("n"))
    named = [F.col("o").alias(order[0])] if len(order) == 1 else ["o.*"]
    both = size.join(new, "o", "left").select(*named, "n", F.coalesce("new", F.lit(0)).alias("new"))
    before = cumulated(both, order, {"_n": "n", "_v": "new"})
    run = before.select((F.col("_n") + F.col("n")).alias("n"), (F.col("_v") + F.col("new")).alias("v"))
    return run.where("n >= 100").agg(F.regr_slope(F.log("v"), F.log("n")).alias("exponent"), F.count("*").alias("documents"))


def lognormal(df: DataFrame, size: str, by: list[str] | None = None) -> DataFrame:
    """by, mu and sigma (mean and population spread of the logarithm), skewness of the logarithm (0 for a log-normal size), median, mean, n:
    of sizes above 0."""
    known = df.where(F.col(size) > 0).withColumn("_l", F.log(F.col(size).cast("double")))
    middle = quantiles(known.withColumn("_s", F.col(size)), "_s", [0.5], by).withColumnRenamed("_q0", "median")
    g = known.groupBy(*(by or [])).agg(F.avg("_l").alias("mu"), F.stddev_pop("_l").alias("sigma"), F.skewness("_l").alias("skewness"), F.avg(size).alias("mean"), F.count("*").alias("n"))
    return g.join(middle, by) if by else g.crossJoin(F.broadcast(middle))  # one row each


def taylor(counts: DataFrame, item: str, n: str) -> DataFrame:
    """Exponent of the variance of an item's counts over periods against their mean."""
    g = counts.groupBy(item).agg(F.avg(n).alias("m"), F.var_samp(n).alias("v"), F.count("*").alias("k")).where("k >= 5 AND m > 0 AND v > 0")
    return g.agg(F.regr_slope(F.log("v"), F.log("m")).alias("exponent"), F.count("*").alias("items"))


def expanding(df: DataFrame, vector: str, period: str, key: str, per_period: int, repeats: int = 5) -> DataFrame:
    """Dispersion about the mean vector by period at the same number of rows, averaged over hashed samples: period, dispersion; and its slope by slope_over_shifts."""
    from ..functions.arrays import cosine

    d = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    turn = F.row_number().over(Window.partitionBy(period, "rep").orderBy(F.xxhash64("rep", key)))
    s = d.withColumn("_n", turn).withColumn("_m", F.count("*").over(Window.partitionBy(period, "rep"))).where((F.col("_n") <= per_period) & (F.col("_m") >= per_period))
    m = mean_vectors(s, vector, [period, "rep"])
    each = s.join(m, [period, "rep"]).groupBy(period, "rep").agg((1 - F.avg(cosine(F.col(vector), F.col("mean")))).alias("x"))
    return each.groupBy(period).agg(F.avg("x").alias("dispersion"))


def slope_over_shifts(series: DataFrame, value: str, order: str) -> DataFrame:
    """Slope of a series over its positions and the share of its circular shifts with a slope as steep: slope, p, n."""
    w = Window.orderBy(order)
    s = series.select((F.row_number().over(w) - 1).alias("t"), F.col(value).alias("v"), F.count("*").over(Window.partitionBy()).alias("n"))
    moved = s.withColumn("shift", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")))).withColumn("t", F.pmod(F.col("t") + F.col("shift"), F.col("n")))
    g = moved.groupBy("shift").agg(F.regr_slope("v", "t").alias("b"))
    seen = g.where("shift = 0").select(F.col("b").alias("slope"))
    return g.crossJoin(F.broadcast(seen)).groupBy("slope").agg(F.avg((F.abs("b") >= F.abs("slope") - 1e-12).cast("int")).alias("p"), F.count("*").alias("n"))


def rolling_network(df: DataFrame, columns: list[str], day: str, person: str, width: int = 91, step: int = 7, least_rows: int = 150, least_people: int = 5) -> DataFrame:
    """Network scalars of rank correlations in windows of `width` days every `step` days, where enough rows and people fall in: start, n, people and scalars."""
    span = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    grid = span.select(F.explode(F.expr(f"sequence(lo, greatest(lo, date_sub(hi, {width - 1})), INTERVAL {step} DAY)")).alias("start"))
    # a row falls into the windows that start at most width - 1 days before it: found by equality on days, not by a range loop
    days = grid.select("start", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("o")).select("start", F.date_add("start", F.col("o")).alias(day))
    rows = df.dropna(subset=columns).join(F.broadcast(days), day).select("start", person, *columns)
    counted = rows.groupBy("start").agg(F.count("*").alias("n"), F.count_distinct(person).alias("people")).where((F.col("n") >= least_rows) & (F.col("people") >= least_people))
    held = rows.join(counted.select("start"), "start", "left_semi")
    return counted.join(scalars(correlations(held, columns, ["start"]), ["start"]).drop("n"), "start")


def injected_power(series: DataFrame, events: DataFrame, value: str, deltas: list[float], day: str = "day", pre: int = 7, post: int = 7, rotations: int = 200, z: float = 1.96) -> DataFrame:
    """Power by injection: the series is turned against the calendar, each delta is added in the days after every event, and the event
    study is run anew on each turned series; found is what lies z spreads of the untouched turned series' effects from 0: delta, power, null_sd.

    One group holds the daily series; the turns, spread evenly over its length, are rows of one matrix.
    """
    days = series.select(day, value).where(F.col(value).isNotNull())
    marked = days.join(events.select(F.col(day), F.lit(1).alias("event")).distinct(), day, "left").na.fill(0, ["event"])

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values(day)
        v, at = pdf[value].to_numpy(float), np.flatnonzero(pdf["event"].to_numpy())
        n = len(v)
        at = at[(at >= pre) & (at + post <= n)]
        if not len(at):
            return pd.DataFrame(columns=["delta", "power", "null_sd"])
        turns = np.unique(np.linspace(0, n, min(rotations, n), endpoint=False).astype(int))
        turned = v[(np.arange(n)[None] + turns[:, None]) % n]
        after = np.zeros(n, bool)
        for e in at:
            after[e : e + post] = True

        def effects(x):
            c = np.c_[np.zeros(len(x)), x.cumsum(1)]
            return ((c[:, at + post] - c[:, at]) / post - (c[:, at] - c[:, at - pre]) / pre).mean(1)

        sd = effects(turned).std(ddof=1)
        return pd.DataFrame([{"delta": d, "power": float((np.abs(effects(turned + d * after)) > z * sd).mean()), "null_sd": sd} for d in deltas])

    return marked.groupBy().applyInPandas(one, "delta double, power double, null_sd double")


def neighbour_overlap(panel: DataFrame, person: str, period: str, columns: list[str], k: int = 5, lag: int = 1, draws: int = 0, step: int = 512) -> DataFrame:
    """For periods `lag` apart in the list: how much of a person's k nearest (cosine of standardised columns) stay, among those in both; with draws also against relabelled people.

    One group holds two periods' panel, a row a person. With two columns a person is a direction in a plane, so the nearest are found
    beside it in the order of angles; with more, every two people meet, `step` at a time. Pairs with k + 1 people in common or fewer are
    left out.
    """
    order = panel.select(period).distinct().withColumn("_i", F.row_number().over(Window.orderBy(period)))  # a row a period
    rows = panel.select(person, period, *columns).dropna().join(order, period).withColumn("pair", F.explode(F.array(F.col("_i"), F.col("_i") - lag)))
    columns_out = ["pair", "n_common", "overlap", "chance", "edge_jaccard", "null_mean", "p"]

    def nearest(x: np.ndarray) -> np.ndarray:
        """The k nearest of each row, by place."""
        x = (x - x.mean(0)) / (x.std(0) + 1e-9)
        if x.shape[1] == 2:
            return K.nearest_directions(x, k)
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
        near = np.empty((len(x), min(k, len(x) - 1)), np.int64)
        for lo in range(0, len(x), step):
            sim = x[lo : lo + step] @ x.T
            sim[np.arange(len(sim)), lo + np.arange(len(sim))] = -np.inf
            near[lo : lo + step] = np.argsort(-sim, axis=1, kind="stable")[:, : near.shape[1]]
        return near

    def one(ids, pdf):
        import pandas as pd

        a, b = (pdf[pdf["_i"] == ids[0] + s].drop_duplicates(person).set_index(person)[columns] for s in (0, lag))
        common = sorted(set(a.index) & set(b.index))
        if len(common) <= k + 1:
            return pd.DataFrame(columns=columns_out)
        n = len(common)
        first, second = (nearest(m.loc[common].to_numpy(float)) for m in (a, b))
        columns_of = [np.ascontiguousarray(c, np.int32) for c in first.T]
        both = lambda q: sum(int(np.count_nonzero(c == d)) for d in np.ascontiguousarray(q.T) for c in columns_of)
        second = second.astype(np.int32)
        seen, rng, null, back = both(second), K.rng_of("identity", ids[0], n), [], np.empty(n, np.int32)
        for _ in range(draws):
            o = rng.permutation(n)
            back[o] = np.arange(n, dtype=np.int32)
            null.append(both(back[second[o]]))
        size = first.size
        return pd.DataFrame([(ids[0], n, seen / size, k / (n - 1), seen / (2 * size - seen), float(np.mean(null)) / size if null else np.nan, (1 + sum(v >= seen for v in null)) / (draws + 1) if null else np.nan)], columns=columns_out)

    return rows.groupBy("pair").applyInPandas(one, "pair int, n_common long, overlap double, chance double, edge_jaccard double, null_mean double, p double")


def chronology(panel: DataFrame, person: str, period: str, vector: str, size: int, draws: int = 500) -> DataFrame:
    """Pair-weighted mean cosine within periods of people's unit vectors, against vectors dealt anew over each person's own periods: observed, null_mean, p (two-sided)."""
    sums = shuffled_sums(panel, person, period, [F.get(vector, F.lit(k)) for k in range(size)], draws, "chronology").where("n > 1")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    square = F.aggregate("s", F.lit(0.0), lambda a, v: a + v * v)
    o = sums.groupBy("draw").agg((F.sum((square - F.col("n")) / 2) / F.sum(pairs)).alias("x"))
    return beyond_null(o, []).select("observed", "null_mean", F.col("p_two_sided").alias("p"), "n_null")
