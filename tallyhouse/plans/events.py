"""Queries on event studies, matched controls, windows and coupling of series."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import coupling as C
from ..operators import events as E
from ..operators import joins as J
from ..operators import windows as W
from ..sources.tables import daily_orders, read, six, weekly_orders
from .panel import ELIGIBLE, ORDERS, text
from .registry import query

#: Event days: those of the most orders, thinned to four weeks.
SPACED = ORDERS + """, tp AS (SELECT list(day - DATE '1970-01-01' ORDER BY day) AS p FROM d WHERE n >= (SELECT quantile_cont(n, 0.95) FROM d)),
  ev AS (SELECT (DATE '1970-01-01' + unnest(list_reduce(list_transform(p, lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[-1] >= 28 THEN list_concat(a, b) ELSE a END))::INT) AS day FROM tp)"""
WEEKS = "WITH w AS (SELECT date_trunc('week', o_orderdate)::DATE AS week, avg(o_totalprice) AS y, avg(substr(o_orderpriority, 1, 1)::INT) AS x, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT *, row_number() OVER (ORDER BY week) AS t FROM w)"


def events(spark, sf):
    d = daily_orders(spark, sf)
    cut = d.agg(F.percentile("n", F.lit(0.95)).alias("cut"))
    return W.space_events(d.crossJoin(F.broadcast(cut)).where("n >= cut"))


def pairs(spark, sf):
    w = weekly_orders(spark, sf)
    return J.aligned(w.select("week", "y"), w.select("week", "x"))


@query(SPACED + " SELECT ev.day::VARCHAR AS event, d.day::VARCHAR AS day, (d.day - ev.day)::INT AS offset, round(d.v, 6) AS v FROM ev JOIN d ON d.day BETWEEN ev.day - 3 AND ev.day + 7")
def event_window_join(spark, sf):
    j = J.near_days(events(spark, sf), -3, 7).join(daily_orders(spark, sf), "day")
    return j.select(text("event"), text("day"), "offset", six("v").alias("v"))


@query(SPACED + " SELECT d.day::VARCHAR AS day FROM d WHERE NOT EXISTS (SELECT 1 FROM ev WHERE abs(d.day - ev.day) <= 10)")
def outside_event_buffer(spark, sf):
    return J.outside_buffer(daily_orders(spark, sf), events(spark, sf), 10).select(text("day"))


@query(ELIGIBLE + SPACED.removeprefix(ORDERS) + """, c AS (SELECT e.day AS event, p.day AS control, row_number() OVER (PARTITION BY e.day ORDER BY ((p.day - DATE '1970-01-01') * 2654435761 + (e.day - DATE '1970-01-01') * 40503 + 7) % 4294967296, p.day) AS rk
  FROM el e JOIN ev USING (day) JOIN el p ON p.weekday = e.weekday AND p.month = e.month AND p.tercile = e.tercile WHERE NOT EXISTS (SELECT 1 FROM ev x WHERE abs(p.day - x.day) <= 10))
  SELECT event::VARCHAR AS event, control::VARCHAR AS control FROM c WHERE rk <= 5""")
def matched_controls(spark, sf):
    pool = W.eligible_days(daily_orders(spark, sf), "n", least=5)
    return J.matched_controls(pool, events(spark, sf), seed=7).select(text("event"), text("control"))


@query(SPACED + " SELECT d.day::VARCHAR AS day, (EXISTS (SELECT 1 FROM ev WHERE d.day BETWEEN ev.day - 7 AND ev.day - 1))::INT AS before, (EXISTS (SELECT 1 FROM ev WHERE d.day BETWEEN ev.day AND ev.day + 6))::INT AS after FROM d")
def event_locked_masks(spark, sf):
    m = J.window_mask(daily_orders(spark, sf), events(spark, sf), {"before": (-7, -1), "after": (0, 6)})
    return m.select(text("day"), "before", "after")


@query(ORDERS + " SELECT a.day::VARCHAR AS day, count(*) AS others FROM d a JOIN d b ON a.day <> b.day AND abs(a.day - b.day) <= 56 AND isodow(a.day) = isodow(b.day) GROUP BY 1")
def same_weekday_neighbourhood(spark, sf):
    return J.neighbourhood(daily_orders(spark, sf)).groupBy("day").agg(F.count("*").alias("others")).select(text("day"), "others")


@query(SPACED + """, b AS (SELECT min(day) AS b FROM d WHERE n >= 5), el AS (SELECT day, v FROM d WHERE n >= 5), x AS (SELECT ev.day AS event, (SELECT avg(v) FROM el WHERE el.day BETWEEN ev.day + 1 AND ev.day + 7) AS post, (SELECT avg(v) FROM el WHERE el.day BETWEEN ev.day - 21 AND ev.day - 4) AS pre FROM ev JOIN el USING (day))
  SELECT event::VARCHAR AS event, round(post, 2) AS post, round(pre, 2) AS pre, round(post - pre, 2) AS effect FROM x""")
def event_effects(spark, sf):
    e = E.event_effects(daily_orders(spark, sf), events(spark, sf), "v", least=5)
    return e.select(text("event"), *(F.round(c, 2).alias(c) for c in ("post", "pre", "effect")))


@query()
def event_study(spark, sf):
    return E.event_study(daily_orders(spark, sf), events(spark, sf), "v", least=5)


@query()
def event_battery(spark, sf):
    """Two outcomes, one of them a negative control, with FDR over the others."""
    from ..functions.stats import benjamini_hochberg

    d, ev = daily_orders(spark, sf).withColumn("control", F.weekday("day").cast("double")), events(spark, sf)
    runs = [E.event_study(d, ev, o, least=5, permutations=2000, seed=k).withColumns({"outcome": F.lit(o), "negative_control": F.lit(o == "control")}) for k, o in enumerate(("v", "n", "control"))]
    both = runs[0].unionByName(runs[1]).unionByName(runs[2])
    return benjamini_hochberg(both.withColumn("tested", F.when(~F.col("negative_control"), F.col("p"))), "tested").drop("tested")


@query(SPACED + """, j AS (SELECT ev.day AS event, (d.day - ev.day)::INT AS "offset", d.v AS v FROM ev JOIN d ON d.day BETWEEN ev.day - 21 AND ev.day + 21), c AS (SELECT *, v - avg(v) FILTER ("offset" BETWEEN -21 AND -4) OVER (PARTITION BY event) AS x FROM j)
  SELECT "offset", round(avg(x), 4) AS mean, round(stddev_samp(x) / sqrt(count(*)), 4) AS sem, count(*) AS n FROM c WHERE x IS NOT NULL GROUP BY 1""")
def event_aligned_curve(spark, sf):
    c = E.aligned_curve(daily_orders(spark, sf), events(spark, sf), "v")
    return c.select("offset", F.round("mean", 4).alias("mean"), F.round("sem", 4).alias("sem"), "n")


TOP = ORDERS + ", top AS (SELECT day, n >= (SELECT quantile_cont(n, 0.9) FROM d) AS top FROM d)"


@query(TOP + """, e AS (SELECT day FROM top WHERE top), s AS (SELECT count(*) AS k, max(day) - min(day) + 1 AS span FROM e), l AS (SELECT unnest(range(1, 15))::INT AS lag), f AS (SELECT lag, count(b.day) AS pairs FROM l CROSS JOIN e a LEFT JOIN e b ON b.day = a.day + lag GROUP BY 1)
  SELECT lag, pairs, round(pairs / (k * (k - 1) / 2 * 2 * (span - lag) / (span * (span - 1))), 6) AS g FROM f, s""")
def event_pair_correlation(spark, sf):
    d = daily_orders(spark, sf)
    cut = d.agg(F.percentile("n", F.lit(0.9)).alias("cut"))
    return E.pair_correlation(d.crossJoin(F.broadcast(cut)).where("n >= cut")).select("lag", "pairs", six("g").alias("g"))


@query(TOP + """, a AS (SELECT avg(b.top::INT) AS post_rate FROM top a CROSS JOIN (SELECT unnest([1, 2, 3]) AS o) JOIN top b ON b.day = a.day + o::INT WHERE a.top) SELECT count(*) FILTER (top) AS n_spikes, round(any_value(post_rate), 6) AS post_rate, round(avg(top::INT), 6) AS base_rate, round(any_value(post_rate) / avg(top::INT), 6) AS ratio FROM top, a""")
def branching_ratio(spark, sf):
    b = E.branching(daily_orders(spark, sf), "n")
    return b.select("n_spikes", *(six(c).alias(c) for c in ("post_rate", "base_rate", "ratio")))


@query(TOP + """, x AS (SELECT (day - (SELECT min(day) FROM d))::INT AS at, top::INT AS top, ((SELECT max(day) - min(day) FROM d) + 1)::INT AS span FROM top), s AS (SELECT unnest(range(0, (SELECT any_value(span) FROM x), 28))::INT AS shift)
  SELECT shift, round(avg(b.top) / (SELECT avg(top) FROM x), 6) AS ratio FROM s CROSS JOIN x a CROSS JOIN (SELECT unnest([1, 2, 3])::INT AS o) JOIN x b ON b.at = (a.at + o + shift) % a.span WHERE a.top = 1 GROUP BY 1""")
def displaced_branching_null(spark, sf):
    return E.displaced_branching(daily_orders(spark, sf), "n", 28).select("shift", six("ratio").alias("ratio"))


@query(SPACED + " SELECT day::VARCHAR AS day FROM d WHERE NOT EXISTS (SELECT 1 FROM ev WHERE abs(d.day - ev.day) < 12) ORDER BY ((day - DATE '1970-01-01') * 2654435761 + 3) % 4294967296, day LIMIT 10")
def placebo_anchors(spark, sf):
    return E.placebo_days(daily_orders(spark, sf), events(spark, sf), 10, 12, 3).select(text("day"))


@query(WEEKS + ", l AS (SELECT unnest(range(-8, 9))::INT AS lag) SELECT lag, round(corr(a.y, b.x), 6) AS r, count(*) AS n FROM l JOIN s a ON true JOIN s b ON b.t = a.t - lag GROUP BY 1")
def lagged_correlation(spark, sf):
    return J.lagged(pairs(spark, sf)).select("lag", six("r").alias("r"), "n")


NULL = ", z AS (SELECT t - 1 AS i, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS zx, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS zy, count(*) OVER () AS n FROM s), h AS (SELECT sh AS shift, sum(a.zx * b.zy) / any_value(a.n) AS r FROM z a CROSS JOIN (SELECT unnest(range(0, (SELECT count(*) FROM s))) AS sh) JOIN z b ON b.i = (a.i + sh) % a.n GROUP BY 1)"


@query(WEEKS + NULL + " SELECT round((SELECT r FROM h WHERE shift = 0), 6) AS r, round(avg((abs(r) >= abs((SELECT r FROM h WHERE shift = 0)) - 1e-12)::INT), 6) AS p, count(*) AS n FROM h")
def exact_shift_p(spark, sf):
    return C.shift_p(C.shift_null(pairs(spark, sf))).select(six("r").alias("r"), six("p").alias("p"), "n")


@query(WEEKS + """, l AS (SELECT unnest(range(-8, 9))::INT AS lag) SELECT 'all' AS series, lag, round(corr(a.y, b.x), 6) AS r, count(*) AS n FROM l JOIN s a ON true JOIN s b ON b.t = a.t - lag GROUP BY lag""")
def lag_scan(spark, sf):
    return C.lag_scan(pairs(spark, sf).withColumn("series", F.lit("all")), ["series"]).select("series", "lag", six("r").alias("r"), "n")


@query(WEEKS + """, g AS (SELECT unnest(range(-8, 9))::INT AS lag), j AS (SELECT lag, a.t, a.y, b.x, row_number() OVER (PARTITION BY lag ORDER BY a.t) - 1 AS i, count(*) OVER (PARTITION BY lag) AS n FROM g JOIN s a ON true JOIN s b ON b.t = a.t - lag),
  h AS (SELECT a.lag, a.n, k.k, corr(a.y, b.x) AS r FROM j a JOIN (SELECT lag, unnest(range(n)) AS k FROM (SELECT DISTINCT lag, n FROM j)) k ON k.lag = a.lag JOIN j b ON b.lag = a.lag AND b.i = (a.i + k.k) % a.n GROUP BY 1, 2, 3), o AS (SELECT lag, r FROM h WHERE k = 0),
  p AS (SELECT h.lag, o.r, avg((abs(h.r) >= abs(o.r) - 1e-9)::INT) AS p, max(h.n) AS n FROM h JOIN o USING (lag) GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS m FROM p) SELECT 'all' AS series, lag, round(r, 6) AS r, round(p, 6) AS p, n, round(least(1, min(p * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM m""")
def lag_scan_with_q(spark, sf):
    s = C.lag_scan(pairs(spark, sf).withColumn("series", F.lit("all")), ["series"])
    return s.select("series", "lag", *(six(c).alias(c) for c in ("r", "p", "q")), "n")


@query()
def level_and_difference_coupling(spark, sf):
    return C.level_and_difference(pairs(spark, sf))


@query(WEEKS + ", m AS (SELECT a.t AS i, b.t AS j, abs(a.x - b.x) AS a, abs(a.y - b.y) AS b FROM s a, s b), c AS (SELECT a - avg(a) OVER (PARTITION BY i) - avg(a) OVER (PARTITION BY j) + avg(a) OVER () AS a, b - avg(b) OVER (PARTITION BY i) - avg(b) OVER (PARTITION BY j) + avg(b) OVER () AS b FROM m) SELECT round(sqrt(greatest(avg(a * b), 0) / sqrt(avg(a * a) * avg(b * b))), 6) AS dcor, sqrt(count(*))::BIGINT AS n FROM c")
def distance_correlation(spark, sf):
    return C.distance_correlation(pairs(spark, sf)).select(six("dcor").alias("dcor"), "n")


@query(WEEKS + ", g AS (SELECT year(week)::INT AS yr, t, y FROM s), p AS (SELECT a.yr, sign(b.y - a.y) AS s, a.y <> b.y AS u FROM g a JOIN g b ON a.yr = b.yr AND a.t < b.t) SELECT yr, round(sum(s) / sqrt(count(*) * count(*) FILTER (u)), 6) AS tau FROM p GROUP BY 1")
def kendall_by_year(spark, sf):
    return C.kendall(pairs(spark, sf).withColumn("yr", F.year("week")), "t", "y", ["yr"]).select("yr", six("tau").alias("tau"))


@query(ORDERS + ", l AS (SELECT v / 1000 AS a, lag(v / 1000) OVER (ORDER BY day) AS b FROM d) SELECT round(corr(a, b), 6) AS raw, round(corr(abs(a), abs(b)), 6) AS absolute, round(corr(a * a, b * b), 6) AS squared FROM l WHERE b IS NOT NULL")
def volatility_diagnostic(spark, sf):
    v = C.volatility(daily_orders(spark, sf).withColumn("w", F.col("v") / 1000), "w")
    return v.select(*(six(c).alias(c) for c in v.columns))


@query(WEEKS + ", c AS (SELECT row_number() OVER (ORDER BY t) AS k, sum(y / 1000) OVER (ORDER BY t) AS l, sum(y / 1000) OVER () AS s, count(*) OVER () AS n FROM s) SELECT k AS pos, round(l * l / k + (s - l) ** 2 / (n - k) - s * s / n, 4) AS gain FROM c WHERE k BETWEEN 4 AND n - 4 ORDER BY gain DESC, pos LIMIT 1")
def best_mean_shift(spark, sf):
    p = pairs(spark, sf).withColumn("w", F.col("y") / 1000)
    return C.best_split(p, "w").select("pos", F.round("gain", 4).alias("gain"))


@query(WEEKS + ", g AS (SELECT year(week) AS seg, count(*) AS n, avg(y) AS m, min(t) AS o FROM s GROUP BY 1), q AS (SELECT *, abs(m - lag(m) OVER (ORDER BY o)) AS shift FROM g) SELECT count(*) - 1 AS k_changepoints, sum(n)::BIGINT AS n, round(sum(n * (m - (SELECT avg(y) FROM s)) ** 2) / (SELECT var_pop(y) * count(*) FROM s), 6) AS between_share, round(avg(shift), 4) AS mean_abs_shift, round(max(shift), 4) AS max_abs_shift, quantile_cont(n, 0.5)::DOUBLE AS median_dwell, min(n) AS min_dwell FROM q")
def regime_summary(spark, sf):
    r = C.regime_summary(pairs(spark, sf).withColumn("seg", F.year("week")), "y", "seg", "t")
    return r.select("k_changepoints", "n", six("between_share").alias("between_share"), F.round("mean_abs_shift", 4).alias("mean_abs_shift"), F.round("max_abs_shift", 4).alias("max_abs_shift"), "median_dwell", "min_dwell")


def by_series(spark, sf):
    """Weekly series of each order status, numbered: series, t, y, x."""
    o = read(spark, sf, "orders")
    w = o.groupBy(F.col("o_orderstatus").alias("series"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.avg("o_totalprice").alias("y"), F.avg(F.substring("o_orderpriority", 1, 1).cast("int")).alias("x"))
    return w


def per_series(spark, sf, fn, schema: str):
    """fn(series name, y, x) of each weekly series, a group of some hundred rows each."""

    def one(ids, pdf):
        pdf = pdf.sort_values("week")
        out = pd.DataFrame(fn(ids[0], pdf["y"].to_numpy(float), pdf["x"].to_numpy(float)))
        out.insert(0, "series", ids[0])
        return out

    return by_series(spark, sf).groupBy("series").applyInPandas(one, "series string, " + schema)


@query()
def stationarity(spark, sf):
    def fn(_, y, x):
        t, p, lags = K.adf(y)
        s, q = K.kpss(y)
        verdict = "stationary" if p < 0.05 <= q else "nonstationary" if p >= 0.05 > q else "ambiguous"
        return [{"adf": t, "adf_p": p, "lags": lags, "kpss": s, "kpss_p": q, "verdict": verdict}]

    return per_series(spark, sf, fn, "adf double, adf_p double, lags int, kpss double, kpss_p double, verdict string")


@query()
def toda_yamamoto(spark, sf):
    return per_series(spark, sf, lambda _, y, x: [{"direction": d, **K.toda_yamamoto(a, b)} for d, a, b in (("x to y", y, x), ("y to x", x, y))], "direction string, p_lags int, chi2 double, pvalue double, n long")


@query()
def prewhitened_lags(spark, sf):
    return per_series(spark, sf, lambda _, y, x: K.prewhitened_ccf(x, y), "lag int, r double")


@query()
def interrupted_series(spark, sf):
    """A cut in the middle, and placebo cuts every tenth week."""

    def fn(_, y, x):
        mid = len(y) // 2
        return [{"cut": c, "placebo": c != mid, **K.interrupted(y, c)} for c in sorted({mid, *range(20, len(y) - 20, 10)})]

    return per_series(spark, sf, fn, "cut int, placebo boolean, level double, trend double, z double, p double")


@query()
def surrogate_associations(spark, sf):
    """Four associations with p under five kinds of surrogate, 200 each: screened; those at p <= 0.10 again with 5,000."""
    s = by_series(spark, sf).withColumnRenamed("week", "t")
    return C.surrogate_scan(s, ["series"], kinds=("ar1", "phase", "iaaft", "bootstrap", "shuffle")).drop("n")


@query()
def change_points(spark, sf):
    return per_series(spark, sf, lambda _, y, x: [{"pos": p} for p in K.segments(y)] or {"pos": []}, "pos int")


@query()
def series_complexity(spark, sf):
    def fn(name, y, x):
        rng = K.rng_of(name, "dfa")
        null = [K.dfa(rng.permutation(y)) for _ in range(50)]
        h = K.dfa(y)
        lo, hi = K.block_bootstrap(y, lambda v: float(v.mean()), rng, 4, 200)[1:]
        return [{"dfa": h, "dfa_box_mean": K.dfa(y, root=False), "p_shuffle": (1 + sum(v >= h for v in null)) / 51, "permutation_entropy": K.permutation_entropy(y), "mean_lo": lo, "mean_hi": hi, "detectable_r": K.detectable_r(len(y))}]

    return per_series(spark, sf, fn, "dfa double, dfa_box_mean double, p_shuffle double, permutation_entropy double, mean_lo double, mean_hi double, detectable_r double")


@query(WEEKS + ", f AS (SELECT sum(y * cos(2 * pi() * t / 52)) AS c, sum(y * sin(2 * pi() * t / 52)) AS s, count(*) AS n FROM s) SELECT round((c * c + s * s) / (n * n), 4) AS power, n FROM f")
def single_frequency_power(spark, sf):
    a = 2 * math.pi * F.col("t") / 52
    f = pairs(spark, sf).agg(F.sum(F.col("y") * F.cos(a)).alias("c"), F.sum(F.col("y") * F.sin(a)).alias("s"), F.count("*").alias("n"))
    return f.select(F.round((F.col("c") ** 2 + F.col("s") ** 2) / (F.col("n") ** 2), 4).alias("power"), "n")


@query(WEEKS + " SELECT coalesce(a.week, b.week)::VARCHAR AS week, round(a.y, 6) AS y, round(b.q, 6) AS q FROM (SELECT week, y FROM s WHERE t % 3 <> 0) a FULL JOIN (SELECT date_trunc('week', l_shipdate)::DATE AS week, avg(l_quantity) AS q FROM lineitem GROUP BY 1) b ON a.week = b.week")
def outer_joined_panel(spark, sf):
    a = pairs(spark, sf).where("t % 3 <> 0").select("week", "y")
    b = read(spark, sf, "lineitem").groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("week")).agg(F.avg("l_quantity").alias("q"))
    return J.outer_chain([a, b]).select(text("week"), six("y").alias("y"), six("q").alias("q"))


@query("WITH q AS (SELECT user_id, event_type, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events), c AS (SELECT quantile_cont(value, 0.2) AS a, quantile_cont(value, 0.4) AS b, quantile_cont(value, 0.6) AS c, quantile_cont(value, 0.8) AS d FROM q WHERE nx IS NOT NULL) SELECT event_type AS stage, (value > a)::INT + (value > b)::INT + (value > c)::INT + (value > d)::INT AS band, count(*) AS n, count(DISTINCT user_id) AS people, CASE WHEN count(*) >= 20 AND count(DISTINCT user_id) >= 5 THEN round(avg(nx - value), 6) END AS step FROM q, c WHERE nx IS NOT NULL GROUP BY 1, 2")
def phase_portrait(spark, sf):
    from pyspark.sql import Window

    e = read(spark, sf, "events")
    rows = e.withColumn("nx", F.lead("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("nx IS NOT NULL")
    return E.phase_portrait(rows, F.col("event_type"), "value", "nx", "user_id").select("stage", "band", "n", "people", six("step").alias("step"))
