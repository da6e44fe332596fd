"""Queries on cohorts' series, states and arrows, records of sentences, event-locked networks and plane fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import kernels as K
from ..functions import stats
from ..functions import text as X
from ..operators import coupling as C
from ..operators import graph as G
from ..operators import inference as I
from ..operators import joins as J
from ..operators import panel as P
from ..operators import records as Rec
from ..operators import sampling as S
from ..operators import spectra as Sp
from ..operators import statespace as SS
from ..operators import windows as W
from ..sources import readers as Src
from ..sources.tables import daily_orders, eight, read, reports, six
from .events import SPACED, events
from .panel import R, text
from .registry import query
from .text import SENT, TRAJ, VALUE, sentences, trajectories, value
from .vectors import embeddings

#: Weekly series of each priority (the cohorts' axes) and of all orders (the indicators).
AXES = "WITH a AS (SELECT substr(o_orderpriority, 1, 1) AS axis, date_trunc('week', o_orderdate)::DATE AS week, avg(o_totalprice) AS y FROM orders GROUP BY 1, 2), i AS (SELECT date_trunc('week', o_orderdate)::DATE AS week, count(*)::DOUBLE AS volume, avg(substr(o_orderpriority, 1, 1)::INT) AS rank, sum(o_totalprice) AS total FROM orders GROUP BY 1)"


def axes(spark, sf, freq: str = "week"):
    o = read(spark, sf, "orders").withColumn(freq, F.to_date(F.date_trunc(freq, "o_orderdate")))
    return o.groupBy(F.substring("o_orderpriority", 1, 1).alias("axis"), freq).agg(F.avg("o_totalprice").alias("y"))


def indicators(spark, sf, freq: str = "week"):
    o = read(spark, sf, "orders").withColumn(freq, F.to_date(F.date_trunc(freq, "o_orderdate")))
    return o.groupBy(freq).agg(F.count("*").cast("double").alias("volume"), F.avg(F.substring("o_orderpriority", 1, 1).cast("int")).alias("rank"), F.sum("o_totalprice").alias("total"))


def long_indicators(spark, sf, freq: str = "week"):
    return indicators(spark, sf, freq).unpivot(freq, ["volume", "rank", "total"], "indicator", "x")


# ---- coupling over families ----------------------------------------------------------------------


def family(spark, sf):
    """freq, signal, indicator, t, y, x: every axis against every indicator, by week and by month."""
    out = None
    for freq in ("week", "month"):
        part = axes(spark, sf, freq).join(long_indicators(spark, sf, freq), freq).select(F.lit(freq).alias("freq"), F.col("axis").alias("signal"), "indicator", F.col(freq).alias("t"), "y", "x")
        out = part if out is None else out.unionByName(part)
    return out


FAMILY = "WITH f AS (" + " UNION ALL ".join(f"SELECT '{q}' AS freq, a.signal, i.indicator, a.t, a.y, i.x FROM (SELECT substr(o_orderpriority, 1, 1) AS signal, date_trunc('{q}', o_orderdate)::DATE AS t, avg(o_totalprice) AS y FROM orders GROUP BY 1, 2) a JOIN (UNPIVOT (SELECT date_trunc('{q}', o_orderdate)::DATE AS t, count(*)::DOUBLE AS volume, avg(substr(o_orderpriority, 1, 1)::INT)::DOUBLE AS rank, sum(o_totalprice)::DOUBLE AS total FROM orders GROUP BY 1) ON volume, rank, total INTO NAME indicator VALUE x) i ON a.t = i.t" for q in ("week", "month")) + ")"


@query(FAMILY + ", r AS (SELECT *, " + ", ".join(f"rank() OVER (PARTITION BY freq, signal, indicator ORDER BY {c}) + (count(*) OVER (PARTITION BY freq, signal, indicator, {c}) - 1) / 2 AS r{c}" for c in "yx") + " FROM f) SELECT freq, signal, indicator, round(corr(y, x), 6) AS pearson, round(corr(ry, rx), 6) AS spearman, count(*) AS n FROM r GROUP BY 1, 2, 3")
def coupling_estimates(spark, sf):
    by = ["freq", "signal", "indicator"]
    r = family(spark, sf).withColumns({f"r{c}": stats.average_rank(c, by) for c in "yx"})
    return r.groupBy(*by).agg(six(F.corr("y", "x")).alias("pearson"), six(F.corr("ry", "rx")).alias("spearman"), F.count("*").alias("n"))


@query()
def coupling_scan(spark, sf):
    """Four statistics of every axis with every indicator by week and month, p under phase surrogates (200, then 5,000 where p <= 0.10), q over the family."""
    s = C.surrogate_scan(family(spark, sf), ["freq", "signal", "indicator"])
    return stats.benjamini_hochberg(s, family=["statistic"])


@query()
def cohort_axes_against_wave(spark, sf):
    """Each axis's correlation with the collective wave (first component of the indicators), exact p over all circular shifts, q over the axes."""
    wave = I.first_component(indicators(spark, sf), "week", ["volume", "rank", "total"], "volume")
    joined = axes(spark, sf).join(wave, "week")

    def one(ids, pdf):
        pdf = pdf.sort_values("week")
        r, p = K.shift_correlation(pdf["wave"].to_numpy(float), pdf["y"].to_numpy(float))
        return pd.DataFrame([{"axis": ids[0], "r": r, "p": p, "n": len(pdf)}])

    return stats.benjamini_hochberg(joined.groupBy("axis").applyInPandas(one, "axis string, r double, p double, n long"))


@query()
def wave_cross_check(spark, sf):
    """A dynamic factor of the indicators (two own lags, by EM) beside their first component: loadings, noise, correlation of the two."""
    return SS.wave_check(indicators(spark, sf), "week", ["volume", "rank", "total"], "volume")


@query()
def axes_against_wave_by_lag(spark, sf):
    """Each axis, less time and volume, with the wave at lags -3 to 3, p against 2,000 surrogates of random phases, q over the axes of a lag."""
    wave = I.first_component(indicators(spark, sf), "week", ["volume", "rank", "total"], "volume")
    o = read(spark, sf, "orders").groupBy(F.substring("o_orderpriority", 1, 1).alias("axis"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.avg("o_totalprice").alias("y"), F.count("*").alias("n_orders"))
    s = Sp.lag_scan_against_phases(o.join(wave, "week"), ["axis"], "week", "y", "wave", volume="n_orders")
    return stats.benjamini_hochberg(s, family=["lag"])


@query()
def welch_spectrum(spark, sf):
    """Welch's spectrum of every priority's daily mean price."""
    o = read(spark, sf, "orders").groupBy(F.substring("o_orderpriority", 1, 1).alias("axis"), F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("v"))
    return Sp.welch(o, ["axis"], "day", "v")


@query(AXES + ", u AS (UNPIVOT (SELECT week, volume, rank::DOUBLE AS rank, total::DOUBLE AS total FROM i) ON volume, rank, total INTO NAME indicator VALUE x), t AS (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY week) AS t FROM u), l AS (SELECT indicator, regr_slope(x, t) AS b, regr_intercept(x, t) AS c FROM t GROUP BY 1), d AS (SELECT t.*, x - b * t - c AS flat FROM t JOIN l USING (indicator)) SELECT axis, indicator, round(corr(y, x), 6) AS r, round(corr(y, flat), 6) AS r_detrended, count(*) AS n FROM a JOIN d USING (week) GROUP BY 1, 2")
def indicator_battery(spark, sf):
    """Each axis against each indicator as it is and without its line over time."""
    t = long_indicators(spark, sf).withColumn("t", F.row_number().over(Window.partitionBy("indicator").orderBy("week")))  # a row a week of each
    line = t.groupBy("indicator").agg(F.regr_slope("x", "t").alias("b"), F.regr_intercept("x", "t").alias("c"))
    flat = t.join(line, "indicator").withColumn("flat", F.col("x") - F.col("b") * F.col("t") - F.col("c"))
    return axes(spark, sf).join(flat, "week").groupBy("axis", "indicator").agg(six(F.corr("y", "x")).alias("r"), six(F.corr("y", "flat")).alias("r_detrended"), F.count("*").alias("n"))


@query("WITH w AS (SELECT date_trunc('week', o_orderdate)::DATE AS week, avg(o_totalprice) AS y, count(*)::DOUBLE AS m FROM orders GROUP BY 1), s AS (SELECT y, m / lag(m) OVER (ORDER BY week) - 1 AS ret FROM w) SELECT round(corr(y, ret), 6) AS r, count(*) AS n FROM s WHERE ret IS NOT NULL HAVING count(*) >= 20")
def weekly_against_market(spark, sf):
    """Weekly means against the market's weekly return, where there are twenty weeks."""
    o = read(spark, sf, "orders").groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.avg("o_totalprice").alias("y"), F.count("*").cast("double").alias("m"))
    s = o.withColumn("ret", F.col("m") / F.lag("m").over(Window.orderBy("week")) - 1).where("ret IS NOT NULL")  # a row a week
    return s.agg(six(F.corr("y", "ret")).alias("r"), F.count("*").alias("n")).where("n >= 20")


# ---- composition, states, volume, arrows -----------------------------------------------------------


@query("WITH o AS (SELECT date_trunc('week', o_orderdate)::DATE AS week, o_totalprice AS v, c_mktsegment AS seg, substr(o_orderpriority, 1, 1) AS pri FROM orders JOIN customer ON o_custkey = c_custkey), c AS (SELECT seg, pri, avg(v) AS m FROM o GROUP BY 1, 2), g AS (SELECT avg(v) AS g FROM o) SELECT week::VARCHAR AS week, round(avg(v), 4) AS raw, round(avg(v - m + g), 4) AS adj, round(ln(count(*)), 6) AS logn FROM o JOIN c USING (seg, pri), g GROUP BY 1 HAVING count(*) >= 5")
def composition_adjusted_weeks(spark, sf):
    """Weekly means as they are and less what the week's mix of people explains, where enough reports fall in."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("seg"))
    o = read(spark, sf, "orders").join(c, "o_custkey").select(F.to_date(F.date_trunc("week", "o_orderdate")).alias("week"), F.col("o_totalprice").alias("v"), "seg", F.substring("o_orderpriority", 1, 1).alias("pri"))
    a = P.composition_adjusted(o, "v", ["seg", "pri"], "week", 5)
    return a.select(text("week"), F.round("raw", 4).alias("raw"), F.round("adj", 4).alias("adj"), six(F.log("n")).alias("logn"))


@query(R + ", s AS (SELECT *, count(value) OVER p AS n, sum(value) OVER p AS s FROM r WINDOW p AS (PARTITION BY user_id)), w AS (SELECT date_trunc('week', day)::DATE AS week, avg(value - (s - value) / (n - 1)) AS state, count(*) AS n_state FROM s WHERE n > 1 GROUP BY 1), q AS (SELECT user_id, day, list(value ORDER BY ts, doc_id) AS v, count(*) AS k FROM r GROUP BY 1, 2 HAVING count(*) >= 4), a AS (SELECT date_trunc('week', day)::DATE AS week, avg(v[-1] - v[1]) AS drift, avg((k - 1) * list_sum(list_transform(range(k), lambda i: v[i + 1] * (i - (k - 1) / 2))) / (k * (k * k - 1) / 12)) AS slope, count(*) AS n_arrow FROM q GROUP BY 1) SELECT week::VARCHAR AS week, round(state, 6) AS state, n_state, round(drift, 6) AS drift, round(slope, 5) AS slope, n_arrow FROM w JOIN a USING (week) WHERE (SELECT count(*) FROM w JOIN a USING (week)) >= 3")
def weekly_states_and_arrows(spark, sf):
    """Weekly mean of each person's departures from the person's other reports, beside the weekly mean drift and slope of a person's day."""
    r = reports(spark, sf)
    state = W.loo_deviation(r, "value").where("dev IS NOT NULL").groupBy(F.to_date(F.date_trunc("week", "day")).alias("week")).agg(six(F.avg("dev")).alias("state"), F.count("*").alias("n_state"))
    held = r.groupBy("user_id", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "doc_id", "value"))), lambda x: x["value"]).alias("v")).where(F.size("v") >= 4)
    t = A.trajectory(F.col("v"))
    arrow = held.groupBy(F.to_date(F.date_trunc("week", "day")).alias("week")).agg(six(F.avg(t["drift"])).alias("drift"), F.round(F.avg(t["slope"]), 5).alias("slope"), F.count("*").alias("n_arrow"))
    both = state.join(arrow, "week")
    return both.withColumn("weeks", F.count("*").over(Window.partitionBy())).where("weeks >= 3").select(text("week"), "state", "n_state", "drift", "slope", "n_arrow")  # a row a week


@query(R + ", s AS (SELECT *, count(value) OVER (PARTITION BY user_id) AS n FROM r), d AS (SELECT day, lang, count(*) AS n_state FROM s WHERE n > 1 GROUP BY 1, 2), m AS (SELECT day, max(n_state) AS m FROM d GROUP BY 1) SELECT date_trunc('week', day)::DATE::VARCHAR AS week, sum(m)::BIGINT AS volume FROM m GROUP BY 1")
def weekly_state_volume(spark, sf):
    """A week's volume: the sum over its days of the largest axis's number of states."""
    d = W.loo_deviation(reports(spark, sf), "value").where("dev IS NOT NULL").groupBy("day", "lang").agg(F.count("*").alias("n_state"))
    m = d.groupBy("day").agg(F.max("n_state").alias("m"))
    return m.groupBy(F.to_date(F.date_trunc("week", "day")).cast("string").alias("week")).agg(F.sum("m").alias("volume"))


@query(R + ", h AS (SELECT *, ((user_id * 2654435761) % 4294967296 >> 7) % 2 AS half FROM r), d AS (SELECT half, day, avg(value) AS a, avg(k) AS b, count(*) AS n FROM h GROUP BY 1, 2), z AS (SELECT *, (a - avg(a) OVER w) / stddev_samp(a) OVER w AS za, (b - avg(b) OVER w) / stddev_samp(b) OVER w AS zb FROM d WHERE n >= 5 WINDOW w AS (PARTITION BY half)) SELECT half::INT AS half, day::VARCHAR AS day, round(CASE WHEN za IS NULL AND zb IS NULL THEN NULL ELSE (coalesce(za, 0) + coalesce(zb, 0)) / ((za IS NOT NULL)::INT + (zb IS NOT NULL)::INT) END, 6) AS axis, n FROM z")
def split_half_axes(spark, sf):
    """A composite axis built anew in each half of the contributors: standardised daily means, averaged where there are any."""
    r = reports(spark, sf).withColumn("half", S.half("user_id", 0))
    d = r.groupBy("half", "day").agg(F.avg("value").alias("a"), F.avg("k").alias("b"), F.count("*").alias("n")).where("n >= 5")
    w = Window.partitionBy("half")  # a row a day
    z = d.withColumns({f"z{c}": (F.col(c) - F.avg(c).over(w)) / F.stddev_samp(c).over(w) for c in "ab"})
    return z.select("half", text("day"), six(stats.row_mean("za", "zb")).alias("axis"), "n")


@query("WITH s AS (SELECT lang, len(regexp_extract_all(lower(text), '[aeiou]')) / greatest(len(regexp_extract_all(lower(text), '[a-z]')), 1) AS proxy, len(string_split(text, ' '))::DOUBLE / greatest(length(text), 1) AS score FROM documents) SELECT coalesce(lang, 'all') AS lang, round(corr(proxy, score), 6) AS r, count(*) AS n FROM s GROUP BY ROLLUP (lang)")
def proxy_validation(spark, sf):
    """How well a proxy measured on texts goes with a scorer, by language and in all."""
    t, low = F.col("text"), F.lower("text")
    s = read(spark, sf, "documents").select("lang", (F.regexp_count(low, F.lit("[aeiou]")) / F.greatest(F.regexp_count(low, F.lit("[a-z]")), F.lit(1))).alias("proxy"), (F.size(F.split(t, " ")).cast("double") / F.greatest(F.char_length(t), F.lit(1))).alias("score"))
    return s.rollup("lang").agg(six(F.corr("proxy", "score")).alias("r"), F.count("*").alias("n")).select(F.coalesce("lang", F.lit("all")).alias("lang"), "r", "n")


@query(R + ", d AS (SELECT lang, day, avg(value) - 50 AS x FROM r GROUP BY 1, 2), s AS (SELECT lang, avg(x) AS m, stddev_samp(x) / sqrt(count(*)) AS se, count(*) AS n, count(*) FILTER (x > 0) AS up FROM d GROUP BY 1), t AS (SELECT *, m - 1.96 * se AS lo, m + 1.96 * se AS hi, list_sum(list_transform(range(up, n + 1), lambda k: exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) - n * ln(2.0)))) AS sign_p, abs(m / se) AS z FROM s) SELECT lang, round(m, 6) AS m, round(lo, 6) AS lo, round(sign_p, 6) AS sign_p, CASE WHEN n = 0 THEN 'n/a' WHEN lo > 0 AND sign_p < 0.05 THEN 'robust positive' WHEN lo > 0 OR sign_p < 0.05 THEN 'suggestive' ELSE 'null' END AS tier FROM t")
def tiered_effects(spark, sf):
    """Each axis's daily means against a level: interval, sign test, tier."""
    d = reports(spark, sf).groupBy("lang", "day").agg((F.avg("value") - 50).alias("x"))
    s = d.groupBy("lang").agg(F.avg("x").alias("m"), (F.stddev_samp("x") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"), F.count_if(F.col("x") > 0).alias("up"))
    s = s.withColumns({"lo": F.col("m") - 1.96 * F.col("se"), "sign_p": stats.sign_test(F.col("up"), F.col("n"))})
    return s.select("lang", six("m").alias("m"), six("lo").alias("lo"), six("sign_p").alias("sign_p"), stats.tier_of_interval(F.col("n"), F.col("lo"), F.col("sign_p"), F.col("sign_p")).alias("tier"))


# ---- sentences and records -------------------------------------------------------------------------


@query(SENT + " SELECT doc_id, count(*) AS n_sent, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::BIGINT AS n_words, max(pos)::INT AS last FROM e GROUP BY 1")
def sentence_counts(spark, sf):
    s = Rec.sentence_build(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sent"), F.sum("n_words").alias("n_words"), F.max("pos").alias("last"))


@query(SENT + f", v AS (SELECT doc_id, count(*) AS k, bool_or(doc_id % 5 = 0 AND pos % 7 = 6) AS bad, list({VALUE} ORDER BY pos) AS v FROM e GROUP BY 1) SELECT doc_id, k AS n, round(v[1], 8) AS first, round(v[-1], 8) AS last, round(list_avg(v), 8) AS mean FROM v WHERE k >= 4 AND NOT bad")
def true_score_records(spark, sf):
    """Records of scored sentences; reports with a score that isn't finite are left out, counts that don't match stop the query."""
    s = sentences(spark, sf).withColumn("score", F.when((F.col("doc_id") % 5 == 0) & (F.col("pos") % 7 == 6), float("nan")).otherwise(value(F.col("text"))))
    counts = sentences(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_sent"))
    r = Rec.true_records(s, counts, "doc_id", "score")
    return r.select("doc_id", F.size("vals").cast("long").alias("n"), eight(F.element_at("vals", 1)).alias("first"), eight(F.element_at("vals", -1)).alias("last"), eight(A.mean(F.col("vals"))).alias("mean"))


@query(SENT + ", w AS (SELECT doc_id, list(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::DOUBLE ORDER BY pos) AS v FROM e GROUP BY 1 HAVING count(*) >= 4) SELECT doc_id, len(v)::BIGINT AS n, v[1] AS first, v[-1] AS last, round(list_avg(v), 8) AS mean FROM w")
def records_under_vector(spark, sf):
    """The same records under another value: each sentence's number of words."""
    r = Rec.records(sentences(spark, sf), "doc_id", X.word_count(F.col("text")).cast("double"))
    return r.select("doc_id", F.size("vals").cast("long").alias("n"), F.element_at("vals", 1).alias("first"), F.element_at("vals", -1).alias("last"), eight(A.mean(F.col("vals"))).alias("mean"))


def _at20(v: str) -> str:
    return f"list_transform(range(20), lambda i: {v}[least(floor(i * (k - 1) / 19), k - 2)::INT + 1] + ({v}[least(floor(i * (k - 1) / 19), k - 2)::INT + 2] - {v}[least(floor(i * (k - 1) / 19), k - 2)::INT + 1]) * (i * (k - 1) / 19 - least(floor(i * (k - 1) / 19), k - 2)))"


@query(SENT + f", p AS (SELECT doc_id, pos, {VALUE} AS x FROM e), v AS (SELECT doc_id, count(*) AS k, list(x ORDER BY pos) AS a, list(x ORDER BY ((pos + 1) * 2654435761 + (doc_id % 2147483648) * 40503) % 4294967296, pos) AS b FROM p GROUP BY 1 HAVING count(*) >= 5), r AS (SELECT doc_id, {_at20('a')} AS a, {_at20('b')} AS b FROM v) SELECT doc_id, unnest(range(20))::INT AS i, round(unnest(a), 8) AS real, round(unnest(b), 8) AS shuffled FROM r")
def paired_shuffled_arcs(spark, sf):
    held = trajectories(spark, sf).select("doc_id", F.col("v").alias("vals"))
    p = Rec.paired_arcs(held, "doc_id")
    return p.select("doc_id", F.posexplode(F.arrays_zip("real", "shuffled")).alias("i", "z")).select("doc_id", "i", eight("z.real").alias("real"), eight("z.shuffled").alias("shuffled"))


@query(TRAJ + """, q AS (SELECT source, k, v, greatest(k // 3, 1) AS j FROM v), t AS (SELECT source, v[-1] - v[1] AS drift, list_avg(v[1:j]) AS t1, CASE WHEN k - 2 * j > 0 THEN list_avg(v[j + 1:k - j]) ELSE list_avg(v) END AS t2, list_avg(v[k - j + 1:k]) AS t3 FROM q)
  SELECT source, count(*) AS n, round(avg(drift), 8) AS drift, round(avg((t2 >= t1 AND t3 >= t2)::INT), 6) AS share_rise, round(avg((t2 < t1 AND t3 < t2)::INT), 6) AS share_fall, round(avg((t2 >= t1 AND t3 < t2)::INT), 6) AS share_peak, round(avg((t2 < t1 AND t3 >= t2)::INT), 6) AS share_trough FROM t GROUP BY 1""")
def corpus_summary(spark, sf):
    s = Rec.corpus_summary(trajectories(spark, sf).select("source", F.col("v").alias("vals")), ["source"])
    return s.select("source", "n", eight("drift").alias("drift"), *(six(f"share_{a}").alias(f"share_{a}") for a in ("rise", "fall", "peak", "trough")))


@query()
def corpus_auc(spark, sf):
    """Forward against reversed within each corpus, folds by document: all corpora in the same passes."""
    rows = Rec.both_ways(trajectories(spark, sf).select("doc_id", "source", F.col("v").alias("vals")), ["doc_id", "source"])
    return I.folded_auc(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(5))), ["slope", "half", "ends", "argmax", "argmin"], "y", "fold", ["source"])


# ---- event-locked networks, planes -----------------------------------------------------------------

COLUMNS = ["n", "v", "x", "spread"]
DAILY = "d0 AS (SELECT o_orderdate::DATE AS day, count(*)::DOUBLE AS n, avg(o_totalprice) AS v, avg(substr(o_orderpriority, 1, 1)::INT) AS x, stddev_pop(o_totalprice) AS spread FROM orders GROUP BY 1)"
PAIRS = " UNION ALL ".join(f"SELECT left_out, abs(corr({a}, {b})) AS rho FROM k GROUP BY 1" for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :])


def locked_days(spark, sf):
    """left_out and the days of all other events' windows, each day once: 'none' leaves no event out."""
    ev = events(spark, sf).select(F.col("day").alias("event"))
    left = ev.select(F.col("event").cast("string").alias("left_out")).unionByName(spark.createDataFrame([("none",)], "left_out string"))
    kept = left.crossJoin(F.broadcast(ev)).where("left_out <> cast(event AS string)")  # events by events: some dozen of each
    near = J.near_days(ev.withColumnRenamed("event", "day"), -3, 7)
    return kept.join(near, "event").select("left_out", "day").distinct()


@query(SPACED + f", {DAILY}, l AS (SELECT day::VARCHAR AS left_out FROM ev UNION ALL SELECT 'none'), w AS (SELECT DISTINCT l.left_out, ev.day + o.o AS day FROM l, ev, (SELECT unnest(range(-3, 8))::INT AS o) o WHERE l.left_out <> ev.day::VARCHAR), m AS (SELECT w.left_out, d0.* FROM w JOIN d0 ON d0.day = w.day), k AS (SELECT left_out, " + ", ".join(f"rank() OVER (PARTITION BY left_out ORDER BY {c}) + (count(*) OVER (PARTITION BY left_out, {c}) - 1) / 2 AS {c}" for c in COLUMNS) + f" FROM m), p AS ({PAIRS}), z AS (SELECT left_out, count(*) AS days FROM k GROUP BY 1) SELECT left_out, days, round(avg(rho), 6) AS mean_abs_rho FROM p JOIN z USING (left_out) GROUP BY 1, 2")
def event_locked_networks(spark, sf):
    """Mean strength of the network of daily statistics inside event windows, with all events and without each."""
    o = read(spark, sf, "orders")
    d = o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").cast("double").alias("n"), F.avg("o_totalprice").alias("v"), F.avg(F.substring("o_orderpriority", 1, 1).cast("int")).alias("x"), F.stddev_pop("o_totalprice").alias("spread"))
    m = locked_days(spark, sf).join(d, "day").withColumnRenamed("n", "volume")
    c = G.correlations(m, ["volume", "v", "x", "spread"], ["left_out"])
    return c.groupBy("left_out").agg(F.first("n").alias("days"), six(F.avg(F.abs("rho"))).alias("mean_abs_rho"))


@query()
def event_locked_spectra(spark, sf):
    """The other scalars of the same networks."""
    o = read(spark, sf, "orders")
    d = o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").cast("double").alias("volume"), F.avg("o_totalprice").alias("v"), F.avg(F.substring("o_orderpriority", 1, 1).cast("int")).alias("x"), F.stddev_pop("o_totalprice").alias("spread"))
    return G.scalars(G.correlations(locked_days(spark, sf).join(d, "day"), ["volume", "v", "x", "spread"], ["left_out"]), ["left_out"])


@query("SELECT floor(embedding[1]::DOUBLE * 8)::INT AS bx, floor(embedding[2]::DOUBLE * 8)::INT AS by_, count(*) AS n, round(avg(label), 6) AS mean FROM embeddings GROUP BY 1, 2")
def plane_field(spark, sf):
    """A field over a map: counts and mean value in squares of a plane."""
    e = embeddings(spark, sf)
    at = lambda k: F.floor(F.get("embedding", F.lit(k)).cast("double") * 8).cast("int")
    return e.groupBy(at(0).alias("bx"), at(1).alias("by_")).agg(F.count("*").alias("n"), six(F.avg("label")).alias("mean"))


@query("WITH e AS (SELECT vec_id, embedding[1:2]::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id, e.vec_id AS other, list_cosine_similarity(q.v, e.v) AS sim FROM q JOIN e ON e.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 12) DESC, other) AS rk FROM s) SELECT vec_id AS a, other AS b FROM r WHERE rk <= 3")
def plane_neighbours(spark, sf):
    """Edges of a map: the query rows' three nearest in the plane, by angle."""
    e = embeddings(spark, sf).select("vec_id", F.slice("embedding", 1, 2).alias("embedding"))
    return J.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 3).select(F.col("vec_id").alias("a"), F.col("other").alias("b"))


@query()
def plane_clusters(spark, sf):
    """Six clusters of a plane, by size and mean value."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = embeddings(spark, sf).select("label", array_to_vector(F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double"))).alias("features"))
    g = KMeans(k=6, seed=0, maxIter=20).fit(e).transform(e)
    return g.groupBy("prediction").agg(F.count("*").alias("n"), F.avg("label").alias("mean"))


@query("WITH o AS (SELECT o_totalprice AS v, o_custkey % 7 - 1 AS w FROM orders) SELECT round(sum(v * w) FILTER (w > 0) / sum(w) FILTER (w > 0), 6) AS weighted FROM o")
def weighted_mean(spark, sf):
    """Rows whose weight isn't positive don't count."""
    o = read(spark, sf, "orders").select(F.col("o_totalprice").alias("v"), (F.col("o_custkey") % 7 - 1).alias("w"))
    return o.agg(six(stats.weighted_mean(F.col("v"), F.col("w"))).alias("weighted"))


@query("SELECT day::VARCHAR AS day, round(v, 6) AS v FROM (SELECT o_orderdate::DATE AS day, avg(o_totalprice) AS v FROM orders GROUP BY 1) ORDER BY 1 LIMIT 50")
def head_of_days(spark, sf):
    """The first fifty days: a head of a table in a stated order."""
    return daily_orders(spark, sf).orderBy("day").limit(50).select(text("day"), six("v").alias("v"))


@query(SENT + " SELECT doc_id, count(*) AS n_sent FROM e GROUP BY 1 HAVING count(*) >= 4 ORDER BY doc_id LIMIT 100")
def head_of_corpus(spark, sf):
    """The first hundred documents, in order, that have four sentences: a head is what is asked for."""
    d = read(spark, sf, "documents").select("doc_id", F.explode(F.array(X.sentences(F.col("text")))).alias("s"))
    return Src.head_of_corpus(d, "doc_id", "s", 100).select("doc_id", F.size("s").cast("long").alias("n_sent"))
