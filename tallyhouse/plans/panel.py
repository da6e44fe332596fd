"""Queries over events as reports: cleaning, panels, gates, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import panel as P
from ..operators import windows as W
from ..sources.tables import daily_orders, read, reports, six
from .registry import query

#: The start of most oracles: events as reports.
R = "WITH r AS (SELECT event_id AS doc_id, user_id, ts, ts::DATE AS day, event_type AS lang, value, (props->>'$.k')::DOUBLE AS k FROM events)"
DAYS = R + ", d AS (SELECT lang, day, avg(value) AS v, count(*) AS n_reports, count(DISTINCT user_id) AS n_users FROM r GROUP BY lang, day)"
ORDERS = "WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS n, avg(o_totalprice) AS v FROM orders GROUP BY 1)"


def text(c: str):
    return F.col(c).cast("string").alias(c)


@query(R + ", c AS (SELECT * FROM r WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ts, user_id) = 1) SELECT doc_id, user_id, lang, day::VARCHAR AS day FROM c")
def clean_reports(spark, sf):
    r = reports(spark, sf)
    twice = r.unionByName(r.where("doc_id % 7 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")))
    return P.clean(twice, "doc_id", "ts", "2024-01-03", "2024-01-25", ["ts", "user_id"]).select("doc_id", "user_id", "lang", text("day"))


@query(R + " SELECT (SELECT count(*) FROM r WHERE doc_id % 7 = 0) AS repeated, 0 AS no_time, count(*) FILTER (NOT day BETWEEN DATE '2024-01-03' AND DATE '2024-01-25') AS out_of_range FROM r")
def clean_report_counts(spark, sf):
    r = reports(spark, sf)
    return P.dropped(r.unionByName(r.where("doc_id % 7 = 0")), "doc_id", "ts", "2024-01-03", "2024-01-25")


@query(R + """, g AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, day, avg(value) AS v, avg(k) AS k, count(*) AS n_reports, count(DISTINCT user_id) AS n_users
  FROM r GROUP BY GROUPING SETS ((day), (lang, day)))
  SELECT lang, day::VARCHAR AS day, CASE WHEN n_reports >= 20 AND n_users >= 5 THEN round(v, 6) END AS value_mean, CASE WHEN n_reports >= 20 AND n_users >= 5 THEN round(k, 6) END AS k_mean, n_reports, n_users FROM g""")
def daily_panel(spark, sf):
    gated = P.gate(P.daily(reports(spark, sf), ["value", "k"]), ["value_mean", "k_mean"])
    return gated.select("lang", text("day"), six("value_mean").alias("value_mean"), six("k_mean").alias("k_mean"), "n_reports", "n_users")


@query(DAYS + " SELECT lang, date_trunc('week', day)::DATE::VARCHAR AS week, round(sum(v * n_reports) / sum(n_reports), 6) AS value_mean, sum(n_reports)::BIGINT AS n_reports, sum(n_users)::BIGINT AS n_userdays FROM d GROUP BY 1, 2")
def weekly_panel(spark, sf):
    days = P.daily(reports(spark, sf), ["value"]).where("lang <> 'all'")
    return P.weekly(days, ["value_mean"]).select("lang", text("week"), six("value_mean").alias("value_mean"), "n_reports", "n_userdays")


@query(ORDERS + ", w AS (SELECT date_trunc('week', day)::DATE AS week, max_by(v, day) AS v FROM d GROUP BY 1) SELECT week::VARCHAR AS week, round(v, 6) AS v, round(v / lag(v) OVER (ORDER BY week) - 1, 6) AS v_return FROM w")
def weekly_last_return(spark, sf):
    weeks = P.to_weekly(daily_orders(spark, sf), "v", "last")
    return P.returns(weeks, "v").select(text("week"), six("v").alias("v"), six("v_return").alias("v_return"))


@query(R + ", a AS (SELECT day, lang, avg(value) AS v FROM r GROUP BY 1, 2), b AS (SELECT day, avg(v) AS v FROM a GROUP BY 1) SELECT date_trunc('week', day)::DATE::VARCHAR AS week, round(avg(v), 6) AS value FROM b GROUP BY 1")
def two_stage_weekly_mean(spark, sf):
    return P.two_stage_mean(reports(spark, sf), "value", "lang").select(text("week"), six("value").alias("value"))


@query(R + " SELECT user_id, day::VARCHAR AS day, round(avg(value), 6) AS value, count(*) AS n_rep FROM r GROUP BY 1, 2")
def person_day(spark, sf):
    return P.person_day(reports(spark, sf), "value").select("user_id", text("day"), six("value").alias("value"), "n_rep")


@query(R + ", s AS (SELECT min(day) AS lo, max(day) AS hi FROM r) SELECT user_id FROM r, s GROUP BY user_id HAVING bool_or((day - lo) < (hi - lo) / 3.0) AND bool_or((hi - day) < (hi - lo) / 3.0)")
def stable_people(spark, sf):
    return P.stable_people(reports(spark, sf))


@query(R + ", p AS (SELECT lang, user_id, avg(value) AS m FROM r GROUP BY 1, 2) SELECT lang, round(avg(m), 6) AS value, count(*) AS n_people FROM p GROUP BY 1")
def mean_of_people(spark, sf):
    return P.mean_of_people(reports(spark, sf), "value", by=["lang"]).select("lang", six("value").alias("value"), "n_people")


@query(R + ", c AS (SELECT quantile_cont(value, 0.1) AS cut FROM r) SELECT day::VARCHAR AS day, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(avg((value <= cut)::INT), 6) AS tail_rate FROM r, c GROUP BY 1")
def period_moments(spark, sf):
    return P.period_moments(reports(spark, sf), "value", "day").select(text("day"), "n", *(six(c).alias(c) for c in ("mean", "sd", "tail_rate")))


@query(DAYS + " SELECT lang, round(sum(n_reports * v * v) / sum(n_reports) - (sum(n_reports * v) / sum(n_reports)) ** 2, 6) AS wvar FROM d GROUP BY 1")
def weighted_variance(spark, sf):
    return P.weighted_variance(P.daily(reports(spark, sf), ["value"]).where("lang <> 'all'"), "value_mean", "n_reports", ["lang"]).select("lang", six("wvar").alias("wvar"))


@query(R + """, o AS (SELECT day, user_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM r GROUP BY 1, 2), t AS (SELECT day, var_samp(value) AS total FROM r GROUP BY 1)
  SELECT day::VARCHAR AS day, sum(n)::BIGINT AS n, count(*) AS people, round(var_samp(m), 6) AS between, round(sum(v * n) / greatest(sum(n) - count(*), 1), 6) AS within, round(any_value(total), 6) AS total FROM o JOIN t USING (day) GROUP BY day""")
def within_between(spark, sf):
    return P.within_between(reports(spark, sf), "value").select(text("day"), "n", "people", *(six(c).alias(c) for c in ("between", "within", "total")))


LOO = R + ", l AS (SELECT *, value - (sum(value) OVER u - value) / nullif(count(value) OVER u - 1, 0) AS dev FROM r WINDOW u AS (PARTITION BY user_id))"


@query(LOO + """, g AS (SELECT day, count(*) AS n, avg(dev) AS m, var_pop(dev) AS v FROM l WHERE dev IS NOT NULL GROUP BY day),
  s AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) AS nm, sum(n * m * m) AS nmm, sum(n * v) AS ssw, sum(n * n) AS nn FROM g),
  q AS (SELECT *, (nmm - nm * nm / n) / (k - 1) AS msb, ssw / (n - k) AS msw, (n - nn / n) / (k - 1) AS n0 FROM s)
  SELECT n::BIGINT AS n, k, round(msb, 6) AS msb, round(msw, 6) AS msw, round(msb / msw, 6) AS f, round(n0, 6) AS n0, round(sqrt(greatest(msb - msw, 0) / n0), 6) AS sd_day, round(greatest(msb - msw, 0) / greatest(msb + (n0 - 1) * msw, 1e-12), 6) AS icc_day FROM q""")
def day_effect_anova(spark, sf):
    a = P.anova(W.loo_deviation(reports(spark, sf), "value"), "dev", "day")
    return a.select("n", "k", *(six(c).alias(c) for c in ("msb", "msw", "f", "n0", "sd_day", "icc_day")))


@query(LOO + " SELECT doc_id, round(dev, 6) AS dev FROM l")
def leave_one_out(spark, sf):
    return W.loo_deviation(reports(spark, sf), "value").select("doc_id", six("dev").alias("dev"))


@query(R + ", s AS (SELECT *, count(*) OVER u AS n, sum(value) OVER u AS sv, sum(k) OVER u AS sk FROM r WINDOW u AS (PARTITION BY user_id)) SELECT doc_id, round(value - (sv - value) / (n - 1), 6) AS value_dev, round(k - (sk - k) / (n - 1), 6) AS k_dev FROM s WHERE n >= 60")
def leave_one_out_matrix(spark, sf):
    return W.loo_matrix(reports(spark, sf), ["value", "k"], least=60).select("doc_id", six("value_dev").alias("value_dev"), six("k_dev").alias("k_dev"))


@query(R + ", m AS (SELECT user_id, lang, count(*) AS n, avg(value) AS v FROM r GROUP BY 1, 2) SELECT user_id, n, round(v, 6) AS value, round(v - lag(v) OVER (PARTITION BY user_id ORDER BY lang), 6) AS value_state, lang FROM m WHERE n >= 3")
def past_only_states(spark, sf):
    m = reports(spark, sf).groupBy("user_id", "lang").agg(F.count("*").alias("n"), F.avg("value").alias("value")).where("n >= 3")
    return W.past_only(m, ["value"], "user_id", "lang").select("user_id", "lang", "n", six("value").alias("value"), six("value_state").alias("value_state"))


@query(R + ", g AS (SELECT user_id, date_trunc('week', day)::DATE AS week, avg(value) AS value, avg(k) AS k, count(*) AS n_period FROM r GROUP BY 1, 2 HAVING count(*) >= 3), h AS (SELECT *, count(*) OVER (PARTITION BY week) AS p FROM g) SELECT user_id, week::VARCHAR AS week, round(value, 6) AS value, round(k, 6) AS k, n_period FROM h WHERE p >= 20")
def person_period_centroids(spark, sf):
    r = reports(spark, sf).withColumn("week", F.to_date(F.date_trunc("week", "day")))
    return P.centroids(r, ["value", "k"], "user_id", "week").select("user_id", text("week"), six("value").alias("value"), six("k").alias("k"), "n_period")


WORDS = "list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: len(x) > 3)"


@query(f"WITH e AS (SELECT doc_id, n_chars, unnest({WORDS}) AS item FROM documents) SELECT item, count(*) AS freq, round(avg(n_chars), 6) AS mean FROM e GROUP BY 1 ORDER BY freq DESC, item LIMIT 30")
def top_items(spark, sf):
    d = read(spark, sf, "documents").withColumn("items", F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")), lambda x: F.length(x) > 3))
    return P.top_items(d, "items", "n_chars", 30).select("item", "freq", six("mean").alias("mean"))


@query(f"""WITH d AS (SELECT doc_id, source, list_distinct({WORDS}) AS items FROM documents), s AS (SELECT source, count(*) AS size FROM d GROUP BY 1 HAVING count(*) >= 20),
  c AS (SELECT source, item, count(*) AS c FROM (SELECT source, unnest(items) AS item FROM d) GROUP BY 1, 2), p AS (SELECT item, c / size AS prev, row_number() OVER (PARTITION BY item ORDER BY source) AS t FROM c JOIN s USING (source))
  SELECT item, round(regr_slope(prev, t), 6) AS slope, count(*) AS periods FROM p GROUP BY 1 HAVING count(*) >= 6""")
def prevalence_slopes(spark, sf):
    d = read(spark, sf, "documents").withColumn("items", F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")), lambda x: F.length(x) > 3))
    return P.prevalence_slope(d, "items", "source").select("item", six("slope").alias("slope"), "periods")


@query(f"""WITH d AS (SELECT doc_id, list_distinct({WORDS}) AS items FROM documents), e AS (SELECT doc_id, unnest(items) AS item FROM d),
  t AS (SELECT item FROM (SELECT unnest({WORDS}) AS item FROM documents) GROUP BY 1 ORDER BY count(*) DESC, item LIMIT 20)
  SELECT x.item AS a, y.item AS b, count(*) AS weight FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.item < y.item WHERE x.item IN (FROM t) AND y.item IN (FROM t) GROUP BY 1, 2 HAVING count(*) >= 10""")
def cooccurrence_network(spark, sf):
    d = read(spark, sf, "documents").withColumn("items", F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")), lambda x: F.length(x) > 3))
    return P.cooccurrence(d, "doc_id", "items", P.top_items(d, "items", "n_chars", 20), 10)


@query("WITH e AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) SELECT lang, token, count(*) AS freq FROM e GROUP BY 1, 2")
def token_counts(spark, sf):
    return P.token_counts(read(spark, sf, "documents"), F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")), ["lang"])


@query(R + ", t AS (SELECT isodow(day) - 1 AS d, count(*) FILTER (lang = 'click') AS a, count(*) FILTER (lang = 'view') AS b, count(*) FILTER (lang = 'error') AS c FROM r GROUP BY 1) SELECT d::INT AS row, round(a / (a + b + c), 6) AS click, round(b / (a + b + c), 6) AS view, round(c / (a + b + c), 6) AS error FROM t")
def weekday_shares(spark, sf):
    s = P.shares(reports(spark, sf), F.weekday("day"), "lang", ["click", "view", "error"])
    return s.select("row", six("click").alias("click"), six("view").alias("view"), six("error").alias("error"))


@query(R + " SELECT user_id, count(*) FILTER (lang = 'click') AS click, count(*) FILTER (lang = 'view') AS view FROM r GROUP BY 1 HAVING count(*) FILTER (lang = 'click') >= 5 AND count(*) FILTER (lang = 'view') >= 5")
def both_strata_people(spark, sf):
    return reports(spark, sf).groupBy("user_id").pivot("lang", ["click", "view"]).count().na.fill(0).where("click >= 5 AND view >= 5")


@query(R + """, d AS (SELECT day, count(*) AS n FROM r GROUP BY 1) SELECT count(*) AS n_reports, count(DISTINCT user_id) AS n_people, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day,
  round(quantile_cont(value, 0.5), 6) AS median_value, (SELECT count(*) FROM d) AS active_days, (SELECT quantile_cont(n, 0.5) FROM d)::DOUBLE AS median_per_day FROM r""")
def quality_profile(spark, sf):
    return P.profile(reports(spark, sf)).select("n_reports", "n_people", text("first_day"), text("last_day"), six("median_value").alias("median_value"), "active_days", "median_per_day")


@query("""WITH r AS (SELECT event_id AS doc_id, user_id, ts::DATE AS day, date_trunc('week', ts)::DATE AS week, event_type AS lang, value FROM events), f AS (SELECT *, min(CASE WHEN lang <> 'error' THEN day END) OVER (PARTITION BY user_id) AS fs FROM r)
  SELECT week::VARCHAR AS week, count(*) FILTER (lang <> 'error') AS n_posts, count(DISTINCT CASE WHEN lang <> 'error' THEN user_id END) AS n_authors, round(avg(value) FILTER (lang <> 'error'), 6) AS mean_words,
  round(avg((date_trunc('week', fs)::DATE = week)::INT) FILTER (lang <> 'error'), 6) AS new_author_share, round(avg((lang = 'error')::INT), 6) AS flag_rate FROM f GROUP BY 1""")
def weekly_composition(spark, sf):
    r = reports(spark, sf).withColumn("week", F.to_date(F.date_trunc("week", "day")))
    c = P.composition(r, flag=F.col("lang") == "error", among=F.col("lang") != "error", words=F.col("value"))
    return c.select(text("week"), "n_posts", "n_authors", *(six(x).alias(x) for x in ("mean_words", "new_author_share", "flag_rate")))


@query(R + ", p AS (SELECT day, user_id, (value > 10)::INT - avg((value > 10)::INT) OVER (PARTITION BY user_id) AS a FROM r) SELECT day::VARCHAR AS day, round(avg(a), 6) AS high, count(*) AS n, count(DISTINCT user_id) AS n_users FROM p GROUP BY 1")
def person_adjusted_presence(spark, sf):
    r = reports(spark, sf).withColumn("high", (F.col("value") > 10).cast("int"))
    return P.presence_rates(r, ["high"], ["day"], adjusted=True).select(text("day"), six("high").alias("high"), "n", "n_users")


@query(R + ", d AS (SELECT lang, day, avg(value) AS v, count(*) AS n_reports, count(DISTINCT user_id) AS n_users FROM r GROUP BY 1, 2) SELECT lang, day::VARCHAR AS day, n_reports, n_users FROM d WHERE n_reports < 60 OR n_users < 45")
def disclosure_violations(spark, sf):
    days = P.daily(reports(spark, sf), ["value"]).where("lang <> 'all'")
    return P.violations(days, ["value_mean"], least_reports=60, least_people=45).select("lang", text("day"), "n_reports", "n_users")


@query(DAYS + """, a AS (SELECT *, count(v) OVER w AS m, quantile_cont(v, 0.5) OVER w AS med, list(v) OVER w AS past FROM d WINDOW w AS (PARTITION BY lang ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
  b AS (SELECT lang, day, v, m, med, list_aggregate(list_transform(past, lambda x: abs(x - med)), 'quantile_cont', 0.5) AS mad FROM a) SELECT lang, day::VARCHAR AS day, CASE WHEN m >= 7 AND mad > 0 THEN round((v - med) / (1.4826 * mad), 6) END AS z FROM b""")
def trailing_robust_z(spark, sf):
    days = P.daily(reports(spark, sf), ["value"]).where("lang <> 'all'")
    return W.rolling_z(days, "value_mean", ["lang"], window=14, least=7).select("lang", text("day"), six("z").alias("z"))


@query(DAYS + """, u AS (SELECT lang, day, 'v' AS feature, v AS value FROM d WHERE n_reports >= 20 AND n_users >= 5 UNION ALL SELECT lang, day, 'n', n_reports FROM d WHERE n_reports >= 20 AND n_users >= 5),
  a AS (SELECT *, count(value) OVER w AS m, quantile_cont(value, 0.5) OVER w AS med, list(value) OVER w AS past FROM u WINDOW w AS (PARTITION BY lang, feature ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
  b AS (SELECT *, list_aggregate(list_transform(past, lambda x: abs(x - med)), 'quantile_cont', 0.5) AS mad FROM a), z AS (SELECT *, (value - med) / (1.4826 * mad) AS z FROM b WHERE m >= 14 AND mad > 0)
  SELECT lang, day::VARCHAR AS day, feature, round(value, 6) AS value, round(z, 6) AS z FROM z WHERE abs(z) >= 1.5""")
def anomalous_days(spark, sf):
    days = P.daily(reports(spark, sf), ["value"]).where("lang <> 'all'").withColumns({"v": F.col("value_mean"), "n": F.col("n_reports").cast("double")})
    return W.anomalies(days, ["v", "n"], ["lang"], threshold=1.5).select("lang", text("day"), "feature", six("value").alias("value"), six("z").alias("z"))


@query(ORDERS + """, c AS (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY))::DATE AS day), j AS (SELECT c.day, CASE WHEN n >= 5 THEN v END AS v FROM c LEFT JOIN d USING (day))
  SELECT day::VARCHAR AS day, round(sum(coalesce(v, 0)) OVER (ORDER BY day), 1) AS csum, count(v) OVER (ORDER BY day) AS ccount FROM j""")
def prefix_sums(spark, sf):
    d = daily_orders(spark, sf).withColumn("v", F.when(F.col("n") >= 5, F.col("v")))
    return W.prefix_sums(d, "v").select(text("day"), F.round("csum", 1).alias("csum"), "ccount")


@query(ORDERS + """, p AS (SELECT *, lag(v) OVER (ORDER BY day) AS l FROM d), a AS (SELECT day, count(v) OVER w AS k, var_samp(v / 1000) OVER w AS variance, corr(v, l) OVER p AS ar1 FROM p
  WINDOW w AS (ORDER BY day ROWS BETWEEN 27 PRECEDING AND CURRENT ROW), p AS (ORDER BY day ROWS BETWEEN 26 PRECEDING AND CURRENT ROW)) SELECT day::VARCHAR AS day, CASE WHEN k >= 14 THEN round(variance, 5) END AS variance, CASE WHEN k >= 14 THEN round(ar1, 6) END AS ar1 FROM a""")
def early_warning_indicators(spark, sf):
    d = daily_orders(spark, sf).withColumn("w", F.col("v") / 1000)
    return W.warning_indicators(d, "w").select(text("day"), F.round("variance", 5).alias("variance"), six("ar1").alias("ar1"))


@query(ORDERS + " SELECT day::VARCHAR AS day, CASE WHEN count(v) OVER w >= 20 THEN round(v - quantile_cont(v, 0.5) OVER w, 6) END AS v_dt FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING)")
def local_detrend(spark, sf):
    return W.detrend_local(daily_orders(spark, sf), "v").select(text("day"), six("v_dt").alias("v_dt"))


@query(ORDERS + " SELECT day::VARCHAR AS day, round(avg(v) OVER (ORDER BY day ROWS BETWEEN 27 PRECEDING AND CURRENT ROW), 6) AS m28, round(avg(v) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS c7, round(v - lag(v) OVER (ORDER BY day), 6) AS diff, round(v / lag(v) OVER (ORDER BY day) - 1, 6) AS pct FROM d")
def rolling_means(spark, sf):
    d = W.rolling(W.rolling(daily_orders(spark, sf), "v", 27, name="m28"), "v", 3, 3, name="c7")
    lag = F.lag("v").over(Window.orderBy("day"))
    return d.select(text("day"), six("m28").alias("m28"), six("c7").alias("c7"), six(F.col("v") - lag).alias("diff"), six(F.col("v") / lag - 1).alias("pct"))


@query(ORDERS + """, e AS (SELECT day, CASE WHEN count(v) OVER f = 14 AND count(v) OVER b = 7 THEN avg(v) OVER f - avg(v) OVER b END AS x FROM d WINDOW f AS (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING), b AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
  SELECT day::VARCHAR AS day, round(x, 5) AS excursion FROM e""")
def forward_excursions(spark, sf):
    return W.forward_excursion(daily_orders(spark, sf), "v").select(text("day"), F.round("excursion", 5).alias("excursion"))


@query(ORDERS + """, e AS (SELECT row_number() OVER (ORDER BY day) - 1 AS pos, CASE WHEN count(v) OVER f = 14 AND count(v) OVER b = 7 THEN avg(v) OVER f - avg(v) OVER b END AS x FROM d WINDOW f AS (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING), b AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
  t AS (SELECT list(pos ORDER BY pos) AS p FROM e WHERE x >= (SELECT quantile_cont(x, 0.9) FROM e))
  SELECT unnest(list_reduce(list_transform(p, lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[-1] >= 42 THEN list_concat(a, b) ELSE a END))::INT AS pos FROM t""")
def episode_anchors(spark, sf):
    return W.anchors(daily_orders(spark, sf), "v")


@query(ORDERS + """, t AS (SELECT list(day - DATE '1970-01-01' ORDER BY day) AS p FROM d WHERE n >= (SELECT quantile_cont(n, 0.95) FROM d))
  SELECT (DATE '1970-01-01' + unnest(list_reduce(list_transform(p, lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[-1] >= 28 THEN list_concat(a, b) ELSE a END))::INT)::VARCHAR AS day FROM t""")
def spaced_events(spark, sf):
    d = daily_orders(spark, sf)
    cut = d.agg(F.percentile("n", F.lit(0.95)).alias("cut"))
    return W.space_events(d.crossJoin(F.broadcast(cut)).where("n >= cut")).select(text("day"))


@query(R + ", s AS (SELECT doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, doc_id) - 1 AS rk, count(*) OVER (PARTITION BY user_id) AS n FROM r) SELECT doc_id, rk >= ceil(0.6 * n) AS test FROM s")
def temporal_split(spark, sf):
    return W.split_by_time(reports(spark, sf), "user_id", ["ts", "doc_id"]).select("doc_id", "test")


@query(R + ", f AS (SELECT *, min(day) OVER (PARTITION BY user_id) AS fs FROM r) SELECT doc_id, fs::VARCHAR AS first_seen, day = fs AS is_new, ((year(day) * 4 + quarter(day)) - (year(fs) * 4 + quarter(fs)))::INT AS tenure FROM f")
def first_seen_and_tenure(spark, sf):
    return W.tenure_quarters(W.first_seen(reports(spark, sf))).select("doc_id", text("first_seen"), "is_new", "tenure")


@query(R + ", a AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY value) + (count(*) OVER (PARTITION BY lang, value) - 1) / 2 AS rx, rank() OVER (PARTITION BY lang ORDER BY k) + (count(*) OVER (PARTITION BY lang, k) - 1) / 2 AS ry FROM r WHERE value IS NOT NULL AND k IS NOT NULL) SELECT lang, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM a GROUP BY 1")
def spearman_by_stratum(spark, sf):
    return W.spearman(reports(spark, sf), "value", "k", ["lang"]).select("lang", six("rho").alias("rho"), "n")


ELIGIBLE = ORDERS + ", q AS (SELECT *, row_number() OVER (ORDER BY n, day) AS rk, count(*) OVER () AS m FROM d WHERE n >= 5), el AS (SELECT day, n, v, (isodow(day) - 1)::INT AS weekday, month(day)::INT AS month, (CASE WHEN rk <= 1 + (m - 1) / 3 THEN 0 WHEN rk <= 1 + 2 * (m - 1) / 3 THEN 1 ELSE 2 END)::INT AS tercile FROM q)"


@query(ELIGIBLE + " SELECT day::VARCHAR AS day, weekday, month, tercile FROM el")
def eligible_days(spark, sf):
    return W.eligible_days(daily_orders(spark, sf), "n", least=5).select(text("day"), "weekday", "month", "tercile")


GAPPY = ORDERS + ", g AS (SELECT day, v FROM d WHERE (day - DATE '1970-01-01') % 5 <> 0 AND (day - DATE '1970-01-01') % 7 <> 1), c AS (SELECT unnest(generate_series((SELECT min(day) FROM g), (SELECT max(day) FROM g), INTERVAL 1 DAY))::DATE AS day), j AS (SELECT c.day, g.v FROM c LEFT JOIN g USING (day))"


def gappy(spark, sf):
    e = F.datediff("day", F.lit("1970-01-01").cast("date"))
    return daily_orders(spark, sf).where((e % 5 != 0) & (e % 7 != 1)).select("day", "v")


@query(GAPPY + """, k AS (SELECT day, v, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER a AS v1, last_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER b AS d0, first_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER a AS d1
  FROM j WINDOW b AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT day::VARCHAR AS day, v IS NOT NULL AS observed, round(CASE WHEN v IS NOT NULL THEN v ELSE v0 + (v1 - v0) * (day - d0) / (d1 - d0) END, 6) AS filled FROM k""")
def gap_interpolation(spark, sf):
    return W.filled(gappy(spark, sf), "v").select(text("day"), "observed", six("filled").alias("filled"))


@query(GAPPY + " SELECT day::VARCHAR AS day, round(last_value(v IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS v FROM j")
def step_fill_limited(spark, sf):
    return W.step_fill(gappy(spark, sf), "v", limit=1).select(text("day"), six("v").alias("v"))


@query(R + ", o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY ts, doc_id) AS n, (row_number() OVER (PARTITION BY lang, user_id ORDER BY ts, doc_id) = 1)::INT AS f FROM r), p AS (SELECT lang, n, sum(f) OVER (PARTITION BY lang ORDER BY n) AS u FROM o) SELECT lang, min(n) FILTER (n >= 20 AND u >= 15) AS min_prefix FROM p GROUP BY 1")
def disclosure_prefix(spark, sf):
    return W.shortest_prefix(reports(spark, sf), ["ts", "doc_id"], least_people=15, by=["lang"])


@query("WITH p AS (SELECT c_custkey AS id, c_nationkey AS fam, (c_custkey * 7919 % 1000 + 0.5) / 1000 AS p FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p) AS rk, count(*) OVER (PARTITION BY fam) AS m FROM p) SELECT id, round(least(1, min(p * m / rk) OVER (PARTITION BY fam ORDER BY rk DESC)), 6) AS q FROM r")
def fdr_by_family(spark, sf):
    p = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("fam"), ((F.col("c_custkey") * 7919 % 1000 + 0.5) / 1000).alias("p"))
    return stats.benjamini_hochberg(p, family=["fam"]).select("id", six("q").alias("q"))


@query("""WITH f AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'event_study' ELSE 'coupling' END AS category, c_acctbal / 1000 AS effect, (c_custkey * 7919 % 1000 + 0.5) / 1000 AS q FROM customer), i AS (SELECT *, abs(effect) * -log10(least(greatest(q, 1e-6), 1)) * CASE WHEN category = 'event_study' THEN 1.2 ELSE 1.0 END AS impact FROM f)
  SELECT id, round(impact, 6) AS impact, row_number() OVER (ORDER BY impact DESC, id, category)::INT AS rank, round(100 * impact / max(impact) OVER (), 1) AS impact_0_100, CASE WHEN q < 0.05 THEN 'headline (q<0.05)' WHEN q < 0.20 THEN 'suggestive (q<0.20)' ELSE 'not significant' END AS tier FROM i""")
def ranked_findings(spark, sf):
    f = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "event_study").otherwise("coupling").alias("category"), (F.col("c_acctbal") / 1000).alias("effect"), ((F.col("c_custkey") * 7919 % 1000 + 0.5) / 1000).alias("q"))
    return W.ranked_findings(f).select("id", six("impact").alias("impact"), "rank", "impact_0_100", stats.tier(F.col("q")).alias("tier"))


@query(R + ", c AS (SELECT lang, user_id, count(*) AS n FROM r GROUP BY 1, 2) SELECT a.user_id AS user_id FROM c a JOIN c b USING (user_id) WHERE a.lang = 'click' AND b.lang = 'error' AND a.n >= 3 AND b.n >= 3")
def people_intersection(spark, sf):
    c = reports(spark, sf).groupBy("lang", "user_id").count().where("count >= 3")
    return c.where("lang = 'click'").select("user_id").intersect(c.where("lang = 'error'").select("user_id"))


@query(R + " SELECT DISTINCT user_id, day::VARCHAR AS day FROM r WHERE lang = 'click' EXCEPT SELECT DISTINCT user_id, day::VARCHAR FROM r WHERE lang = 'view'")
def days_without_views(spark, sf):
    r = reports(spark, sf).select("user_id", text("day"), "lang")
    return r.where("lang = 'click'").select("user_id", "day").distinct().exceptAll(r.where("lang = 'view'").select("user_id", "day").distinct())


@query(R + ", d AS (SELECT day, avg(value) AS v FROM r GROUP BY day) SELECT day::VARCHAR AS day, round(v, 6) AS v FROM d ORDER BY v DESC, day LIMIT 8")
def peak_days(spark, sf):
    return reports(spark, sf).groupBy("day").agg(F.avg("value").alias("v")).orderBy(F.desc("v"), "day").limit(8).select(text("day"), six("v").alias("v"))
