"""Queries on calendars, regressions, variance components, sources and streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import calendar as Cal
from ..functions import text as X
from ..operators import inference as I
from ..sources import readers as S
from ..sources.shared import saved
from ..sources.tables import daily_orders, read, reports, six
from ..streaming import panels as St
from .panel import ORDERS, R, text
from .registry import query

DOW = ", ".join(f"(isodow(day) = {k + 1})::INT::DOUBLE AS dow{k}" for k in range(1, 7))
HARM = ", ".join(f"round({f}(2 * pi() * {k} * dayofyear(day) / 365.25), 6) AS {n}{k}" for k in (1, 2) for n, f in (("s", "sin"), ("c", "cos")))


@query("WITH y AS (SELECT unnest(range(1990, 2030))::INT AS y), t AS (SELECT y, make_date(y, 11, 1) AS a, make_date(y, 5, 31) AS b, make_date(y, 3, 1) AS c FROM y) SELECT y, (a + ((4 - isodow(a) + 7) % 7 + 21)::INT)::VARCHAR AS thanks, (b - ((isodow(b) - 1) % 7)::INT)::VARCHAR AS memorial, (c + ((7 - isodow(c)) % 7 + 7)::INT)::VARCHAR AS spring FROM t")
def moving_holidays(spark, sf):
    y = spark.range(1990, 2030).select(F.col("id").cast("int").alias("y"))
    return y.select("y", Cal.nth_weekday(F.col("y"), 11, 3, 3).cast("string").alias("thanks"), Cal.nth_weekday(F.col("y"), 5, 0, -1).cast("string").alias("memorial"), Cal.nth_weekday(F.col("y"), 3, 6, 1).cast("string").alias("spring"))


@query(ORDERS + f", x AS (SELECT *, (day - min(day) OVER ())::DOUBLE AS t FROM d) SELECT day::VARCHAR AS day, round((t - avg(t) OVER ()) / (stddev_pop(t) OVER () + 1e-9), 6) AS trend, round(ln(n) - avg(ln(n)) OVER (), 6) AS logn, {HARM}, {DOW} FROM x")
def calendar_design(spark, sf):
    c = Cal.calendar_design(daily_orders(spark, sf), n="n")
    return c.select(text("day"), six("trend").alias("trend"), six("logn").alias("logn"), *(six(f"{n}{k}").alias(f"{n}{k}") for k in (1, 2) for n in "sc"), *(f"dow{k}" for k in range(1, 7)))


@query(ORDERS + """, h AS (SELECT day, (month(day), day(day)) IN ((1, 1), (7, 4), (12, 24), (12, 25), (12, 26), (12, 31)) OR (month(day) = 11 AND isodow(day) = 4 AND day(day) BETWEEN 22 AND 28) OR (month(day) = 9 AND isodow(day) = 1 AND day(day) <= 7) OR (month(day) = 5 AND isodow(day) = 1 AND day(day) >= 25) AS hol,
  month(day) = 3 AND day - (make_date(year(day), 3, 8) + ((7 - isodow(make_date(year(day), 3, 8))) % 7)::INT) BETWEEN 0 AND 6 AS spring, month(day) = 11 AND day - (make_date(year(day), 11, 1) + ((7 - isodow(make_date(year(day), 11, 1))) % 7)::INT) BETWEEN 0 AND 6 AS fall FROM d)
  SELECT day::VARCHAR AS day, hol::INT::DOUBLE AS holiday, spring::INT::DOUBLE AS dst_spring, fall::INT::DOUBLE AS dst_fall, (month(day) IN (7, 8))::INT::DOUBLE AS summer FROM h""")
def social_calendar(spark, sf):
    return Cal.social_design(daily_orders(spark, sf), "en").select(text("day"), "holiday", "dst_spring", "dst_fall", "summer")


@query("WITH d AS (SELECT o_orderdate::DATE AS day FROM orders) SELECT DISTINCT day::VARCHAR AS day, date_trunc('week', day)::DATE::VARCHAR AS w, date_trunc('month', day)::DATE::VARCHAR AS m, date_trunc('quarter', day)::DATE::VARCHAR AS q FROM d")
def period_keys(spark, sf):
    d = daily_orders(spark, sf)
    return d.select(text("day"), *(Cal.period(F.col("day"), u).cast("string").alias(u.lower()) for u in "WMQ"))


@query(R + ", m AS (SELECT value - avg(value) OVER (PARTITION BY user_id) AS y, k - avg(k) OVER (PARTITION BY user_id) AS x, value, k FROM r) SELECT round(regr_slope(value, k), 6) AS raw, round(regr_slope(y, x), 6) AS within, count(*) AS n FROM m")
def slope_with_fixed_effects(spark, sf):
    s = I.slope_within(reports(spark, sf), "value", "k", ["user_id"])
    return s.select(six("raw").alias("raw"), six("within").alias("within"), "n")


@query(R + """, z AS (SELECT avg(value) AS my, avg(k) AS mx, regr_slope(value, k) AS b, regr_intercept(value, k) AS a, count(*) AS n, regr_sxx(value, k) AS sxx FROM r), e AS (SELECT user_id, value - a - b * k AS e, k - mx AS xc FROM r, z), g AS (SELECT user_id, sum(xc * e) AS s FROM e GROUP BY 1)
  SELECT round(any_value(b), 6) AS beta, round(sqrt(sum(s * s) / any_value(sxx) ** 2 * (count(*) / (count(*) - 1)) * ((any_value(n) - 1) / (any_value(n) - 2))), 6) AS se FROM g, z""")
def person_clustered_slope(spark, sf):
    d = reports(spark, sf).withColumn("one", F.lit(1.0))
    return I.clustered(d, "value", ["one", "k"], [["user_id"]]).where("term = 'k'").select(six("beta").alias("beta"), six("se_0").alias("se"))


@query()
def weekday_contrast_two_way(spark, sf):
    """Friday against Monday, with errors by person, by day and by both."""
    d = reports(spark, sf).where(F.weekday("day").isin(0, 4)).withColumns({"one": F.lit(1.0), "friday": (F.weekday("day") == 4).cast("double")})
    return I.clustered(d, "value", ["one", "friday"], [["user_id"], ["day"]])


@query()
def weekday_joint_f(spark, sf):
    d = Cal.calendar_design(reports(spark, sf).groupBy("day").agg(F.avg("value").alias("v")))
    return I.design_f(d, "v", ["trend", *(f"dow{k}" for k in range(1, 7))], [f"dow{k}" for k in range(1, 7)])


@query()
def two_way_fixed_effects(spark, sf):
    return I.two_way_effects(reports(spark, sf), "value", "user_id", "day", 30, 1e-8)


@query()
def deseasonalised_residual(spark, sf):
    d = read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("v"))
    return I.daily_residual(d, "v", least=3).select(text("day"), "resid", "observed")


@query(R + ", a AS (SELECT (lang = 'error')::INT AS g, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rk FROM r), s AS (SELECT count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n0, sum(rk) FILTER (g = 1) AS r1 FROM a) SELECT n1, n0, round(r1 - n1 * (n1 + 1) / 2, 6) AS u, round(2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n0) - 1, 6) AS rank_biserial FROM s")
def rank_sum(spark, sf):
    r = reports(spark, sf).withColumn("g", (F.col("lang") == "error").cast("int"))
    return I.rank_sum(r, "value", "g").select("n1", "n0", six("u").alias("u"), six("rank_biserial").alias("rank_biserial"))


@query(R + ", p AS (SELECT user_id, avg(value) FILTER (lang = 'click') - avg(value) FILTER (lang = 'view') AS gap FROM r GROUP BY 1), a AS (SELECT gap, rank() OVER (ORDER BY abs(gap)) + (count(*) OVER (PARTITION BY abs(gap)) - 1) / 2 AS rk FROM p WHERE gap IS NOT NULL AND gap <> 0) SELECT count(*) AS n, round(sum(CASE WHEN gap > 0 THEN rk ELSE 0 END), 6) AS w_plus FROM a")
def within_person_gap(spark, sf):
    p = I.gap_of_means(reports(spark, sf), "user_id", "lang", "value", "click", "view")
    return I.signed_rank(p, "gap").select("n", six("w_plus").alias("w_plus"))


@query()
def collective_wave(spark, sf):
    """First component of three standardised weekly series."""
    o = read(spark, sf, "orders")
    w = o.groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.avg("o_totalprice").alias("a"), F.count("*").cast("double").alias("b"), F.sum("o_totalprice").alias("c"))
    return I.first_component(w, "week", ["a", "b", "c"], "b").select(text("week"), "wave")


@query()
def arc_clusters(spark, sf):
    """Six clusters of resampled trajectories, by size and mean ends."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from ..functions import arrays as A
    from .text import trajectories

    arcs = trajectories(spark, sf, 5).select("doc_id", A.resample(F.col("v")).alias("arc"))
    flat = A.let(F.col("arc"), lambda v: A.let(A.mean(v), lambda m: F.transform(v, lambda x: x - m)))
    # fitting passes over the arcs many times: texts are cut into sentences once
    shaped = saved(arcs.select("doc_id", "arc", flat.alias("flat")), "arcs").select("doc_id", "arc", array_to_vector("flat").alias("features"))
    model = KMeans(k=6, seed=0, maxIter=20).fit(shaped)
    return model.transform(shaped).groupBy("prediction").agg(F.count("*").alias("n"), F.avg(F.element_at("arc", -1) - F.element_at("arc", 1)).alias("drift"))


#: Features that grams are hashed to, and directions kept.
GRAM_FEATURES, GRAM_DIRECTIONS = 40_000, 50


@query()
def char_ngram_spectrum(spark, sf):
    """Character 3- to 5-grams of whole texts, weighted by inverse document frequency, on 50 leading directions, weights and directions
    fitted on four fifths of the documents: by source, how much of held-out texts the directions hold."""
    import numpy as np

    from ..operators import vectors as V
    from ..operators.sampling import fold
    from ..sources.shared import saved

    d = read(spark, sf, "documents").where("doc_id IS NOT NULL").select("doc_id", "source", fold("doc_id", 5).alias("fold"), "text")
    grams = saved(V.gram_rows(d, ["source", "fold"], "text", GRAM_FEATURES, packed=True), "grams").where("length(grams) > 0")
    train = grams.where("fold <> 0")
    n, seen = train.count(), V.texts_with(train, GRAM_FEATURES)
    idf = np.where(seen > 0, np.log((1 + n) / (1 + seen)) + 1, 0.0)
    _, basis = V.leading_directions_of_rows(train, idf, GRAM_DIRECTIONS)
    basis = np.ascontiguousarray(basis.astype(np.float32).T)

    def held(batches):
        import pyarrow as pa

        for part, code, f, w in V.weighed_grams(batches, idf):
            p = V.products(basis, code, f, w, len(part))
            known = pa.array(np.bincount(code, w * w, len(part)) > 0)
            yield pa.RecordBatch.from_arrays([part.column("source").filter(known), pa.array((p * p).sum(0)).filter(known)], names=["source", "held"])

    each = grams.where("fold = 0").select("source", "grams").mapInArrow(held, "source string, held double")
    return each.groupBy("source").agg(F.count("*").alias("n"), F.avg("held").alias("held"))


@query("SELECT count(*) AS n, count(*) FILTER (regexp_matches(text, '(?i)\\bn\\s*=\\s*1\\b')) AS single FROM documents")
def text_tripwire(spark, sf):
    d = read(spark, sf, "documents")
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(r"(?i)\bn\s*=\s*1\b")).alias("single"))


# ---- sources -------------------------------------------------------------------------------------


@query("SELECT 'documents' AS corpus, doc_id::VARCHAR AS doc_id, source AS author FROM documents WHERE length(text) >= 300 AND NOT regexp_matches(source, '^src1') AND source <> 'src2' UNION ALL SELECT 'benchmark', item_id::VARCHAR, 'items' FROM benchmark WHERE length(text) >= 60")
def corpus_union(spark, sf):
    d = S.individuals(read(spark, sf, "documents"), "source", "^src1", ["src2"])
    b = read(spark, sf, "benchmark").withColumn("who", F.lit("items"))
    return S.union([S.corpus(d, "documents", "doc_id", "source", "text", 300), S.corpus(b, "benchmark", "item_id", "who", "text", 60)]).drop("text")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY substr(text, 1, 120)")
def distinct_beginnings(spark, sf):
    return S.distinct_prefix(read(spark, sf, "documents"), "text", "doc_id").select("doc_id")


@query(r"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '^(=+.*=+|#+ .*)$')) AS l FROM documents), c AS (SELECT doc_id, l, list_transform(range(len(l)), lambda i: coalesce(list_sum(list_transform(l[1:i], lambda y: length(y))), 0)) AS before FROM l) SELECT doc_id, array_to_string(list_filter(l, lambda x, i: i <= 3 AND before[i] < 400), chr(10)) AS lead FROM c")
def lead_sections(spark, sf):
    return read(spark, sf, "documents").select("doc_id", S.lead_section(F.col("text")).alias("lead"))


@query(r"WITH p AS (SELECT doc_id, regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n') AS a FROM documents), q AS (SELECT doc_id, unnest(range(len(a)))::INT AS pos, trim(regexp_replace(unnest(a), '\s+', ' ', 'g'), ' ') AS text FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM q WHERE length(text) >= 300 AND length(text) - length(replace(text, ' ', '')) > 30) SELECT doc_id, pos, text FROM k WHERE n <= 3")
def capped_paragraphs(spark, sf):
    d = read(spark, sf, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return S.capped_paragraphs(d, "doc_id", "text", 3)


@query("SELECT l.doc_id, l.toxic, coalesce(length(d.text), 0)::INT AS n FROM (SELECT doc_id + (doc_id % 3 = 0)::INT * 1000000 AS doc_id, toxic FROM labels) l LEFT JOIN documents d USING (doc_id)")
def text_lookup(spark, sf):
    lab = read(spark, sf, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 3 == 0, 1000000).otherwise(0)).alias("doc_id"), "toxic")
    return S.looked_up(lab, read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "toxic", F.char_length("text").alias("n"))


@query("WITH k AS (SELECT doc_id, sha1(text) AS key FROM documents) SELECT key, min(doc_id) AS first FROM k WHERE key NOT IN (SELECT sha1(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1")
def cache_misses(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", S.content_key(F.col("text")).alias("key"))
    return S.missing(d.groupBy("key").agg(F.min("doc_id").alias("first")), d.where("doc_id % 2 = 0").select("key").distinct(), "key")


# ---- streams, run to their end over the tables as they are -----------------------------------------


def drained(frame, name: str, mode: str = "complete"):
    """The result of a stream that runs to its end; see streaming.panels.drained."""
    return St.drained(frame, name, mode)


def event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('day', ts)::DATE::VARCHAR AS start, event_type, round(avg(value), 6) AS value_mean, count(*) AS n_reports FROM events GROUP BY 1, 2")
def streamed_days(spark, sf):
    t = drained(St.tumbling(St.timed(event_stream(spark, sf)), "value", "event_type"), "streamed_days")
    return t.select(F.to_date("start").cast("string").alias("start"), "event_type", six("value_mean").alias("value_mean"), "n_reports")


@query("SELECT date_trunc('week', ts)::DATE::VARCHAR AS start, event_type, round(avg(value), 6) AS value_mean, count(*) AS n_reports FROM events GROUP BY 1, 2")
def streamed_weeks(spark, sf):
    t = drained(St.tumbling(St.timed(event_stream(spark, sf)), "value", "event_type", "7 days"), "streamed_weeks")
    return t.select(F.to_date("start").cast("string").alias("start"), "event_type", six("value_mean").alias("value_mean"), "n_reports")


@query("WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT user_id, ts, sum((p IS NULL OR ts - p >= INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM l) SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS n FROM (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1")
def session_counts(spark, sf):
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return St.sessions(e).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query()
def streamed_anomalies(spark, sf):
    e = event_stream(spark, sf).select("event_type", "ts", "value")
    return drained(St.trailing_z(e, "event_type", "value"), "streamed_anomalies", "append")
