"""Queries on statistics against nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import stats
from ..operators import events as E
from ..operators import geometry as Geo
from ..operators import nulls as N
from ..operators import permutations as M
from ..operators import replicates as Rep
from ..operators import sampling as S
from ..operators import windows as W
from ..sources.shared import saved
from ..sources.tables import daily_orders, read, reports, six
from .events import SPACED, events
from .panel import ORDERS, R, text
from .registry import query
from .text import trajectories
from .vectors import FEATURES, features


def units(spark, sf):
    """A day's unit vectors: events' values put on a circle, one contributor and day each."""
    r = reports(spark, sf).groupBy("user_id", "day").agg(F.avg("value").alias("v"))
    a = F.col("v") / 50
    return r.select("day", F.col("user_id").alias("unit_id"), F.array(F.cos(a), F.sin(a)).alias("u"))


@query()
def synchrony_against_near_days(spark, sf):
    return Rep.synchrony(units(spark, sf), "u", 2, within=14, same_weekday=False)


@query()
def synchrony_summary(spark, sf):
    """Excess over days: combined z, sign test, both tails of the days' p against chance and by blocks of days."""
    return Rep.excess_of_days(Rep.synchrony(units(spark, sf), "u", 2, within=14, same_weekday=False), "day")


@query()
def distribution_dynamics(spark, sf):
    return N.distribution_dynamics(reports(spark, sf), "value", "day", "user_id")


@query()
def corpus_contrast(spark, sf):
    """Author means of drift, two sets of sources."""
    d = trajectories(spark, sf).select("source", (F.element_at("v", -1) - F.element_at("v", 1)).alias("x")).groupBy("source").agg(F.avg("x").alias("x"))
    return N.contrast(d.where("source < 'src15'"), d.where("source >= 'src15'"), "x")


@query()
def matched_contrast_over_seeds(spark, sf):
    """The contrast of two sets of sources' trajectories at equal numbers of sentences: median and range over 50 matchings, 1,000 bootstraps each."""
    t = trajectories(spark, sf).select("doc_id", "source", (F.col("source") < "src15").cast("int").alias("side"), F.size("v").alias("k"), (F.element_at("v", -1) - F.element_at("v", 1)).alias("x"))
    t = saved(t, "matched-trajectories")  # sizes, places and rows are taken from it apart
    return Rep.over_seeds(Rep.matched_over_seeds(t, "doc_id", "side", "k", "source", "x"))


def baskets(spark, sf):
    """Orders with what their lines amount to, whether they are urgent, and their month."""
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("lines"), F.sum("l_quantity").cast("double").alias("quantity"), F.avg("l_discount").cast("double").alias("discount"), F.avg("l_tax").cast("double").alias("tax"))
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), (F.substring("o_orderpriority", 1, 1) <= "2").cast("int").alias("urgent"), F.date_trunc("month", "o_orderdate").cast("date").alias("month"))
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query()
def network_contrast(spark, sf):
    """Which rank correlations of orders differ between urgent and other ones, by the greatest difference of 300 relabellings within months."""
    return M.network_contrast(baskets(spark, sf), ["price", "lines", "quantity", "discount", "tax"], "o_orderkey", "urgent", "month")


@query()
def weekday_label_permutation(spark, sf):
    return N.date_block_permutation(reports(spark, sf), "value", "day")


@query()
def warning_pipeline(spark, sf):
    """Mean tau over run-ups against 1,000 surrogates of each of five families, q over the indicators of a family."""
    return stats.benjamini_hochberg(N.warning_pipeline(N.warning_draws(daily_orders(spark, sf), "v")), family=["family"])


@query()
def episode_jackknife(spark, sf):
    """The same with each episode left out, under every family."""
    d = daily_orders(spark, sf)
    return N.episode_jackknife(d, N.warning_draws(d, "v"), "v")


@query()
def rotated_network(spark, sf):
    """The scalars of rolling networks against 120 turns of the values round the calendar."""
    r = reports(spark, sf).withColumns({"hour": F.hour("ts").cast("double"), "high": (F.col("value") > 30).cast("double")})
    return Geo.rotated_networks(r, ["value", "k", "hour", "high"], "doc_id", "day", "user_id", 10, 5, 100)


@query()
def arc_order_control(spark, sf):
    """Principal shapes of trajectories beside those of the same sentences in random order."""
    return Geo.arc_order_control(trajectories(spark, sf, 5), "doc_id", "v")


@query()
def geometry_against_nulls(spark, sf):
    """Dimension and percolation of the vectors over five seeds, beside shuffled and Gaussian copies."""
    return Geo.against_nulls(read(spark, sf, "embeddings"), "vec_id", "embedding", 64)


@query()
def arc_modes(spark, sf):
    return N.arc_modes(trajectories(spark, sf, 5).select(A.resample(F.col("v")).alias("arc")), "arc", 20)


@query("WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents), f AS (SELECT token, min(doc_id) AS o FROM t GROUP BY 1), n AS (SELECT o, count(*) AS new FROM f GROUP BY 1), s AS (SELECT doc_id AS o, count(*) AS n FROM t GROUP BY 1), r AS (SELECT sum(n) OVER (ORDER BY o) AS n, sum(coalesce(new, 0)) OVER (ORDER BY o) AS v FROM s LEFT JOIN n USING (o)) SELECT round(regr_slope(ln(v), ln(n)), 6) AS exponent, count(*) AS documents FROM r WHERE n >= 100")
def heaps_exponent(spark, sf):
    t = read(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("token"), F.lit(1).alias("freq"))  # a row a token: tasks count before anything moves
    return N.heaps(t, ["doc_id"]).select(six("exponent").alias("exponent"), "documents")


@query("WITH w AS (SELECT lang, len(string_split(text, ' ')) AS k FROM documents WHERE text IS NOT NULL), l AS (SELECT lang, k, ln(k) AS l FROM w), m AS (SELECT lang, avg(l) AS mu, stddev_pop(l) AS sigma, quantile_cont(k, 0.5) AS median, avg(k) AS mean, count(*) AS n FROM l GROUP BY 1) SELECT m.lang, round(any_value(mu), 6) AS mu, round(any_value(sigma), 6) AS sigma, round(avg((l - mu) ** 3) / any_value(sigma) ** 3, 5) AS skewness, any_value(median)::DOUBLE AS median, round(any_value(mean), 6) AS mean, any_value(n) AS n FROM m JOIN l USING (lang) GROUP BY 1")
def lognormal_length(spark, sf):
    """Lengths of texts in words by language, as a log-normal size."""
    d = read(spark, sf, "documents").where("text IS NOT NULL").select("lang", F.size(F.split("text", " ")).alias("k"))
    return N.lognormal(d, "k", ["lang"]).select("lang", six("mu").alias("mu"), six("sigma").alias("sigma"), F.round("skewness", 5).alias("skewness"), "median", six("mean").alias("mean"), "n")


@query()
def shift_associations(spark, sf):
    """Distance correlation and mutual information of the axes with the indicators by month, against 200 circular shifts."""
    from ..operators import coupling as C
    from .dynamics import family

    pairs = family(spark, sf).where("freq = 'month'").drop("freq")
    return C.surrogate_scan(pairs, ["signal", "indicator"], ("dcor", "mi"), ("shift",), refine=200)


@query("WITH c AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), g AS (SELECT user_id, avg(n) AS m, var_samp(n) AS v FROM c GROUP BY 1 HAVING count(*) >= 5 AND var_samp(n) > 0) SELECT round(regr_slope(ln(v), ln(m)), 6) AS exponent, count(*) AS items FROM g")
def taylor_exponent(spark, sf):
    c = reports(spark, sf).groupBy("user_id", "day").agg(F.count("*").alias("n"))
    return N.taylor(c, "user_id", "n").select(six("exponent").alias("exponent"), "items")


@query()
def expanding_dispersion(spark, sf):
    e = read(spark, sf, "embeddings").withColumn("period", F.floor(F.col("vec_id") / 50))
    d = N.expanding(e, "embedding", "period", "vec_id", 30, 3)
    return N.slope_over_shifts(d, "dispersion", "period")


@query("WITH w AS (SELECT date_trunc('month', o_orderdate)::DATE AS m, avg(o_totalprice) AS v FROM orders GROUP BY 1), s AS (SELECT row_number() OVER (ORDER BY m) - 1 AS t, v, count(*) OVER () AS n FROM w), h AS (SELECT sh, regr_slope(v, (t + sh) % n) AS b FROM s CROSS JOIN (SELECT unnest(range(0, (SELECT count(*) FROM w))) AS sh) GROUP BY 1) SELECT round((SELECT b FROM h WHERE sh = 0), 4) AS slope, round(avg((abs(b) >= abs((SELECT b FROM h WHERE sh = 0)) - 1e-12)::INT), 6) AS p, count(*) AS n FROM h")
def circular_slope_p(spark, sf):
    m = read(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.avg("o_totalprice").alias("v"))
    return N.slope_over_shifts(m, "v", "m").select(F.round("slope", 4).alias("slope"), six("p").alias("p"), "n")


@query()
def rolling_network(spark, sf):
    r = reports(spark, sf).withColumns({"hour": F.hour("ts").cast("double"), "high": (F.col("value") > 30).cast("double")})
    return N.rolling_network(r, ["value", "k", "hour", "high"], "day", "user_id", 10, 5, 100)


@query()
def injected_event_power(spark, sf):
    return N.injected_power(daily_orders(spark, sf), events(spark, sf), "v", [0.0, 3000.0, 6000.0, 12000.0, 24000.0])


@query(SPACED + ", s AS (SELECT unnest(range(-252, 253, 7))::INT AS s) SELECT (ev.day + s)::VARCHAR AS day, s AS shift FROM ev, s WHERE abs(s) >= 28")
def shifted_anchor_families(spark, sf):
    s = events(spark, sf).select("day", F.explode(F.sequence(F.lit(-252), F.lit(252), F.lit(7))).alias("shift")).where(F.abs("shift") >= 28)
    return s.select(F.date_add("day", F.col("shift")).cast("string").alias("day"), "shift")


@query("WITH c AS (SELECT c_mktsegment AS family, c_nationkey AS yr FROM customer) SELECT family, yr, count(*) AS n FROM c GROUP BY 1, 2")
def event_counts(spark, sf):
    return read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("family"), F.col("c_nationkey").alias("yr")).agg(F.count("*").alias("n"))


@query("SELECT o.o_orderkey, CASE WHEN 2026 - (1950 + c.c_nationkey * 4) BETWEEN 8 AND 100 THEN 2026 - (1950 + c.c_nationkey * 4) END::DOUBLE AS age, CASE WHEN lower(c.c_mktsegment) IN ('building', 'machinery') THEN lower(c.c_mktsegment) ELSE 'other' END AS grp FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
def demographic_join(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), (2026 - (1950 + F.col("c_nationkey") * 4)).alias("age"), F.lower("c_mktsegment").alias("seg"))
    j = read(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left")
    return j.select("o_orderkey", F.when(F.col("age").between(8, 100), F.col("age")).cast("double").alias("age"), F.when(F.col("seg").isin("building", "machinery"), F.col("seg")).otherwise("other").alias("grp"))


@query(R + ", q AS (SELECT lang, quantile_cont(value, 0.75) AS cut, day FROM r GROUP BY lang, day) SELECT r.day::VARCHAR AS day, r.lang, round(avg((value >= cut)::INT), 6) AS share, count(*) AS n FROM r JOIN q ON q.day = r.day AND q.lang = r.lang GROUP BY 1, 2")
def own_quartile_share(spark, sf):
    r = reports(spark, sf)
    q = r.groupBy("day", "lang").agg(F.percentile("value", F.lit(0.75)).alias("cut"))
    return r.join(q, ["day", "lang"]).groupBy(text("day"), "lang").agg(six(F.avg((F.col("value") >= F.col("cut")).cast("int"))).alias("share"), F.count("*").alias("n"))


@query("WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY (doc_id * 2654435761 + 2 * 40503) % 4294967296, doc_id) AS n FROM documents), l AS (SELECT length(text) AS len, row_number() OVER (ORDER BY (item_id * 2654435761 + 2 * 40503) % 4294967296, item_id) AS n FROM benchmark) SELECT doc_id, least(length(text), len)::INT AS n_chars FROM d JOIN l ON (d.n - 1) % (SELECT count(*) FROM l) + 1 = l.n")
def length_matched_texts(spark, sf):
    """Documents cut to lengths dealt in turn from another corpus, by hashed ranks. Ranks are made from ids by ranges; texts don't move for them."""
    docs, items = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    d = S.numbered(docs, "doc_id", [S.order_of("doc_id", 2), F.col("doc_id")])
    b = S.numbered(items.select("item_id", F.char_length("text").alias("len")), "item_id", [S.order_of("item_id", 2), F.col("item_id")], ["len"])
    size = b.count()
    dealt = d.withColumn("turn", F.pmod(F.col("number") - 1, F.lit(size)) + 1).join(b.select(F.col("number").alias("turn"), "len"), "turn")
    return docs.select("doc_id", "text").join(dealt, "doc_id").select("doc_id", F.char_length(F.substring(F.col("text"), F.lit(1), F.col("len"))).alias("n_chars"))


@query()
def cluster_labels(spark, sf):
    """Clusters of documents by text statistics: size, share of English, mean vowel share."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    # a text without characters, or none at all, counts as zeros
    known = features(spark, sf).withColumns({c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) for c in FEATURES})
    f = known.select("doc_id", "lang", "vowels", array_to_vector(F.array(*(F.col(c) / (1 + F.abs(F.col(c))) for c in FEATURES))).alias("features"))
    g = KMeans(k=4, seed=0, maxIter=15).fit(f).transform(f)
    return g.groupBy("prediction").agg(F.count("*").alias("n"), F.avg((F.col("lang") == "en").cast("int")).alias("en_share"), F.avg("vowels").alias("vowels"))


@query(ORDERS + ", l AS (SELECT day, n, lag(n) OVER (ORDER BY day) AS p FROM d) SELECT round(corr(n, p), 6) AS r, count(p) AS n FROM l")
def lag_one_of_counts(spark, sf):
    from pyspark.sql import Window

    d = daily_orders(spark, sf).withColumn("p", F.lag("n").over(Window.orderBy("day")))
    return d.agg(six(F.corr("n", "p")).alias("r"), F.count("p").alias("n"))


@query(SPACED + ", el AS (SELECT day, v FROM d WHERE n >= 5), x AS (SELECT ev.day AS event, (SELECT avg(v) FROM el WHERE el.day BETWEEN ev.day + 1 AND ev.day + 7) - (SELECT avg(v) FROM el WHERE el.day BETWEEN ev.day - 21 AND ev.day - 4) AS e FROM ev JOIN el USING (day)), k AS (SELECT * FROM x WHERE e IS NOT NULL) SELECT event::VARCHAR AS event, round((sum(e) OVER () - e) / (count(*) OVER () - 1), 2) AS mean_of_others FROM k")
def leave_one_event_out(spark, sf):
    """Each event's weight: the mean effect without it."""
    e = E.event_effects(daily_orders(spark, sf), events(spark, sf), "v", least=5).where("effect IS NOT NULL")
    return W.loo_deviation(e.withColumn("one", F.lit(1)), "effect", "one").select(text("event"), F.round(F.col("effect") - F.col("dev"), 2).alias("mean_of_others"))
