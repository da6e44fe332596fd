"""Queries over texts: languages, sentences, lexicons, trajectories, overlap, samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..operators import inference as I
from ..operators import records as R2
from ..operators import sampling as S
from ..operators import vectors as V
from ..operators import windows as W
from ..sources.tables import eight, read, reports
from .panel import R
from .registry import query

#: What tells a trajectory from its reverse.
ORDER = ("slope", "half", "ends", "argmax", "argmin")
#: Presence patterns that these invented languages can meet.
COMMON = {"article": r"\b(the|der|die|das|le|la)\b", "joiner": r"\b(and|und|et)\b", "of": r"\b(of|von|de)\b"}
SENT = r"""WITH s AS (SELECT doc_id, source, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?…])\s+', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))),
  lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) >= 2) AS t FROM documents), e AS (SELECT doc_id, source, unnest(range(len(t)))::INT AS pos, substr(unnest(t), 1, 200) AS text FROM s)"""
#: A sentence's value: the share of its letters that are vowels, less a third.
VALUE = "(len(regexp_extract_all(lower(text), '[aeiou]')) / greatest(len(regexp_extract_all(lower(text), '[a-z]')), 1) - 0.33)"
TRAJ = SENT + f", v AS (SELECT doc_id, source, list({VALUE} ORDER BY pos) AS v, count(*) AS k FROM e GROUP BY 1, 2 HAVING count(*) >= 4)"


def sentences(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", "source", F.posexplode(X.sentences(F.col("text"))).alias("pos", "text"))


def value(text):
    def count(t, characters: str):
        return F.char_length(t) - F.char_length(F.translate(t, characters, ""))

    return A.let(F.lower(text), lambda t: count(t, "aeiou") / F.greatest(count(t, "abcdefghijklmnopqrstuvwxyz"), F.lit(1)) - 0.33)


def trajectories(spark, sf, least=4):
    """doc_id, source and v: each document's sentence values in order. One row holds one document's sentences.

    The array goes through a generator of one row: a filter on it is not pushed below, so texts are cut into sentences once.
    """
    d = read(spark, sf, "documents").select("doc_id", "source", F.explode(F.array(F.transform(X.sentences(F.col("text")), value))).alias("v"))
    return d.where(F.size("v") >= least)


@query(r"SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'unknown' WHEN len(regexp_extract_all(text, '[\x{0400}-\x{04FF}]')) / greatest(len(regexp_extract_all(text, '\p{L}')), 1) > 0.20 THEN 'ru' WHEN len(regexp_extract_all(text, '[^\x00-\x7F]')) / length(text) > 0.15 THEN 'other' ELSE 'en' END AS tag FROM documents")
def language_tags(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.language(F.col("text")).alias("tag"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INT AS words, length(text)::INT AS textlen FROM documents")
def word_counts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"), F.char_length("text").alias("textlen"))


@query(SENT + " SELECT doc_id, pos, text FROM e")
def sentence_table(spark, sf):
    return sentences(spark, sf).select("doc_id", "pos", "text")


#: A pattern between what belongs to no word, for SQL, whose own edges know ASCII alone.
def _apart(words: str) -> str:
    return rf"regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_])({words})([^\p{{L}}\p{{M}}\p{{N}}_]|$)')::INT"


@query(f"SELECT doc_id, {_apart('the|der|die|das|le|la')} AS article, {_apart('and|und|et')} AS joiner, {_apart('of|von|de')} AS \"of\" FROM documents")
def lexicon_presence(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", *(c.alias(k) for k, c in X.presence(F.col("text"), COMMON).items()))


@query("SELECT doc_id, round(len(regexp_extract_all(text, '(?i)\\bthe\\b')) / greatest(len(regexp_extract_all(text, '[A-Za-z'']+')), 1), 8) AS rate FROM documents")
def lexicon_rate(spark, sf):
    return read(spark, sf, "documents").select("doc_id", eight(X.rate(F.col("text"), r"(?i)\bthe\b")).alias("rate"))


@query("SELECT doc_id, sha256(lower(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')))) AS exact FROM benchmark_docs".replace("benchmark_docs", "(SELECT item_id AS doc_id, text FROM benchmark)"))
def normalised_keys(spark, sf):
    b = read(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), X.normal_ascii(F.col("text")).alias("t"))
    return b.select("doc_id", X.overlap_keys(F.col("t"))["exact"].alias("exact"))


@query()
def corpus_overlap(spark, sf):
    """Distinct texts of two corpora, and how many they share, under each of three keys."""
    sides = []
    for name in ("documents", "benchmark"):
        t = read(spark, sf, name).select(X.normal(F.col("text")).alias("t"))
        keys = X.overlap_keys(F.col("t"))
        sides.append(t.select(F.lit(name).alias("corpus"), F.explode(F.array(*(F.struct(F.lit(k).alias("key"), c.alias("h")) for k, c in keys.items()))).alias("x")).select("corpus", "x.key", "x.h"))
    held = sides[0].unionByName(sides[1]).groupBy("key", "h").agg(*(F.max((F.col("corpus") == n).cast("int")).alias(n) for n in ("documents", "benchmark")))
    return held.groupBy("key").agg(*(F.sum(n).alias(n) for n in ("documents", "benchmark")), F.sum(F.col("documents") * F.col("benchmark")).alias("shared"))


@query(TRAJ + """, q AS (SELECT doc_id, k, v, greatest(k // 3, 1) AS j, k // 2 AS h FROM v), t AS (SELECT *, list_avg(v[1:j]) AS t1, CASE WHEN k - 2 * j > 0 THEN list_avg(v[j + 1:k - j]) ELSE list_avg(v) END AS t2, list_avg(v[k - j + 1:k]) AS t3 FROM q)
  SELECT doc_id, k AS n_sent, round(v[-1] - v[1], 8) AS drift, round(v[-2] - v[1], 8) AS drift_trim, round(list_avg(v[h + 1:k]) - list_avg(v[1:h]), 8) AS half, round(t3 - t1, 8) AS third, round(list_avg(v), 8) AS level, round(list_stddev_pop(v), 8) AS sd,
  round((list_position(v, list_max(v)) - 1) / (k - 1), 8) AS argmax, round((list_position(v, list_min(v)) - 1) / (k - 1), 8) AS argmin,
  round((k - 1) * list_sum(list_transform(range(k), lambda i: v[i + 1] * (i - (k - 1) / 2))) / (k * (k * k - 1) / 12), 5) AS slope FROM t""")
def trajectory_statistics(spark, sf):
    t = A.trajectory(F.col("v"))
    cols = ("drift", "drift_trim", "half", "third", "level", "sd", "argmax", "argmin")
    return trajectories(spark, sf).select("doc_id", t["n_sent"].cast("long").alias("n_sent"), *(eight(t[c]).alias(c) for c in cols), F.round(t["slope"], 5).alias("slope"))


@query()
def arc_classes(spark, sf):
    t = trajectories(spark, sf).select("source", A.trajectory(F.col("v"))["arc"].alias("arc"), A.shape_name(A.resample(F.col("v"))).alias("shape"))
    return t.groupBy("source", "arc", "shape").agg(F.count("*").alias("n"))


@query(TRAJ + ", d AS (SELECT doc_id, list_transform(range(1, k), lambda i: v[i + 1] - v[i]) AS x FROM v), m AS (SELECT doc_id, x, list_avg(x) AS m, list_stddev_pop(x) AS s FROM d) SELECT doc_id, CASE WHEN s >= 1e-12 THEN round(list_avg(list_transform(x, lambda y: (y - m) ** 3)) / s ** 3, 4) END AS skew FROM m")
def increment_skew(spark, sf):
    return trajectories(spark, sf).select("doc_id", F.round(A.increment_skew(F.col("v")), 4).alias("skew"))


@query(TRAJ + ", p AS (SELECT doc_id, v, k, unnest(range(20)) AS i FROM v), w AS (SELECT *, i * (k - 1) / 19 AS place, least(floor(i * (k - 1) / 19), k - 2)::INT AS lo FROM p) SELECT doc_id, i::INT AS i, round(v[lo + 1] + (v[lo + 2] - v[lo + 1]) * (place - lo), 8) AS y FROM w")
def resampled_arcs(spark, sf):
    return trajectories(spark, sf).select("doc_id", F.posexplode(A.resample(F.col("v"))).alias("i", "y")).select("doc_id", "i", eight("y").alias("y"))


@query(TRAJ + ", p AS (SELECT doc_id, v, k, unnest(range(k)) AS i FROM v) SELECT doc_id, floor((i + 0.5) / k * 6)::INT AS stage, round(avg(v[i + 1]), 8) AS mean FROM p GROUP BY 1, 2")
def stage_means(spark, sf):
    p = trajectories(spark, sf).select("doc_id", F.size("v").alias("k"), F.posexplode("v").alias("i", "x"))
    return p.groupBy("doc_id", A.stage(F.col("i"), F.col("k")).alias("stage")).agg(eight(F.avg("x")).alias("mean"))


@query(TRAJ + " SELECT doc_id, round(v[-1] - v[-2], 8) AS step, round(v[-2] - v[1], 8) AS pre, round(v[1], 8) AS v0, round(list_stddev_samp(v), 8) AS sd, round(list_avg(v), 8) AS vbar FROM v")
def closing_steps(spark, sf):
    c = A.closing_step(F.col("v"))
    return trajectories(spark, sf).select("doc_id", *(eight(c[k]).alias(k) for k in ("step", "pre", "v0", "sd", "vbar")))


@query(TRAJ + """, w AS (SELECT v, k, list_transform(range(k), lambda i: i % 5 = 4) AS w FROM v), a AS (SELECT 'full' AS arm, v AS x FROM w UNION ALL SELECT 'no_wake', list_filter(v, lambda x, i: (i - 1) % 5 <> 4) FROM w UNION ALL SELECT 'drop_last', v[1:k - 1] FROM w UNION ALL SELECT 'drop_last2', v[1:k - 2] FROM w UNION ALL SELECT 'interior', v[2:k - 1] FROM w UNION ALL SELECT 'not_ending_awake', v FROM w WHERE NOT w[-1] UNION ALL SELECT 'ending_awake', v FROM w WHERE w[-1])
  SELECT arm, round(avg(x[-1] - x[1]), 8) AS drift, count(*) AS n FROM a WHERE len(x) >= 4 GROUP BY 1""")
def trimmed_arms(spark, sf):
    """Mean drift of each way of trimming a trajectory, where it leaves four values."""
    wake = F.transform("v", lambda x, i: (i % 5 == 4))
    t = trajectories(spark, sf).withColumn("wake", wake)
    arms = t.select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("arm"), f(F.col("v"), F.col("wake")).alias("w")) for n, f in A.TRIMS.items()))).alias("z")).select("z.arm", "z.w").where(F.size("w") >= 4)
    return arms.groupBy("arm").agg(eight(F.avg(F.element_at("w", -1) - F.element_at("w", 1))).alias("drift"), F.count("*").alias("n"))


@query(TRAJ + ", d AS (SELECT doc_id, source, v[-1] - v[1] AS x FROM v), a AS (SELECT source, avg(x) AS m FROM d GROUP BY 1) SELECT round(avg(m), 8) AS drift, round(stddev_samp(m) / sqrt(count(*)), 8) AS se, count(*) AS n_authors FROM a")
def author_clustered_drift(spark, sf):
    d = trajectories(spark, sf).select("source", (F.element_at("v", -1) - F.element_at("v", 1)).alias("x")).groupBy("source").agg(F.avg("x").alias("m"))
    return d.agg(eight(F.avg("m")).alias("drift"), eight(F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n_authors"))


@query()
def drift_bootstrap(spark, sf):
    """Author means of drift with an interval from 4,000 bootstraps and p from 10,000 sign flips."""
    from ..operators import replicates as Rep

    d = trajectories(spark, sf).select("source", (F.element_at("v", -1) - F.element_at("v", 1)).alias("x")).groupBy("source").agg(F.avg("x").alias("m"))
    return Rep.resampled_means(d, "source", "m").withColumnRenamed("mean", "drift")


@query()
def forward_against_reversed(spark, sf):
    """How well order features tell a trajectory from its reverse, folds by author."""
    rows = R2.both_ways(trajectories(spark, sf), ["source"], "v").withColumn("fold", F.pmod(F.xxhash64("source"), F.lit(5)))
    return I.folded_auc(rows, list(ORDER), "y", "fold").select("auc", (F.col("n") / 2).cast("long").alias("n"))


@query(SENT + f", p AS (SELECT doc_id, pos, {VALUE} AS x FROM e), l AS (SELECT doc_id, x - lag(x) OVER (PARTITION BY doc_id ORDER BY pos) AS d FROM p) SELECT round(avg(d), 8) AS drift, round(stddev_pop(d), 8) AS sd, round(avg(d ** 3) / avg(d ** 2) ** 1.5, 8) AS skew, count(*) AS n FROM l WHERE d IS NOT NULL")
def irreversibility(spark, sf):
    p = sentences(spark, sf).select("doc_id", "pos", value(F.col("text")).alias("x"))
    d = p.select((F.col("x") - F.lag("x").over(Window.partitionBy("doc_id").orderBy("pos"))).alias("d")).where("d IS NOT NULL")
    return d.agg(eight(F.avg("d")).alias("drift"), eight(F.stddev_pop("d")).alias("sd"), eight(F.avg(F.col("d") ** 3) / F.avg(F.col("d") ** 2) ** 1.5).alias("skew"), F.count("*").alias("n"))


@query(SENT + f", p AS (SELECT doc_id, pos, {VALUE} AS x FROM e), j AS (SELECT t.tau, (b.x - a.x) ** 2 AS q FROM (SELECT unnest(range(1, 7))::INT AS tau) t CROSS JOIN p a JOIN p b ON b.doc_id = a.doc_id AND b.pos = a.pos + t.tau) SELECT tau, round(avg(q), 8) AS msd, count(*) AS n FROM j GROUP BY 1")
def mean_squared_displacement(spark, sf):
    p = sentences(spark, sf).select("doc_id", "pos", F.array(value(F.col("text"))).alias("x"))
    return V.displacement(p, "doc_id", "pos", "x").select("tau", eight("msd").alias("msd"), "n")


@query(SENT + f", p AS (SELECT doc_id, pos, {VALUE} AS x FROM e), j AS (SELECT t.tau, (b.x - a.x) ** 2 AS q FROM (SELECT unnest(range(1, 7))::INT AS tau) t CROSS JOIN p a JOIN p b ON b.doc_id = a.doc_id AND b.pos = a.pos + t.tau), m AS (SELECT tau, avg(q) AS msd FROM j GROUP BY 1) SELECT round(regr_slope(ln(msd), ln(tau)), 6) AS exponent FROM m WHERE msd > 0")
def diffusion_exponent(spark, sf):
    p = sentences(spark, sf).select("doc_id", "pos", F.array(value(F.col("text"))).alias("x"))
    return V.exponent(V.displacement(p, "doc_id", "pos", "x"), "tau", "msd").select(F.round("exponent", 6).alias("exponent"))


@query(SENT + f", p AS (SELECT doc_id, pos, {VALUE} AS x FROM e), k AS (SELECT doc_id FROM p GROUP BY 1 HAVING count(*) >= 3), z AS (SELECT a.doc_id, avg(abs(a.x - b.x)) AS pairs, avg(abs(a.x - b.x)) FILTER (b.pos = a.pos + 1) AS adjacent FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.pos < b.pos WHERE a.doc_id IN (FROM k) GROUP BY 1) SELECT doc_id, CASE WHEN pairs > 0 THEN round(adjacent / pairs, 8) END AS ratio FROM z")
def order_coherence(spark, sf):
    p = sentences(spark, sf).select("doc_id", "pos", value(F.col("text")).alias("x"))
    return V.order_coherence(p, "doc_id", "pos", "x").select("doc_id", eight("ratio").alias("ratio"))


@query(SENT + f", p AS (SELECT doc_id, pos, {VALUE} AS x FROM e), l AS (SELECT abs(x - lag(x) OVER (PARTITION BY doc_id ORDER BY pos)) AS d FROM p), z AS (SELECT avg(d) AS m, stddev_pop(d) AS s FROM l) SELECT round(quantile_cont(d, 0.95) / quantile_cont(d, 0.5), 8) AS p95_p50, round(quantile_cont(d, 0.99) / quantile_cont(d, 0.5), 8) AS p99_p50, round(kurtosis_pop(d), 4) AS kurtosis, round(avg((d > m + 2 * z.s)::INT), 8) AS long_share, count(*) AS n FROM l, z WHERE d IS NOT NULL")
def jump_lengths(spark, sf):
    p = sentences(spark, sf).select("doc_id", "pos", value(F.col("text")).alias("x"))
    d = p.select(F.abs(F.col("x") - F.lag("x").over(Window.partitionBy("doc_id").orderBy("pos"))).alias("d")).where("d IS NOT NULL")
    return V.jumps(d, "d").select(eight("p95_p50").alias("p95_p50"), eight("p99_p50").alias("p99_p50"), F.round("kurtosis", 4).alias("kurtosis"), eight("long_share").alias("long_share"), "n")


@query("WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), c AS (SELECT w, count(*) AS f FROM t GROUP BY 1), r AS (SELECT f, row_number() OVER (ORDER BY f DESC, w) AS rk FROM c) SELECT round(regr_slope(ln(f), ln(rk)), 8) AS exponent, count(*) AS n FROM r WHERE rk BETWEEN 10 AND 1000")
def zipf_exponent(spark, sf):
    c = read(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("w")).groupBy("w").agg(F.count("*").alias("f")).orderBy(F.desc("f"), "w").limit(1000)
    r = c.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("f"), "w"))).where("rk >= 10")
    return r.agg(eight(F.regr_slope(F.log("f"), F.log("rk"))).alias("exponent"), F.count("*").alias("n"))


@query("WITH k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 2654435761 + 3 * 40503) % 4294967296, doc_id) AS n FROM documents) SELECT doc_id, source FROM k WHERE n <= 15")
def capped_sample(spark, sf):
    return S.capped(read(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id", 15, 3)


@query("""WITH b AS (SELECT CASE WHEN lang = 'en' THEN 'a' ELSE 'b' END AS side, doc_id, least(n_chars // 500, 20) AS bin FROM documents), k AS (SELECT bin, least(count(*) FILTER (side = 'a'), count(*) FILTER (side = 'b')) AS k FROM b GROUP BY 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY side, bin ORDER BY (doc_id * 2654435761 + 5 * 40503) % 4294967296, doc_id) AS n FROM b) SELECT side, doc_id, bin FROM r JOIN k USING (bin) WHERE n <= k""")
def matched_count_sample(spark, sf):
    d = read(spark, sf, "documents").withColumn("bin", F.least(F.floor(F.col("n_chars") / 500), F.lit(20)))
    return S.matched_counts(d.where("lang = 'en'"), d.where("lang <> 'en'"), "bin", "doc_id", 5)


@query("WITH c AS (SELECT " + ", ".join(f"quantile_cont(n_chars, {k / 10}) AS q{k}" for k in range(1, 10)) + " FROM documents) SELECT doc_id, (" + " + ".join(f"(n_chars > q{k})::INT" for k in range(1, 10)) + ") AS bin FROM documents, c")
def quantile_bins(spark, sf):
    return S.binned(read(spark, sf, "documents"), "n_chars", 10).select("doc_id", "bin")


@query(R + ", d AS (SELECT *, unnest(range(200)) AS draw FROM r), k AS (SELECT draw, value, row_number() OVER (PARTITION BY draw, user_id ORDER BY (doc_id * 2654435761 + draw * 97 + (draw * doc_id) % 65521 * 40503) % 4294967296, doc_id) AS n FROM d) SELECT draw::INT AS draw, round(avg(value), 6) AS mean, count(*) AS n FROM k WHERE n = 1 GROUP BY 1")
def one_report_per_person(spark, sf):
    d = S.mean_of_one_per_group(reports(spark, sf), "user_id", "doc_id", "value", 200)
    return d.select("draw", F.round("mean", 6).alias("mean"), "n")


@query(R + """, d AS (SELECT *, unnest(range(200)) AS split FROM r), h AS (SELECT *, ((user_id * 2654435761 + (split * (user_id % 65521 + 13)) % 65521 * 40503) % 4294967296 >> 7) % 2 AS h FROM d),
  m AS (SELECT split, day, avg(value) FILTER (h = 0) AS a, avg(value) FILTER (h = 1) AS b, count(value) FILTER (h = 0) AS na, count(value) FILTER (h = 1) AS nb FROM h GROUP BY 1, 2) SELECT split::INT AS split, round(corr(a, b), 8) AS r, count(*) AS n FROM m WHERE na >= 5 AND nb >= 5 GROUP BY 1 HAVING count(*) > 10""")
def split_half_reliability(spark, sf):
    return S.split_half(reports(spark, sf), "value", "day", "user_id", 200).select("split", eight("r").alias("r"), "n")


@query()
def within_person_shuffle_null(spark, sf):
    """The day effect against 1,000 shuffles of each person's deviations over the person's own reports."""
    from ..operators import nulls as N

    d = W.loo_deviation(reports(spark, sf), "value").where("dev IS NOT NULL").select("user_id", "day", "dev")
    return N.day_effect_null(d, "dev", "day", "user_id")


@query()
def weekday_preserving_null(spark, sf):
    """The same with each person's deviations dealt anew among the person's reports of one weekday, so that weekly rhythm stays in the null."""
    from ..operators import nulls as N

    d = W.loo_deviation(reports(spark, sf), "value").where("dev IS NOT NULL").select("user_id", "day", "dev")
    return N.day_effect_null(d, "dev", "day", "user_id", stratum=F.weekday("day"))


@query()
def block_shuffle_null(spark, sf):
    """The same with runs of three successive reports of a person moved as wholes, so that what carries over to the next report stays in the null."""
    from ..operators import nulls as N

    d = W.loo_deviation(reports(spark, sf), "value").where("dev IS NOT NULL").select("user_id", "day", "dev")
    return N.day_effect_null(d, "dev", "day", "user_id", block=3)


@query()
def reliability_interval(spark, sf):
    """Split-half reliability over 50 splits, stepped up, with an interval from 500 bootstraps of blocks of days."""
    from ..operators import replicates as Rep

    return Rep.reliability(S.halves(reports(spark, sf), "value", "day", "user_id", 50), "day")
