"""Further queries: scorers, ablations, neighbour persistence, weighted fits, power of shapes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import calendar as Cal
from ..functions import kernels as K
from ..functions import lexicons as Lx
from ..functions import scoring
from ..functions import text as X
from ..operators import graph as G
from ..operators import inference as I
from ..operators import nulls as N
from ..operators import records as R2
from ..operators import sampling as S
from ..operators import windows as W
from ..sources.shared import saved
from ..sources.tables import read, reports, six
from .events import per_series
from .panel import R
from .registry import query
from .text import ORDER, SENT, TRAJ, sentences, trajectories
from .vectors import correlated


@query()
def lexicon_scores(spark, sf):
    return scoring.scored(read(spark, sf, "documents").select("doc_id", "text"), "text", keep=["doc_id"])


@query()
def hashed_embeddings(spark, sf):
    e = scoring.scored(read(spark, sf, "documents").select("doc_id", "lang", "text"), "text", scoring.hashed_embedding, "embedding", kind="array<double>", keep=["doc_id", "lang"])
    return e.groupBy("lang").agg(F.count("*").alias("n"), F.avg(A.norm(F.col("embedding"))).alias("mean_norm"))


@query(SENT + " SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(text, '(?i)(^|[^\\p{L}])(the|der|die)([^\\p{L}]|$)')) AS marked FROM e GROUP BY 1")
def marked_sentences(spark, sf):
    s = sentences(spark, sf)
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(r"(?i)(^|[^\p{L}])(the|der|die)([^\p{L}]|$)")).alias("marked"))


@query("WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents) SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'to', 'in', 'is')))::INT AS style, len(list_filter(w, lambda x: x NOT IN ('the', 'of', 'and', 'to', 'in', 'is')))::INT AS content FROM w")
def style_and_content_words(spark, sf):
    stop = ["the", "of", "and", "to", "in", "is"]
    w = read(spark, sf, "documents").select("doc_id", X.tokens(F.col("text"), "[a-z]+").alias("w"))
    return w.select("doc_id", F.size(X.style_only(F.col("w"), stop)).alias("style"), F.size(X.content_only(F.col("w"), stop)).alias("content"))


@query(R + ", d AS (SELECT day, avg(value) AS v, count(*) AS n, (isodow(day) = 5)::INT AS f FROM r GROUP BY 1) SELECT round(sum(n * (f - mf) * (v - mv)) / sum(n * (f - mf) ** 2), 6) AS beta FROM d, (SELECT sum(n * f) / sum(n) AS mf, sum(n * v) / sum(n) AS mv FROM d)")
def day_level_wls(spark, sf):
    d = reports(spark, sf).groupBy("day").agg(F.avg("value").alias("v"), F.count("*").cast("double").alias("n"))
    d = d.withColumns({"one": F.lit(1.0), "friday": (F.weekday("day") == 4).cast("double")})
    beta, _ = I.solved(d, "v", ["one", "friday"], "n")
    return spark.createDataFrame([(round(float(beta[1]), 6),)], "beta double")


def weekly_people(spark, sf):
    r = reports(spark, sf).withColumn("week", F.to_date(F.date_trunc("week", "day")))
    return r.groupBy("user_id", "week").agg(F.avg("value").alias("value"), F.avg("k").alias("k"), F.count("*").alias("n")).where("n >= 3")


@query()
def neighbour_persistence(spark, sf):
    """Share of a contributor's nearest five in one week that are so in the next, against relabelled contributors."""
    return N.neighbour_overlap(weekly_people(spark, sf), "user_id", "week", ["value", "k"], draws=1000)


@query()
def neighbour_persistence_two_weeks(spark, sf):
    return N.neighbour_overlap(weekly_people(spark, sf), "user_id", "week", ["value", "k"], lag=2)


@query()
def chronology_permutation(spark, sf):
    w = weekly_people(spark, sf).withColumn("u", A.unit(F.array(F.col("value") - 50, F.col("k") - 50))).where("u IS NOT NULL")
    return N.chronology(w, "user_id", "week", "u", 2)


@query()
def shape_power(spark, sf):
    """Share of noisy copies of a driver, through four shapes, that Pearson's and the distance correlation find at 0.05."""

    def fn(name, y, x):
        rng = K.rng_of(name, "shape")
        z = (x - x.mean()) / x.std()
        out = []
        for shape, g in (("linear", z), ("quadratic", z * z), ("absolute", np.abs(z)), ("cosine", np.cos(2 * z))):
            g = (g - g.mean()) / (g.std() or 1.0)
            hits = {"pearson": 0, "dcor": 0}
            for _ in range(50):
                v = 0.4 * g + np.sqrt(1 - 0.16) * rng.normal(size=len(g))
                for stat in hits:
                    null = np.abs(K.association_null(stat, v, np.r_[z[None], K.surrogates("shuffle", z, rng, 99)]))
                    hits[stat] += (null[1:] >= null[0]).sum() < 5
            out += [{"shape": shape, "statistic": s, "power": h / 50} for s, h in hits.items()]
        return out

    return per_series(spark, sf, fn, "shape string, statistic string, power double")


@query()
def grouped_folds_auc(spark, sf):
    """Forward against reversed with folds by document and by author."""
    rows = saved(R2.both_ways(saved(trajectories(spark, sf), "trajectories"), ["doc_id", "source"], "v"), "both-ways")
    out = [I.folded_auc(rows.withColumn("fold", F.pmod(F.xxhash64(c), F.lit(5))), list(ORDER), "y", "fold").select(F.col("auc").alias(f"auc_by_{n}")) for c, n in (("doc_id", "document"), ("source", "author"))]
    return out[0].crossJoin(out[1])  # one row each


@query(TRAJ + r", sl AS (SELECT doc_id, (k - 1) * list_sum(list_transform(range(k), lambda i: v[i + 1] * (i - (k - 1) / 2))) / (k * (k * k - 1) / 12) AS x FROM v), m AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)the|der|die|la')) / greatest(len(regexp_extract_all(text, '[A-Za-z'']+')), 1) AS y FROM documents), j AS (SELECT round(x, 9) AS x, y FROM sl JOIN m USING (doc_id)), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS y FROM j) SELECT round(corr(x, y), 6) AS rho, count(*) AS n FROM k")
def slope_against_marker(spark, sf):
    """Rank correlation over documents of the trajectory's slope with the rate of a marker."""
    s = trajectories(spark, sf).select("doc_id", A.slope(F.col("v")).alias("slope"))
    m = read(spark, sf, "documents").select("doc_id", X.rate(F.col("text"), "(?i)the|der|die|la").alias("rate"))
    return W.spearman(s.join(m, "doc_id").withColumn("slope", F.round("slope", 9)), "slope", "rate").select(six("rho").alias("rho"), "n")


@query()
def theme_networks(spark, sf):
    """Edges of fixed density by language with communities and modularity."""
    e = W.top_edges(correlated(spark, sf, "lang"), "rho", 0.5, ["lang"]).withColumn("weight", F.abs("rho"))
    return G.communities(e.select("lang", "a", "b", "weight"), ["lang"])


@query()
def interrupted_power(spark, sf):
    """Share of block resamples with an injected step that a segmented fit finds."""

    def fn(name, y, x):
        rng, sd = K.rng_of(name, "its"), y.std()
        out = []
        for delta in (0.0, 1.0, 2.0):
            hits = 0
            for _ in range(200):
                v = K.stationary_bootstrap(y, rng)
                v[len(v) // 2 :] += delta * sd
                hits += K.interrupted(v, len(v) // 2)["p"] < 0.05
            out.append({"delta": delta, "power": hits / 200})
        return out

    return per_series(spark, sf, fn, "delta double, power double")


@query()
def volatility_surrogates(spark, sf):
    """Volatility diagnostic of each series against AR(1) with GARCH innovations."""

    def diag(v):
        return float(np.corrcoef(np.abs(v[1:] - v.mean()), np.abs(v[:-1] - v.mean()))[0, 1])

    def fn(name, y, x):
        rng = K.rng_of(name, "garch")
        null = [diag(v) for v in K.surrogates("garch", y, rng, 1000)]
        return [{"observed": diag(y), "null_mean": float(np.mean(null)), "p": (1 + sum(v >= diag(y) for v in null)) / 1001}]

    return per_series(spark, sf, fn, "observed double, null_mean double, p double")


@query(R + ", o AS (SELECT lang, day, avg(value) AS m, count(*) AS n FROM r GROUP BY 1, 2), c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, day) AS k FROM o) SELECT lang, day::VARCHAR AS day, round(m, 6) AS m FROM c WHERE k = 1")
def best_day_per_stratum(spark, sf):
    from ..operators.panel import first_per_key

    o = reports(spark, sf).groupBy("lang", "day").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return first_per_key(o, ["lang"], [F.desc("n"), F.col("day")]).select("lang", F.col("day").cast("string").alias("day"), six("m").alias("m"))


@query("SELECT (((doc_id % 2147483648) * 2654435761) % 4294967296 >> 5) % 5 AS fold, count(*) AS n FROM documents GROUP BY 1")
def author_folds(spark, sf):
    return read(spark, sf, "documents").groupBy(S.fold("doc_id", 5).alias("fold")).agg(F.count("*").alias("n"))


@query("SELECT date_trunc('month', o_orderdate)::DATE::VARCHAR AS period, round(avg(o_totalprice), 6) AS v, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 120")
def gated_months(spark, sf):
    o = read(spark, sf, "orders")
    g = o.groupBy(Cal.period(F.col("o_orderdate"), "M").cast("string").alias("period")).agg(six(F.avg("o_totalprice")).alias("v"), F.count("*").alias("n"))
    return g.where("n >= 120")


AXES = ", ".join(f"regexp_matches(text, '(?i){p}')::INT AS {a}" for a, p in Lx.ALL.items())


@query(f"SELECT item_id, {AXES} FROM benchmark")
def lexicon_axes(spark, sf):
    b = read(spark, sf, "benchmark")
    return b.select("item_id", *(c.alias(a) for a, c in Lx.presence(F.col("text")).items()))


@query()
def presence_without_explicit(spark, sf):
    """Rates by role of threat marks, awakenings and threat words over conversations' texts that name no explicit axis."""
    c = read(spark, sf, "conversations").where(Lx.without_explicit(F.col("text")))
    return c.groupBy("role").agg(F.count("*").alias("n"), F.avg(Lx.threat_marked(F.col("text"))).alias("threat"), F.avg(Lx.awakening(F.col("text")).cast("int")).alias("awakening"), F.avg(Lx.threat_rate(F.col("text"))).alias("threat_rate"))
