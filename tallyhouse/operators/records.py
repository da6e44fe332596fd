"""Sentence-level tables and records: one row a sentence, or one row a report with its sentences' values in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrays import let, mean, order_features, resample, trajectory
from .sampling import order_of, small


def sentence_build(docs: DataFrame, key: str, text: str, limit: int | None = None, seed: int = 0) -> DataFrame:
    """key, pos, sentence and n_words of every report, or of `limit` reports taken by hash."""
    if limit is not None:
        docs = docs.orderBy(order_of(key, seed), key).limit(limit)
    s = docs.select(key, F.posexplode(X.sentences(F.col(text))).alias("pos", "sentence"))
    return s.withColumn("n_words", X.word_count(F.col("sentence")))


def records(sentences: DataFrame, key: str, value: Column, least: int = 4) -> DataFrame:
    """key and vals: any value of a report's sentences, in order, where there are `least` of them."""
    held = sentences.select(key, "pos", value.alias("_v")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "_v"))).alias("_s"))
    return held.where(F.size("_s") >= least).select(key, F.transform("_s", lambda s: s["_v"]).alias("vals"))


def true_records(scores: DataFrame, counts: DataFrame, key: str, score: str, least: int = 4) -> DataFrame:
    """key and vals of scored reports: those with a score that isn't finite are dropped; a report whose scores aren't as many as its
    sentences (key, n_sent) is an error. scores: key, pos, score."""
    held = scores.select(key, "pos", F.col(score).alias("_v")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "_v"))).alias("_s"))
    joined = held.join(counts.select(key, "n_sent"), key).where(F.col("n_sent") >= least)
    vals = F.transform("_s", lambda s: s["_v"])
    finite = F.forall(vals, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.when(F.size("_s") == F.col("n_sent"), vals).otherwise(F.raise_error(F.concat(F.lit("scores don't match sentences at "), F.col(key).cast("string"))))
    return joined.select(key, whole.alias("vals"), finite.alias("_ok")).where("_ok").select(key, "vals")


def shuffled_order(vals: Column, key: str, seed: int = 0) -> Column:
    """The values in an order given by a portable hash of place and report."""
    place = lambda i: F.pmod((i + 1).cast("long") * 2654435761 + small(key) * 40503 + seed, F.lit(4294967296))
    return F.transform(F.array_sort(F.transform(vals, lambda x, i: F.struct(place(i).alias("h"), i.alias("i"), x.alias("x")))), lambda s: s["x"])


def paired_arcs(held: DataFrame, key: str, vals: str = "vals", least: int = 5, points: int = 20) -> DataFrame:
    """key, real and shuffled: the resampled arcs of the values as they come and in shuffled order, of reports with `least` finite values."""
    ok = (F.size(vals) >= least) & F.forall(vals, lambda x: x.isNotNull() & ~F.isnan(x))
    return held.where(ok).select(key, resample(F.col(vals), points).alias("real"), let(shuffled_order(F.col(vals), key), lambda v: resample(v, points)).alias("shuffled"))


def corpus_summary(held: DataFrame, by: list[str], vals: str = "vals") -> DataFrame:
    """by, n, drift and the share of each kind of arc."""
    t = trajectory(F.col(vals))
    d = held.select(*by, t["drift"].alias("drift"), t["arc"].alias("arc"))
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("drift").alias("drift"), *(F.avg((F.col("arc") == a).cast("int")).alias(f"share_{a}") for a in ("rise", "fall", "peak", "trough")))


def both_ways(held: DataFrame, keep: list[str], vals: str = "vals") -> DataFrame:
    """Two rows a report: the order features of its values as they come (y = 1) and reversed (y = 0)."""
    rows = None
    for label, v in ((1, F.col(vals)), (0, F.reverse(vals))):
        f = order_features(v)
        part = held.select(*keep, F.lit(label).alias("y"), *(c.alias(n) for n, c in f.items()))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def level_free(arc: Column) -> Column:
    return let(arc, lambda v: let(mean(v), lambda m: F.transform(v, lambda x: x - m)))
