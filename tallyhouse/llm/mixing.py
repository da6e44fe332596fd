"""Mixing sources to target weights (operator 1), in DataFrame functions only.

Words are summed per source, weights become targets by filling up to a ceiling (what a source can't take goes to the others by
weight), and target over size is the source's rate of repetition. A document is emitted floor(rate) times, plus once more where a
hash of its id, as a fraction of 1, lies below the rest of the rate.

Only sums per source meet in one place. The rates, a row a source, are written and measured, and return in a broadcast join, so that
documents don't move (if there are too many sources for that, in a sort-merge join that Spark splits where a source is hot).

Defined results: null and empty texts have size 0 and are never words taken; a null source is a source of its own, last in order; a
source of size 0 has target 0; rows that repeat a doc_id share its draw, so they are all taken or none; an empty table gives an
empty result; all columns pass through mix(); planned() replaces those named like one it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved, sized

WEIGHTS = (5, 2, 1)
CEILING = 3
SEED = "mix-1"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """source, source_size, target from rows (source, size). One task orders the sources, a row for each."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    fullness = F.col("source_size") / F.col("weight")
    before = Window.orderBy(fullness, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.select(
        "source",
        "source_size",
        "weight",
        (F.sum("source_size").over(everything) - ceiling * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left_words"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    )
    level = F.col("left_words") / F.col("left_weight")
    per = per.withColumn("level", level).withColumn("full", ceiling * F.col("source_size") <= F.col("weight") * F.col("level"))
    water = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return per.select("source", "source_size", F.when(F.col("full"), (ceiling * F.col("source_size")).cast("double")).otherwise(F.col("weight") * water).alias("target"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A hash of the key as a fraction of 1: the same in every run and on every machine."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _rated(rows: DataFrame, sizes: DataFrame, weights: tuple[int, ...], ceiling: int, seed: str) -> DataFrame:
    """rows (key, source and others) with source_size, target and copies, by the sizes (source, size) of all documents."""
    goal = targets(sizes, weights, ceiling).withColumnRenamed("source", "of_source")
    joined = rows.join(sized(saved(goal, "mixing-targets")), F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return joined.withColumn("copies", F.floor(rate) + (draw(F.col("key"), seed) < rate - F.floor(rate)).cast("long"))


def planned(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, seed: str = SEED, key_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target and copies."""
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    counted = docs.select(F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"))
    rows = docs.select(F.struct(*own).alias("row"), F.col(key_col).alias("key"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"))
    return _rated(rows, counted, weights, ceiling, seed).select("row.*", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, seed: str = SEED, key_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken, with all columns of docs."""
    counted = docs.select(F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key_col).alias("key"), F.col(source_col).alias("source"))
    taken = _rated(rows, counted, weights, ceiling, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns. Words are counted once; the counts, not the texts, are read again."""
    counted = saved(docs.select(F.col("doc_id").alias("key"), "source", words_in(F.col("text")).alias("size")), "mixing-sizes")
    rated = _rated(counted, counted.select("source", "size"), WEIGHTS, CEILING, SEED)
    return rated.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - {CEILING} * coalesce(sum(source_size) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
      FROM w WINDOW b AS (ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN {CEILING} * source_size <= weight * level THEN ({CEILING} * source_size)::DOUBLE
      ELSE weight * max(CASE WHEN {CEILING} * source_size > weight * level THEN level END) OVER () END AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
      ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies
FROM (SELECT *, floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT AS copies FROM r)
"""
