"""Samples, splits and matched sets by portable hashes: the same rows in every run, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved
from .ranks import quantiles

def small(key: str) -> Column:
    """The key modulo 2^31, so that products stay in 64 bits."""
    return F.pmod(F.col(key).cast("long"), F.lit(2147483648))


def order_of(key: str, seed: int) -> Column:
    """A portable integer hash (a multiplier modulo 2^32); callers add the key as the tie-break."""
    return F.pmod(small(key) * 2654435761 + F.lit(seed) * 40503, F.lit(4294967296))


def capped(df: DataFrame, by: list[str], key: str, cap: int, seed: int = 0) -> DataFrame:
    """At most `cap` rows of each group, by hash."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order_of(key, seed), key))).where(F.col("_n") <= cap).drop("_n")


def half(key: str, split: int | Column, seed: int = 0) -> Column:
    """0 or 1 for a key in a split."""
    return F.pmod(F.shiftright(F.pmod(small(key) * 2654435761 + F.lit(split) * 40503 + seed, F.lit(4294967296)), 7), F.lit(2)).cast("int")


def fold(key: str, folds: int, seed: int = 0) -> Column:
    return F.pmod(F.shiftright(order_of(key, seed), 5), F.lit(folds)).cast("int")


def matched_counts(a: DataFrame, b: DataFrame, stratum: str, key: str, seed: int = 0, order: Column | None = None) -> DataFrame:
    """From both sides as many rows of each stratum as the smaller side has: side, key, stratum."""
    both = a.select(F.lit("a").alias("side"), key, stratum).unionByName(b.select(F.lit("b").alias("side"), key, stratum))
    size = both.groupBy(stratum).pivot("side", ["a", "b"]).count().select(stratum, F.least(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("_k"))
    turn = F.row_number().over(Window.partitionBy("side", stratum).orderBy(order_of(key, seed) if order is None else order, key))
    return both.withColumn("_n", turn).join(size, stratum).where(F.col("_n") <= F.col("_k")).select("side", key, stratum)


def binned(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """Bins by pooled quantile edges: how many inner edges lie below the value."""
    cuts = quantiles(df, value, [k / bins for k in range(1, bins)])
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, sum(((F.col(value) > F.col(f"_q{k}")).cast("int") for k in range(bins - 1)), F.lit(0))).drop(*(f"_q{k}" for k in range(bins - 1)))


def one_per_group(df: DataFrame, by: str, key: str, draws: int, seed: int = 0) -> DataFrame:
    """For each draw one row of each group, by hash: draw and df's columns. A group's least rows are found in the tasks that hold its rows."""
    d = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    mixed = F.pmod(small(key) * 2654435761 + F.col("draw") * 97 + (F.col("draw") * small(key)) % 65521 * 40503 + seed, F.lit(4294967296))
    return d.groupBy("draw", by).agg(F.min_by(F.struct(*df.columns), F.struct(mixed, F.col(key))).alias("_r")).select("draw", "_r.*")


#: Hashes made at once.
STEP = 1 << 20


def mean_of_one_per_group(df: DataFrame, by: str, key: str, value: str, draws: int, seed: int = 0) -> DataFrame:
    """draw, mean, n: the mean value (without NULLs) and the number of the rows that one_per_group gives, without a row for each row and draw.

    Rows move once, by group; a task goes through its groups in turn, keeps each draw's least row of the group at hand and adds it to the
    draw's sums, so that a number a draw leaves a task, whatever the size of a group. Groups of a NULL key are one group.
    """
    rows = df.select(F.xxhash64(by).alias("_g"), F.col(by).alias("_by"), F.col(key).cast("long").alias("_k"), small(key).alias("_s"), F.col(value).cast("double").alias("_v"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        turn = np.arange(draws)[:, None]
        total, known, n = np.zeros(draws), np.zeros(draws, np.int64), np.zeros(draws, np.int64)
        group, held = None, None  # held: mixed, key, value and whether known of each draw's least row so far

        def put():
            if held is not None:
                total[held[3]] += held[2][held[3]]
                known[held[3]] += 1
                n[:] += 1

        for batch in batches:
            g = batch.column("_by").to_pylist()
            k, s = (np.asarray(batch.column(c).fill_null(0)) for c in ("_k", "_s"))
            there = ~np.asarray(batch.column("_v").is_null())
            v = np.asarray(batch.column("_v").fill_null(0.0))
            cuts = [0, *(i for i in range(1, len(g)) if g[i] != g[i - 1]), len(g)] if g else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held is None or g[lo] != group:
                    put()
                    group, held = g[lo], None
                for at in range(lo, hi, max(1, STEP // draws)):
                    part = slice(at, min(hi, at + max(1, STEP // draws)))
                    own = s[part]
                    mixed = (own * 2654435761 + turn * 97 + (turn * own) % 65521 * 40503 + seed) % 4294967296
                    least = mixed.min(1)
                    tied = np.where(mixed == least[:, None], k[part], np.iinfo(np.int64).max)
                    best = tied.argmin(1)
                    new = (least, k[part][best], v[part][best], there[part][best])
                    if held is None:
                        held = new
                    else:
                        less = (new[0] < held[0]) | ((new[0] == held[0]) & (new[1] < held[1]))
                        held = tuple(np.where(less, a, b) for a, b in zip(new, held, strict=True))
        put()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws, dtype=np.int32)), pa.array(total), pa.array(known), pa.array(n)], names=["draw", "s", "k", "n"])

    sums = rows.repartition("_g").sortWithinPartitions("_g", "_by").select("_by", "_k", "_s", "_v").mapInArrow(run, "draw int, s double, k long, n long")
    return sums.groupBy("draw").agg(F.try_divide(F.sum("s"), F.sum("k")).alias("mean"), F.sum("n").alias("n")).where("n > 0")


def halves(df: DataFrame, value: str, period: str, unit: str, splits: int, least: int = 5, seed: int = 0) -> DataFrame:
    """split, period, 0_m, 0_n, 1_m, 1_n: means and counts of both halves of each split, for periods with `least` rows in both."""
    d = df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    side = F.pmod(F.shiftright(F.pmod(small(unit) * 2654435761 + (F.col("split") * (small(unit) % 65521 + 13)) % 65521 * 40503 + seed, F.lit(4294967296)), 7), F.lit(2))
    means = d.withColumn("_h", side).groupBy("split", period).pivot("_h", [0, 1]).agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    return means.where((F.col("0_n") >= least) & (F.col("1_n") >= least))


def split_half(df: DataFrame, value: str, period: str, unit: str, splits: int, least: int = 5, seed: int = 0) -> DataFrame:
    """For each split the correlation of the two halves' period means, over periods with `least` rows in both: split, r, n."""
    return halves(df, value, period, unit, splits, least, seed).groupBy("split").agg(F.corr("0_m", "1_m").alias("r"), F.count("*").alias("n")).where("n > 10")


def numbered(df: DataFrame, key: str, order: list[Column], keep: list[str] | None = None) -> DataFrame:
    """key, the columns of keep and number: 1, 2, ... by ascending expressions, which must tell rows apart. Rows are sorted by ranges and
    written; only the ranges' sizes, a row for each, meet in one task."""
    names = [key, *(keep or [])]
    ranked = df.select(*names, *(c.alias(f"_o{k}") for k, c in enumerate(order)))
    by = [f"_o{k}" for k in range(len(order))]
    placed = saved(ranked.repartitionByRange(*by).sortWithinPartitions(*by).select(*names, F.monotonically_increasing_id().alias("_m")), "numbered")
    part, place = F.shiftright("_m", 33).alias("_part"), F.col("_m").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(sizes), "_part").select(*names, (F.col("_before") + place + 1).alias("number"))
