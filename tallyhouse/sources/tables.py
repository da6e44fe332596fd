"""The test tables, seen as the library's inputs: reports, sentences, weekly series, daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables whose rows cost much time each.
WORDY = ("documents", "pages")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name in WORDY else table


def spread(scan: DataFrame) -> DataFrame:
    """A table smaller than one split of a scan, which one task would read, is dealt out to all cores; a larger one is left as it is."""
    spark = scan.sparkSession
    size = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return scan.repartition(spark.sparkContext.defaultParallelism) if size < split else scan


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as reports: doc_id, user_id, ts, day, lang (the event's type), value and k."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("doc_id"),
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.to_date("ts").alias("day"),
        F.col("event_type").alias("lang"),
        "value",
        F.get_json_object("props", "$.k").try_cast("double").alias("k"),
    )


def weekly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """week, y (mean order price) and x (mean priority rank): two weekly series with a common calendar."""
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.avg("o_totalprice").alias("y"), F.avg(F.substring("o_orderpriority", 1, 1).cast("int")).alias("x"), F.count("*").alias("n"))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, n, v: a daily series of some years."""
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("v"))


def eight(c: Column | str) -> Column:
    """Eight decimals, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 8) + F.lit(0.0)


def six(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
