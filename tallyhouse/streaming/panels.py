"""The daily and weekly panels, sessions and anomaly detection over streams.

Event times must be `timestamp` (the test tables' zone-less ones are cast with the session's zone, UTC). Late rows are waited for
LATE long; distinct contributors are counted approximately, as streams allow no exact distinct count.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import delete, shared_dir

LATE = "2 days"


def stream(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def timed(events: DataFrame, ts: str = "ts", late: str = LATE) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, value: str, stratum: str, length: str = "1 day", ts: str = "ts", person: str = "user_id") -> DataFrame:
    """Mean, reports and contributors by stratum and window; weeks ("7 days") start on Mondays."""
    window = F.window(ts, length, length, "4 days") if length == "7 days" else F.window(ts, length)
    g = events.groupBy(window.alias("w"), stratum).agg(F.avg(value).alias(f"{value}_mean"), F.count("*").alias("n_reports"), F.approx_count_distinct(person).alias("n_users"))
    return g.select(F.col("w.start").alias("start"), stratum, f"{value}_mean", "n_reports", "n_users")


def sliding(events: DataFrame, value: str, length: str = "28 days", step: str = "1 day", ts: str = "ts") -> DataFrame:
    g = events.groupBy(F.window(ts, length, step).alias("w")).agg(F.avg(value).alias(f"{value}_mean"), F.var_samp(value).alias(f"{value}_var"), F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), f"{value}_mean", f"{value}_var", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", person: str = "user_id", ts: str = "ts") -> DataFrame:
    g = events.groupBy(person, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(person, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def trailing_z(events: DataFrame, key: str, value: str, window: int = 28, least: int = 14, ts: str = "ts") -> DataFrame:
    """Robust z of each value against the key's last `window` values, kept as state from batch to batch: key, ts, value, z."""
    import numpy as np

    def step(ids, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        for pdf in frames:
            out = []
            for t, x in pdf.sort_values([ts, value])[[ts, value]].itertuples(index=False):
                known = np.array(past[-window:])
                z = None
                if len(known) >= least:
                    m = np.median(known)
                    mad = np.median(np.abs(known - m))
                    z = float((x - m) / (1.4826 * mad)) if mad > 0 else None
                out.append((ids[0], t, float(x), z))
                past = [*past[-window + 1 :], float(x)]
            yield pd.DataFrame(out, columns=[key, ts, value, "z"])
        state.update((past[-window:],))

    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col(value).isNotNull()).select(key, ts, F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} timestamp, {value} double, z double", "past array<double>", "append", GroupStateTimeout.NoTimeout)


def drained(frame: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what its source holds and gives its rows: those of all batches, or of the last one in complete mode.

    Rows and the stream's checkpoint (its offsets and state) are files in the shared folder, nothing passes through the driver; a batch
    that is run again after a failure replaces its own files.
    """
    spark = frame.sparkSession
    home = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, home)
    numbers: list[int] = []

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{home}/rows/{number}")
        numbers.append(number)

    frame.writeStream.foreachBatch(keep).option("checkpointLocation", f"{home}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    wanted = sorted(set(numbers))[-1:] if mode == "complete" else sorted(set(numbers))
    return spark.read.schema(frame.schema).parquet(*(f"{home}/rows/{n}" for n in wanted)) if wanted else spark.createDataFrame([], frame.schema)


def append_scored(stream_: DataFrame, path: str, checkpoint: str, key: str, score):
    """Scores each micro-batch's new keys and appends them: a restarted stream writes no key twice."""
    from ..sources.readers import append_new

    def batch(df: DataFrame, _: int) -> None:
        append_new(score(df), path, key)

    return stream_.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
