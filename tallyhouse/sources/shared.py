"""The folder that driver and executors share, and intermediate results in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is broadcast at most, as files hold it.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode, where that is unset."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyhouse-"))
    return jsc.getCheckpointDir().get()


def saved(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, survives lost executors, keeps columns prunable."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(delete, spark, path)
    made = spark.read.schema(df.schema).parquet(path)
    made.saved_at = path
    return made


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of frames that saved() made and that no later result reads."""
    for frame in frames:
        delete(frame.sparkSession, frame.saved_at)


def small_enough(frame: DataFrame) -> bool:
    """Whether a frame that saved() made may be broadcast, by the size of its files."""
    path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.saved_at)
    return path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength() <= BROADCAST_BYTES


def sized(frame: DataFrame) -> DataFrame:
    """A frame that saved() made, as a side of a join: broadcast where its files are small, else left for a sort-merge join, in which
    Spark splits the other side's hot keys. The rows are the same either way."""
    return F.broadcast(frame) if small_enough(frame) else frame.hint("merge")


def delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended: nothing is left to ask
        pass
