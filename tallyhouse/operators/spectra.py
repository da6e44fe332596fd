"""Spectra of many series at once: overlapping tapered segments are rows, and their spectra are averaged by series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.shared import saved


def welch(series: DataFrame, by: list[str], order: str, value: str, segment: int = 256) -> DataFrame:
    """by, frequency (cycles a row), power (density) and segments: Welch's spectrum with Hann's taper, half-overlapping segments each less
    its mean, at most half of a series long. Values are as they stand in their order; NULLs are left out.

    A row goes to the two segments that hold it; a task transforms segments, not series, so a series may be of any length, and all
    series of a table go in one pass.
    """
    known = series.where(F.col(value).isNotNull()).select(*by, order, F.col(value).cast("double").alias("_v"))
    sizes = known.groupBy(*by).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*by).orderBy(order)  # a series in its order; a row a period
    size = F.least(F.lit(segment), F.floor(F.col("_n") / 2)).cast("int")
    placed = known.withColumn("_t", F.row_number().over(own) - 1)
    placed = (placed.join(sizes, by) if by else placed.crossJoin(F.broadcast(sizes))).withColumn("_size", size).where("_size >= 2")
    step = F.col("_size") - F.floor(F.col("_size") / 2)  # what the overlap leaves
    first = F.greatest(F.ceil((F.col("_t") - F.col("_size") + 1) / step), F.lit(0))
    last = F.least(F.floor(F.col("_t") / step), F.floor((F.col("_n") - F.col("_size")) / step))
    dealt = placed.withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn("_k", F.explode(F.sequence("_first", "_last")))
    cut = dealt.groupBy(*by, "_k").agg(F.transform(F.sort_array(F.collect_list(F.struct("_t", "_v"))), lambda s: s["_v"]).alias("_x"))  # a segment's rows
    kinds = ", ".join(f"{b} {series.schema[b].dataType.simpleString()}" for b in by)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = []
            for x in batch.column("_x").to_pylist():
                v = np.array(x)
                taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(len(v)) / len(v))
                power = np.abs(np.fft.rfft((v - v.mean()) * taper)) ** 2 / (taper @ taper)
                power[1 : None if len(v) % 2 else -1] *= 2
                made.append(power.tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(b) for b in by), pa.array([len(x) for x in batch.column("_x").to_pylist()], pa.int32()), pa.array(made, pa.list_(pa.float64()))], names=[*by, "size", "power"])

    spectra = cut.mapInArrow(run, (kinds + ", " if kinds else "") + "size int, power array<double>")
    long = spectra.select(*by, "size", F.posexplode("power").alias("_f", "power"))
    return long.groupBy(*by, "_f").agg(F.max("size").alias("size"), F.avg("power").alias("power"), F.count("*").alias("segments")).select(*by, (F.col("_f") / F.col("size")).alias("frequency"), "power", "segments")


def lag_scan_against_phases(pairs: DataFrame, by: list[str], order: str, y: str, x: str, most: int = 3, draws: int = 2000, block: int = 250, least: int = 8, volume: str | None = None) -> DataFrame:
    """by, lag, r, p, n: correlation of y at t with x at t + lag, against surrogates of y with random phases; with volume, y is first rid
    of what time and the logarithm of volume explain.

    A draw's surrogate is made once, by one transform, and correlated at all lags; draws spread over tasks by blocks. A group holds one
    pair of series and a block of draws.
    """
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-draws // block) - 1))).alias("_block")
    rows = saved(pairs.select(*by, order, F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x"), (F.log(F.col(volume)) if volume else F.lit(0.0)).alias("_l")).dropna(), "phase-pairs").select("*", blocks)
    kinds = ", ".join(f"{b} {pairs.schema[b].dataType.simpleString()}" for b in by)

    def one(ids, pdf):
        import pandas as pd

        ids, number = ids[:-1], int(ids[-1])
        pdf = pdf.sort_values(order)
        v, w = pdf["_y"].to_numpy(), pdf["_x"].to_numpy()
        n = len(v)
        if volume:
            t = np.arange(n, dtype=float)
            design = np.c_[np.ones(n), (t - t.mean()) / (t.std() + 1e-9), pdf["_l"] - pdf["_l"].mean()]
            v = v - design @ np.linalg.lstsq(design, v, rcond=None)[0]
        null = K.surrogates("phase", v, K.rng_of("phases", *ids, number), min(block, draws - number * block))
        every, out = np.r_[v[None], null], []
        for lag in range(-most, most + 1):
            a, b = every[:, max(0, -lag) : n - max(0, lag)], w[max(0, lag) : n + min(0, lag)]
            if len(b) < least:
                continue
            a, b = a - a.mean(1, keepdims=True), b - b.mean()
            d = np.sqrt((a * a).sum(1) * (b @ b))
            r = np.divide(a @ b, d, out=np.zeros(len(a)), where=d > 0)
            out.append((*ids, lag, float(r[0]), int((np.abs(r[1:]) >= abs(r[0]) - 1e-12).sum()), len(b)))
        return pd.DataFrame(out, columns=[*by, "lag", "r", "beyond", "n"])

    each = rows.groupBy(*by, "_block").applyInPandas(one, (kinds + ", " if kinds else "") + "lag int, r double, beyond long, n long")
    return each.groupBy(*by, "lag").agg(F.max("r").alias("r"), ((F.sum("beyond") + 1) / F.lit(draws + 1)).alias("p"), F.max("n").alias("n"))
