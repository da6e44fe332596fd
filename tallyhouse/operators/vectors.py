"""Vector operators: means by group without pairs, dispersion, steps of trajectories, principal directions, percolation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.arrays import dot, norm, unit
from .ranks import quantiles


def mean_vectors(df: DataFrame, vector: str, by: list[str], name: str = "mean") -> DataFrame:
    """by, n and the mean vector: positions are summed as rows (partial sums move, not vectors) and put together in order."""
    long = df.select(*by, F.posexplode(vector).alias("_p", "_v"))
    sums = long.groupBy(*by, "_p").agg(F.avg(F.col("_v").cast("double")).alias("m"), F.count("*").alias("n"))
    return sums.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_p", "m"))), lambda s: s["m"]).alias(name))


def unit_means(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """The unit vector of each group's mean: what a contributor's night or week amounts to."""
    return mean_vectors(df, vector, by).withColumn("unit", unit(F.col("mean"))).drop("mean")


def cohesion(units: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """Mean cosine of all pairs of unit vectors in a group, from the length of their sum alone: (|sum|^2 - n) / (n (n - 1))."""
    m = mean_vectors(units, vector, by)
    n = F.col("n")
    return m.where(n > 1).select(*by, "n", ((dot(F.col("mean"), F.col("mean")) * n * n - n) / (n * (n - 1))).alias("cohesion"))


def dispersion(df: DataFrame, vector: str, by: list[str], least: int = 20) -> DataFrame:
    """1 less the mean cosine to the group's mean vector, for groups of enough rows."""
    m = mean_vectors(df, vector, by).where(F.col("n") >= least)
    rows = df.select(*by, vector).join(m, by)
    return rows.groupBy(*by).agg(F.max("n").alias("n"), (1 - F.avg(dot(F.col(vector), F.col("mean")) / (norm(F.col(vector)) * norm(F.col("mean"))))).alias("dispersion"))


def order_parameter(units: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """Length of the mean unit vector, and the mean pairwise cosine."""
    m = mean_vectors(units, vector, by)
    r = norm(F.col("mean"))
    n = F.col("n")
    return m.select(*by, "n", r.alias("order"), F.when(n > 1, (r * r * n - 1) / (n - 1)).alias("mean_pair_cosine"))


def displacement(df: DataFrame, key: str, pos: str, vector: str, most: int = 6) -> DataFrame:
    """Mean squared distance between vectors `tau` places apart in a sequence, and the exponent of its growth: tau, msd, n."""
    # earlier vectors come by lag over one shuffle; a gap in the positions makes no pair
    w = Window.partitionBy(key).orderBy(pos)
    earlier = F.array(*(F.struct(F.lit(t).alias("tau"), F.lag(pos, t).over(w).alias("p"), F.lag(vector, t).over(w).alias("v")) for t in range(1, most + 1)))
    placed = df.select(F.col(pos).alias("_p"), F.col(vector).alias("_v"), earlier.alias("_e"))
    both = placed.select("_p", "_v", F.explode("_e").alias("e")).where(F.col("e.p") == F.col("_p") - F.col("e.tau"))
    gap = F.zip_with("_v", "e.v", lambda x, y: (x - y).cast("double"))
    return both.groupBy("e.tau").agg(F.avg(dot(gap, gap)).alias("msd"), F.count("*").alias("n"))


def exponent(curve: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    return curve.where((F.col(x) > 0) & (F.col(y) > 0)).groupBy(*(by or [])).agg(F.regr_slope(F.log(y), F.log(x)).alias("exponent"))


def jumps(df: DataFrame, step: str) -> DataFrame:
    """Tail ratios, excess kurtosis and share of long steps."""
    s = df.agg(F.avg(step).alias("_m"), F.stddev_pop(step).alias("_s"))
    rows = df.crossJoin(F.broadcast(s))  # one row
    q = quantiles(df, step, [0.5, 0.95, 0.99]).select((F.col("_q1") / F.col("_q0")).alias("p95_p50"), (F.col("_q2") / F.col("_q0")).alias("p99_p50"))
    return q.crossJoin(rows.agg(F.kurtosis(step).alias("kurtosis"), F.avg((F.col(step) > F.col("_m") + 2 * F.col("_s")).cast("int")).alias("long_share"), F.count("*").alias("n")))  # one row each


def order_coherence(df: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Mean adjacent step over the mean step of all pairs, by sequence (short ones): key, ratio, n."""
    v = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).cast("double").alias("v")))), lambda s: s["v"])
    held = df.groupBy(key).agg(v.alias("v")).where(F.size("v") >= 3)
    adjacent = F.aggregate(F.zip_with(F.slice("v", 2, F.size("v") - 1), F.slice("v", 1, F.size("v") - 1), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / (F.size("v") - 1)
    # the gap above the i-th smallest value lies in i (k - i) pairs: their sum is 0 where all values are equal, and there only
    ordered = F.array_sort("v")
    gaps = F.zip_with(F.slice(ordered, 2, F.size("v") - 1), F.slice(ordered, 1, F.size("v") - 1), lambda a, b: a - b)
    shared = F.transform(gaps, lambda g, i: g * (i + 1) * (F.size("v") - 1 - i))
    pairs = F.aggregate(shared, F.lit(0.0), lambda s, x: s + x) / (F.size("v") * (F.size("v") - 1.0) / 2)
    return held.select(key, F.when(pairs > 0, adjacent / pairs).alias("ratio"), F.size("v").alias("n"))


def covariance(df: DataFrame, vector: str, size: int) -> DataFrame:
    """Population covariances of vector positions i <= j as rows: i, j, cov.

    Each task adds up its rows' products by matrix multiplication and gives one row for each pair of positions; those sums meet.
    """
    upper = np.triu_indices(size)

    def partial(batches):
        import pyarrow as pa

        n, s, g = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            lists = batch.column(0).drop_null()
            x = np.asarray(lists.flatten(), float).reshape(-1, size)
            n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        if n:
            i, j = upper
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), n)), pa.array(s[i]), pa.array(s[j]), pa.array(g[upper])], names=["i", "j", "n", "si", "sj", "g"])

    parts = df.select(F.slice(vector, 1, size).alias("v")).where(F.size("v") == size).mapInArrow(partial, "i int, j int, n long, si double, sj double, g double")
    t = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "si", "sj", "g")))
    return t.select("i", "j", ((F.col("g") - F.col("si") * F.col("sj") / F.col("n")) / F.col("n")).alias("cov"))


def matrix_of(rows, size: int, value: str = "cov") -> np.ndarray:
    """The symmetric matrix of collected rows (i, j, value): size squared numbers, whatever the data's size."""
    m = np.zeros((size, size))
    for r in rows:
        m[r.i, r.j] = m[r.j, r.i] = r[value]
    return m


def spectrum(df: DataFrame, vector: str, size: int) -> DataFrame:
    """One row on the principal directions: participation ratio and how many directions hold 50, 80 and 90 % of the variance."""
    lam = np.sort(np.linalg.eigvalsh(matrix_of(covariance(df, vector, size).collect(), size)))[::-1].clip(0)
    share = np.cumsum(lam) / lam.sum()
    row = [float(lam.sum() ** 2 / (lam * lam).sum()), *(int(np.searchsorted(share, q)) + 1 for q in (0.5, 0.8, 0.9)), float(lam[0] / lam.sum())]
    return df.sparkSession.createDataFrame([row], "participation_ratio double, dims50 int, dims80 int, dims90 int, first_share double")


#: Rows within which vector positions are permuted.
SHUFFLE_ROWS = 2048


def shuffled_positions(df: DataFrame, key: str, vector: str, seed: int = 1) -> DataFrame:
    """Each vector position permuted by itself over the rows of a random block: keeps every position's values, breaks their ties.
    Rows are dealt into blocks by hash, so a block is a sample of all and no task holds more than some thousand rows."""
    blocks = max(1, -(-df.count() // SHUFFLE_ROWS))
    kind, held = df.schema[key].dataType.simpleString(), df.schema[vector].dataType.simpleString()

    def one(ids, pdf):
        import pandas as pd

        pdf = pdf.sort_values(key)
        x = np.stack(pdf[vector].to_numpy())
        return pd.DataFrame({key: pdf[key].to_numpy(), vector: list(K.rng_of("positions", seed, int(ids[0])).permuted(x, axis=0))})

    placed = df.select(key, vector, F.pmod(F.xxhash64(F.lit(seed), key), F.lit(blocks)).alias("_block"))
    return placed.groupBy("_block").applyInPandas(one, f"{key} {kind}, {vector} {held}")


def percolation(df: DataFrame, key: str, vector: str, thetas: list[float], sample: int = 5000, seeds: int = 3) -> DataFrame:
    """The percolation curve of `sample` rows (all, if fewer), averaged over seeds: each seed's hashed sample is one group."""
    drawn = None
    for seed in range(seeds):
        d = df.select(key, vector).orderBy(F.xxhash64(F.lit(seed), key), key).limit(sample).withColumn("seed", F.lit(seed))
        drawn = d if drawn is None else drawn.unionByName(d)
    columns = ["theta", "giant_frac", "n_components", "mean_degree", "n_singletons"]

    def one(pdf):
        import pandas as pd

        x = np.stack(pdf.sort_values(key)[vector].to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
        return pd.DataFrame([(*r, len(x)) for r in K.percolation(x, thetas)], columns=[*columns, "n"])

    each = drawn.groupBy("seed").applyInPandas(one, ", ".join(f"{c} double" for c in columns) + ", n long")
    return each.groupBy("theta").agg(*(F.avg(c).alias(c) for c in columns[1:]), F.max("n").alias("n"))


def ridge_axis(df: DataFrame, vector: str, size: int, target: str, alpha: float = 10.0) -> tuple[list[float], float]:
    """Weights and intercept of a ridge regression of target on the vector, from one pass of sums of products."""
    y = df.withColumn("_z", F.concat(F.transform(vector, lambda x: x.cast("double")), F.array(F.col(target).cast("double"))))
    head = y.agg(F.count("*").alias("n"), *(F.avg(F.get("_z", F.lit(k))).alias(f"m{k}") for k in range(size + 1))).first()
    c = matrix_of(covariance(y, "_z", size + 1).collect(), size + 1) * head["n"]
    w = np.linalg.solve(c[:size, :size] + alpha * np.eye(size), c[:size, size])
    return w.tolist(), float(head[f"m{size}"] - sum(w[k] * head[f"m{k}"] for k in range(size)))


def projected(vector: Column, weights: list[float], intercept: float) -> Column:
    return dot(vector, F.array(*map(F.lit, weights))) + F.lit(intercept)


def within_shift_null(df: DataFrame, person: str, value: str, order: str, seed: int, name: str = "shuffled") -> DataFrame:
    """Each person's values dealt anew over the person's own rows, by a seeded hash."""
    own = Window.partitionBy(person)
    a = df.withColumn("_r", F.row_number().over(own.orderBy(order)))
    b = df.select(person, F.col(value).alias(name), F.row_number().over(own.orderBy(F.xxhash64(F.lit(seed), order), order)).alias("_r"))
    return a.join(b, [person, "_r"]).drop("_r")


#: Texts whose grams are worked on at once.
GRAM_TEXTS = 64


def gram_rows(df: DataFrame, keep: list[str], text: str, features: int = 40_000, packed: bool = False) -> DataFrame:
    """keep, gaps, counts: character 3- to 5-grams of whole texts as counts of hashed features, a row a text; gaps are the features in
    ascending order, each less the one before it (small numbers, which files hold in about a byte). Packed: keep, grams, both as one
    compressed value (empty for a text without grams), which passes between Spark and Python as it is, not number by number."""
    from pyspark.sql import types as T

    from ..functions.text import gram_counts

    read = df.select(*keep, text)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, len(batch), GRAM_TEXTS):
                part = batch.slice(lo, GRAM_TEXTS)
                found = gram_counts(part.column(len(keep)).to_pylist(), features=features)
                ends = np.cumsum([0, *(len(f) for f, _ in found)]).astype(np.int32)
                each = [np.diff(f.astype(np.int32), prepend=np.int32(0)) for f, _ in found]
                if packed:
                    blobs = pa.array([_pack(np.r_[g, c]) for g, (_, c) in zip(each, found, strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), blobs], names=[*keep, "grams"])
                    continue
                gaps = np.concatenate(each)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (gaps, np.concatenate([c for _, c in found]))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), *lists], names=[*keep, "gaps", "counts"])

    ints = T.ArrayType(T.IntegerType())
    made = [T.StructField("grams", T.BinaryType())] if packed else [T.StructField("gaps", ints), T.StructField("counts", ints)]
    return read.mapInArrow(run, T.StructType([*(read.schema[c] for c in keep), *made]))


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as their first, second, third and fourth bytes, compressed, after the length of these; nothing for none."""
    import pyarrow as pa

    raw = values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unpack(blob: bytes) -> np.ndarray:
    import pyarrow as pa

    if not blob:
        return np.zeros(0, np.int32)
    raw = pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _held(grams: DataFrame) -> DataFrame:
    return grams.select(*(c for c in ("gaps", "counts", "grams") if c in grams.columns))


def _grams(batches):
    """(rows, code, feature, count) of some of gram_rows' texts at a time; code is a gram's place in rows."""
    for batch in batches:
        for lo in range(0, len(batch), GRAM_TEXTS):
            part = batch.slice(lo, GRAM_TEXTS)
            if "grams" in part.schema.names:
                each = [np.split(v, 2) for v in map(_unpack, part.column("grams").to_pylist())]
                size = np.array([len(g) for g, _ in each])
                gaps, counts = (np.concatenate([v[k] for v in each]) for k in range(2))
            else:
                lists = part.column("gaps"), part.column("counts")
                size = np.diff(np.asarray(lists[0].offsets))
                gaps, counts = (np.asarray(v.flatten()) for v in lists)
            code = np.repeat(np.arange(len(part)), size)
            run = np.r_[0, np.cumsum(gaps, dtype=np.int64)]
            yield part, code, run[1:] - run[np.cumsum(size) - size][code], counts.astype(float)


def weighed_grams(batches, idf: np.ndarray):
    """(rows, code, feature, weight) of gram_rows' texts: counts times idf, of length 1 a text; grams without an idf weigh 0."""
    for part, code, f, c in _grams(batches):
        w = c * idf[f]
        length = np.sqrt(np.bincount(code, w * w, len(part)))
        yield part, code, f, w / np.maximum(length, 1e-300)[code]


def texts_with(grams: DataFrame, features: int) -> np.ndarray:
    """In how many of gram_rows' texts each feature is: tasks count their own, a number a feature reaches the driver."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(features, np.int64)
        for _, _, f, _ in _grams(batches):
            total += np.bincount(f, minlength=features)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["feature", "n"])

    seen = np.zeros(features, np.int64)
    for r in _held(grams).mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        seen[r.feature] = r.n
    return seen


def leading_directions(weights: DataFrame, row: str, feature: str, weight: str, size: int, k: int, rounds: int = 4, spare: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and directions (size by k) of a sparse matrix given as rows (row, feature, weight), by subspace iteration: each
    round multiplies by the matrix and its transpose in the tasks that hold whole rows; the tasks' products are added up in blocks of
    features, so that size by k numbers in all reach the driver."""
    blocked = weights.select(row, feature, weight).repartition(row).sortWithinPartitions(row)

    def product(basis):
        def run(frames):
            import pandas as pd

            total = np.zeros_like(basis)
            for pdf in frames:
                code, _ = pd.factorize(pdf[row])
                _both_ways(total, basis, code, pdf[feature].to_numpy(), pdf[weight].to_numpy())
            at, sums = _blocks(total)
            yield pd.DataFrame({"at": at, "total": sums})

        # a row of one frame may continue in the next; frames are kept whole by row below
        return blocked.mapInPandas(_whole(run, row), "at int, total binary")

    return _subspace(product, size, k, rounds, spare)


def leading_directions_of_rows(grams: DataFrame, idf: np.ndarray, k: int, rounds: int = 4, spare: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """leading_directions of gram_rows' texts, weighed by idf and brought to length 1 where they lie: no row of a text and feature is made,
    moved or sorted. At most as many tasks as cores give their sums (len(idf) by k + spare numbers each), whatever the number of files.

    Features with an idf under OFTEN are multiplied as a dense matrix of some texts at a time, rarer ones as a sparse one."""
    held = _held(grams).coalesce(grams.sparkSession.sparkContext.defaultParallelism)
    order = np.argsort(np.where(idf > 0, idf, np.inf), kind="stable")
    place, often = np.argsort(order), int(((idf > 0) & (idf < OFTEN)).sum())

    def product(basis):
        def run(batches):
            import pyarrow as pa

            dense, rare = np.ascontiguousarray(basis[:, order[:often]].T), np.ascontiguousarray(basis[:, order[often:]])
            dense_total, rare_total = np.zeros(dense.shape[::-1]), np.zeros_like(rare)
            texts, added = np.empty((GRAM_TEXTS, often)), np.empty_like(dense_total)  # made once: fresh memory costs as much as the sums
            for part, code, f, w in weighed_grams(batches, idf):
                f = place[f]
                frequent = f < often
                x = texts[: len(part)]
                x.fill(0.0)
                x[code[frequent], f[frequent]] = w[frequent]
                code, f, w = (v[~frequent] for v in (code, f - often, w))
                left = np.ascontiguousarray((x @ dense).T) + products(rare, code, f, w, len(part))
                dense_total += np.matmul(left, x, out=added)
                for one, made in zip(left, rare_total, strict=True):
                    made += np.bincount(f, w * one[code], len(made))
            at, sums = _blocks(np.concatenate([dense_total, rare_total], 1)[:, place])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums, pa.binary())], names=["at", "total"])

        return held.mapInArrow(run, "at int, total binary")

    return _subspace(product, len(idf), k, rounds, spare)


def products(basis: np.ndarray, code: np.ndarray, f: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """A sparse matrix (n rows by code in ascending order, columns f, values w) times basis; directions are rows of both."""
    out = np.zeros((len(basis), n))
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    if len(starts):
        for held, made in zip(basis, out, strict=True):
            made[code[starts]] = np.add.reduceat(w * held[f], starts)
    return out


#: A feature in one of 50 texts costs about as much in a dense matrix as in a sparse one (58 directions, one core: 12 ns a text, 560 ns an entry).
OFTEN = 1 + np.log(50)


def _both_ways(total: np.ndarray, basis: np.ndarray, code: np.ndarray, f: np.ndarray, w: np.ndarray) -> None:
    """Adds to total the transpose of a sparse matrix (rows code, columns f, values w) times its product with basis; both are held with a
    direction a row, so that a direction stays in the cache."""
    n = code.max() + 1 if len(code) else 0
    for held, made in zip(basis, total, strict=True):
        left = np.bincount(code, w * held[f], n)
        made += np.bincount(f, w * left[code], len(made))


def _blocks(total: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Blocks of features of a task's sums, held with a direction a row: first features and bytes, a feature a row."""
    at = list(range(0, total.shape[1], FEATURE_BLOCK))
    return at, [np.ascontiguousarray(total[:, k : k + FEATURE_BLOCK].T).tobytes() for k in at]


def _subspace(product, size: int, k: int, rounds: int, spare: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and directions by rounds of product, which gives blocks of sums (at, total) for a basis."""
    basis = np.linalg.qr(K.rng_of("directions", size).normal(size=(size, k + spare)))[0]
    values = np.zeros(k + spare)
    for _ in range(rounds):
        summed = product(np.ascontiguousarray(basis.T)).groupBy("at").applyInPandas(_added, "at int, total binary").collect()
        summed.sort(key=lambda p: p.at)  # a row a block of features; Spark's sort would add up all blocks twice
        basis, r = np.linalg.qr(np.concatenate([np.frombuffer(p.total).reshape(-1, basis.shape[1]) for p in summed]))
        values = np.sqrt(np.abs(np.diag(r)))
    order = np.argsort(-values)[:k]
    return values[order], basis[:, order]


#: Features whose sums of all tasks meet in one group.
FEATURE_BLOCK = 64


def _added(pdf):
    import pandas as pd

    return pd.DataFrame({"at": [pdf["at"].iloc[0]], "total": [np.sum([np.frombuffer(t) for t in pdf["total"]], axis=0).tobytes()]})


def _whole(fn, key: str):
    """fn over frames in which the rows of a key are together, from frames sorted by key."""

    def run(frames):
        import pandas as pd

        def joined():
            held = None
            for pdf in frames:
                pdf = pdf if held is None else pd.concat([held, pdf])
                if not len(pdf):
                    continue
                last = pdf[key].iloc[-1]
                held = pdf[pdf[key] == last]
                yield pdf[pdf[key] != last]
            if held is not None:
                yield held

        return fn(joined())

    return run
