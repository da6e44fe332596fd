"""Shape of clouds, arcs and networks against copies of the data that keep some of its structure and lose the rest.

Replicates are keys: which rows a seed samples, the normal deviates of a copy, the order of a document's values and the turn of a
calendar follow from hashes of a row's name or place, so each is made where the row is, in one pass for all replicates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.shared import saved
from .nulls import beyond_null
from .permutations import STEP, _hash, dealt_out, scattered
from .ranks import ranked
from .sampling import numbered
from .vectors import covariance, matrix_of

VARIANTS = ("real", "shuffled", "gaussian", "sphere")


def normals(name: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Standard normal deviates of each name: rows by size."""
    j = np.arange(0, size + 1, 2)
    u, v = ((_hash(np.uint64(seed), name[:, None], (2 * j + k)[None]) >> np.uint64(11)) / float(1 << 53) for k in (0, 1))
    r = np.sqrt(-2 * np.log1p(-u))
    return np.stack([r * np.cos(2 * np.pi * v), r * np.sin(2 * np.pi * v)], 2).reshape(len(name), -1)[:, :size]


def sampled_copies(df: DataFrame, key: str, vector: str, size: int, sample: int, seeds: int) -> DataFrame:
    """variant, seed, key, x: for each seed a random sample of the rows, as they are (twice: one is to be shuffled), as normal deviates
    with the table's mean and covariance, and as directions without any preference."""
    head = df.agg(*(F.avg(F.get(F.col(vector), F.lit(k)).cast("double")).alias(f"m{k}") for k in range(size))).first()
    mean = np.array([head[k] or 0.0 for k in range(size)])
    cov = matrix_of([r for r in covariance(df, vector, size).collect() if r["cov"] is not None], size)
    factor = np.linalg.cholesky(cov + 1e-12 * max(np.trace(cov) / size, 1e-12) * np.eye(size))
    placed = numbered(df.where(F.size(vector) == size), key, [F.col(key)], [vector]).select(key, vector, F.xxhash64(F.col(key).cast("string")).alias("name"), (F.col("number") - 1).alias("place"))
    total = df.where(F.size(vector) == size).count()
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.asarray(batch.column(vector).flatten(), float).reshape(-1, size)
            name, place = np.asarray(batch.column("name")).view(np.uint64), np.asarray(batch.column("place"))
            inside = scattered(place, np.full(len(place), total), np.zeros(len(place), np.uint64), np.arange(seeds)) < sample
            for seed in range(seeds):
                at = np.flatnonzero(inside[seed])
                z = normals(name[at], size, seed)
                for variant, v in zip(VARIANTS, (x[at], x[at], mean + z @ factor.T, z), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([variant] * len(at)), pa.array(np.full(len(at), seed, np.int32)), batch.column(key).take(pa.array(at)), pa.array(list(v), pa.list_(pa.float64()))], names=["variant", "seed", key, "x"])

    return dealt_out(placed, key).mapInArrow(run, f"variant string, seed int, {key} {kind}, x array<double>")


def against_nulls(df: DataFrame, key: str, vector: str, size: int, sample: int = 8000, seeds: int = 5, thetas: tuple[float, ...] = (0.5, 0.59), graph: int = 5000, pairs: int = 1500) -> DataFrame:
    """variant, TwoNN and correlation dimension (median, least and greatest over seeds), participation ratio, mean cosine, share of the
    greatest component and number of singletons at each theta (means over seeds), n: of unit vectors, as they are and as copies that keep
    each coordinate's values, the covariance, or nothing.

    A group holds one seed's sample of one variant, of a surveyed size; shuffling is done in it.
    """
    names = ["two_nn", "corr_dim", "participation_ratio", "mean_cosine", *(f"{what}_{k}" for k in range(len(thetas)) for what in ("giant", "singletons"))]

    def one(ids, pdf):
        import pandas as pd

        pdf = pdf.sort_values(key)
        x = np.stack(pdf["x"].to_numpy())
        rng = K.rng_of("geometry", ids[0], int(ids[1]))
        if ids[0] == "shuffled":
            x = rng.permuted(x, axis=0)
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
        n = len(x)
        few = x[np.sort(rng.permutation(n)[:graph])]
        curve = {t: (giant, single) for t, giant, _, _, single in K.percolation(few, thetas)}
        told = [K.two_nn(x), K.correlation_dimension(x[np.sort(rng.permutation(n)[:pairs])]), K.participation_ratio(np.cov(x.T, bias=True)), float(((x.sum(0) ** 2).sum() - n) / (n * (n - 1))), *(v for t in sorted(thetas) for v in curve[t])]
        return pd.DataFrame([(ids[0], int(ids[1]), n, *map(float, told))], columns=["variant", "seed", "n", *names])

    each = sampled_copies(df, key, vector, size, sample, seeds).groupBy("variant", "seed").applyInPandas(one, "variant string, seed int, n long, " + ", ".join(f"{c} double" for c in names))
    spread = [f(F.col(c)).alias(f"{c}_{n}") for c in names[:2] for n, f in (("median", F.median), ("least", F.min), ("most", F.max))]  # a row a seed
    return each.groupBy("variant").agg(*spread, *(F.avg(c).alias(c) for c in names[2:]), F.count("*").alias("seeds"), F.max("n").alias("n"))


# ---- arcs ----------------------------------------------------------------------------------------


def arcs_of(values: np.ndarray, points: int) -> np.ndarray:
    """Rows of values, resampled to points by straight lines, less their own mean."""
    where = np.arange(points) * (values.shape[1] - 1) / (points - 1)
    lo = np.minimum(np.floor(where).astype(int), values.shape[1] - 2)
    made = values[:, lo] + (values[:, lo + 1] - values[:, lo]) * (where - lo)
    return made - made.mean(1, keepdims=True)


def matched_modes(real: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each row of real the place of the row of other that it is matched with: the greatest absolute cosines first, each row once.
    Signs of modes mean nothing, so none is asked for."""
    left, out = np.abs(real @ other.T), np.zeros(len(real), int)
    for _ in range(len(real)):
        i, j = np.unravel_index(np.argmax(left), left.shape)
        out[i] = j
        left[i], left[:, j] = -1.0, -1.0
    return out


def arc_order_control(docs: DataFrame, key: str, values: str, points: int = 20, top: int = 3, draws: int = 30) -> DataFrame:
    """mode, share (of the variance about the mean arc), share_shuffled, cosine (mean absolute, with the matched mode of each draw), p
    (draws whose matched mode has as large a share), ends and ends_shuffled (last less first three points of the mean arc), n: principal
    shapes of arcs beside those of the same documents with their values in random order.

    A document's orders are made in the task that holds it; a draw's sums of products meet, a matrix of points squared from each task.
    """
    rows = docs.where(F.size(values) > 1).select(F.xxhash64(F.col(key).cast("string")).alias("name"), F.col(values).cast("array<double>").alias("v"))

    def run(batches):
        import pyarrow as pa

        total = np.zeros((draws + 1, 1 + points + points * points))
        for batch in batches:
            names, column = np.asarray(batch.column("name")), batch.column("v")
            ends, flat = np.asarray(column.offsets), np.asarray(column.values.fill_null(np.nan), float)
            sizes = np.diff(ends)
            # documents of one length are dealt together
            for n in np.unique(sizes):
                same = np.flatnonzero(sizes == n)
                step = max(1, STEP // ((draws + 1) * max(int(n), points)))
                for lo in range(0, len(same), step):
                    own = same[lo : lo + step]
                    v = flat[ends[own][:, None] + np.arange(n)]
                    known = np.isfinite(v).all(1)
                    own, v = own[known], v[known]
                    if not len(own):
                        continue
                    shape = (draws, len(own), n)
                    to = scattered(np.tile(np.arange(n), len(own)), np.full(len(own) * n, n), np.repeat(names[own], n).view(np.uint64), np.arange(draws)).reshape(shape)
                    dealt = np.empty((draws + 1, len(own), n))
                    dealt[0] = v
                    np.put_along_axis(dealt[1:], to, np.broadcast_to(v, shape), 2)
                    a = arcs_of(dealt.reshape(-1, n), points).reshape(draws + 1, len(own), points)
                    total += np.concatenate([np.full((draws + 1, 1), len(own)), a.sum(1), (a.transpose(0, 2, 1) @ a).reshape(draws + 1, -1)], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws + 1, dtype=np.int32)), pa.array([t.tobytes() for t in total])], names=["draw", "x"])

    def one(ids, pdf):
        import pandas as pd

        t = np.sum([np.frombuffer(x) for x in pdf["x"]], axis=0)
        n, mean = t[0], t[1 : 1 + points] / max(t[0], 1)
        lam, v = np.linalg.eigh(t[1 + points :].reshape(points, points) / max(n, 1) - np.outer(mean, mean))
        order = np.argsort(-lam)[:top]
        return pd.DataFrame([{"draw": ids[0], "n": int(n), "ends": float(mean[-3:].mean() - mean[:3].mean()), "shares": (lam[order] / max(lam.sum(), 1e-300)).tolist(), "modes": v[:, order].T.ravel().tolist()}])

    # a group holds a draw's sums of every task; a row a draw reaches the driver
    each = dealt_out(rows, "name").mapInArrow(run, "draw int, x binary").groupBy("draw").applyInPandas(one, "draw int, n long, ends double, shares array<double>, modes array<double>").orderBy("draw").collect()
    shape = lambda r: np.array(r.modes).reshape(top, points)
    real, rest = each[0], each[1:]
    pairs = [matched_modes(shape(real), shape(r)) for r in rest]
    out = []
    for k in range(top):
        share = [r.shares[p[k]] for r, p in zip(rest, pairs, strict=True)]
        cosine = [abs(float(shape(real)[k] @ shape(r)[p[k]])) for r, p in zip(rest, pairs, strict=True)]
        out.append((k + 1, real.shares[k], float(np.mean(share)), float(np.mean(cosine)), (1 + sum(s >= real.shares[k] for s in share)) / (draws + 1), real.ends, float(np.mean([r.ends for r in rest])), real.n))
    return docs.sparkSession.createDataFrame(out, "mode int, share double, share_shuffled double, cosine double, p double, ends double, ends_shuffled double, n long")


# ---- networks in windows over a calendar ---------------------------------------------------------


def rotated_networks(df: DataFrame, columns: list[str], key: str, day: str, person: str, width: int = 91, step: int = 7, least_rows: int = 150, least_people: int = 5, draws: int = 120, seed: str = "rotation") -> DataFrame:
    """start, n, people, scalar, observed, null_mean, p (two-sided) of network scalars in windows of `width` days every `step` days, where
    enough rows and people fall in, against the rows' values turned round the calendar as a whole: windows keep their sizes, and
    neighbours stay neighbours.

    Ranks are taken once over all rows, so that a window's correlations follow from sums of products. A turn moves a row by a number of
    places; the windows that hold a place follow one another, so a row adds its products where the first begins and takes them off after
    the last, and sums along the windows are all that a turn needs. No window is made from rows again.
    """
    known = df.dropna(subset=columns).select(key, day, person, *columns)
    c = len(columns)
    rank = ranked(known, columns)
    total = rank.count()
    if not total:
        return df.sparkSession.createDataFrame([], f"start {df.schema[day].dataType.simpleString()}, n long, people long, scalar string, observed double, null_mean double, p double")
    x = F.array(*((F.col(f"_r_{v}") - F.lit((total + 1) / 2)) / F.lit(float(total)) for v in columns))
    placed = numbered(rank.select(key, day, x.alias("x")), key, [F.col(day), F.col(key)], ["x"]).select((F.col("number") - 1).alias("place"), "x")
    counts = known.groupBy(day).agg(F.count("*").alias("n")).orderBy(day).collect()  # a row a day
    days = np.array([r[day].toordinal() for r in counts])
    before = np.r_[0, np.cumsum([r.n for r in counts])]
    starts = np.arange(days[0], max(days[0], days[-1] - width + 1) + 1, step)
    first, last = before[np.searchsorted(days, starts)], before[np.searchsorted(days, starts + width)]
    turns = np.r_[0, K.rng_of(seed, total).integers(0, total, draws)]
    upper = np.triu_indices(c)
    q = 1 + c + len(upper[0])
    w = len(starts)

    def run(batches):
        import pyarrow as pa

        sums = np.zeros((draws + 1, w + 1, q))
        for batch in batches:
            v = np.asarray(batch.column("x").flatten(), float).reshape(-1, c)
            place = np.asarray(batch.column("place"))
            terms = np.concatenate([np.ones((len(v), 1)), v, v[:, upper[0]] * v[:, upper[1]]], 1)
            for b, turn in enumerate(turns):
                at = (place + turn) % total
                lo, hi = np.searchsorted(last, at, "right"), np.searchsorted(first, at, "right")  # windows lo .. hi - 1 hold the place
                held = lo < hi
                for edge, sign in ((lo[held], 1.0), (hi[held], -1.0)):
                    flat = (edge[:, None] * q + np.arange(q)).ravel()
                    sums[b] += sign * np.bincount(flat, terms[held].ravel(), (w + 1) * q).reshape(w + 1, q)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, draws, dtype=np.int32)), pa.array([s.tobytes() for s in sums])], names=["draw", "x"])

    ordinals = starts.tolist()

    def one(ids, pdf):
        import pandas as pd

        t = np.sum([np.frombuffer(s).reshape(w + 1, q) for s in pdf["x"]], axis=0).cumsum(0)[:w]
        out = []
        for k in range(w):
            n = round(t[k, 0])
            if n < max(2, least_rows):
                continue
            m = np.zeros((c, c))
            m[upper] = t[k, 1 + c :] / n
            m = m + np.triu(m, 1).T - np.outer(t[k, 1 : 1 + c], t[k, 1 : 1 + c]) / n**2
            sd = np.sqrt(np.maximum(np.diag(m), 0))
            with np.errstate(invalid="ignore", divide="ignore"):
                r = np.nan_to_num(m / np.outer(sd, sd))
            np.fill_diagonal(r, 1.0)
            out += [(ids[0], ordinals[k], int(n), name, v) for name, v in K.network_scalars(r).items()]
        return pd.DataFrame(out, columns=["draw", "at", "n", "scalar", "x"])

    each = dealt_out(placed, "place").mapInArrow(run, "draw int, x binary").groupBy("draw").applyInPandas(one, "draw int, at int, n long, scalar string, x double")
    told = beyond_null(saved(each, "rotations"), ["at", "n", "scalar"])
    begin = F.date_add(F.lit("0001-01-01").cast("date"), F.col("at") - 1)
    grid = df.sparkSession.createDataFrame([(int(s),) for s in starts], "at int").select("at", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("o")).select("at", F.date_add(begin, F.col("o")).alias("_day"))
    people = known.select(F.col(day).alias("_day"), person).distinct().join(F.broadcast(grid), "_day").groupBy("at").agg(F.count_distinct(person).alias("people")).where(F.col("people") >= least_people)
    return told.join(people, "at").select(begin.alias("start"), "n", "people", "scalar", "observed", "null_mean", F.col("p_two_sided").alias("p"))
