"""Joins beyond keys: calendars, event windows, exclusions, lags, neighbourhoods, nearest vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import dot


def outer_chain(panels: list[DataFrame], key: str = "week") -> DataFrame:
    """Full outer join of series tables on their calendar."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), panels)


def aligned(y: DataFrame, x: DataFrame, key: str = "week") -> DataFrame:
    """Rows (key, y, x) of both series without NULLs, numbered in order."""
    both = y.select(key, "y").join(x.select(key, "x"), key).where("y IS NOT NULL AND x IS NOT NULL")
    return both.withColumn("t", F.row_number().over(Window.orderBy(key)))  # a row for each week of the common calendar


def lagged(pairs: DataFrame, most: int = 8, least: int = 12) -> DataFrame:
    """Correlation of y at t with x at t - lag for lags -most..most, by position: lag, r, n."""
    lags = F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")
    y = pairs.select("t", "y", lags).withColumn("at", F.col("t") - F.col("lag"))
    x = pairs.select(F.col("t").alias("at"), "x")
    return y.join(x, "at").groupBy("lag").agg(F.corr("y", "x").alias("r"), F.count("*").alias("n")).where(F.col("n") >= least)


def near_days(events: DataFrame, before: int, after: int, day: str = "day") -> DataFrame:
    """Each event with every day of its window: event, offset, day. An interval join without a nested loop, at window times events rows."""
    offset = F.explode(F.sequence(F.lit(before), F.lit(after))).alias("offset")
    return events.select(F.col(day).alias("event"), offset).withColumn(day, F.date_add("event", F.col("offset")))


def outside_buffer(days: DataFrame, events: DataFrame, buffer: int, day: str = "day") -> DataFrame:
    """Days further than `buffer` days from every event."""
    return days.join(near_days(events, -buffer, buffer, day).select(day).distinct(), day, "left_anti")


def matched_controls(days: DataFrame, events: DataFrame, k: int = 5, buffer: int = 10, seed: int = 0, day: str = "day") -> DataFrame:
    """For each event day in the pool up to k days of its weekday, month and tercile, outside the buffer, by a seeded hash: event, control."""
    pool = outside_buffer(days, events, buffer, day)
    anchor = days.join(events.select(day).distinct(), day, "left_semi").select(F.col(day).alias("event"), "weekday", "month", "tercile")
    both = anchor.join(pool.select(F.col(day).alias("control"), "weekday", "month", "tercile"), ["weekday", "month", "tercile"])
    mixed = F.pmod((F.datediff("control", F.lit("1970-01-01").cast("date")).cast("long") * 2654435761 + F.datediff("event", F.lit("1970-01-01").cast("date")).cast("long") * 40503 + seed), F.lit(4294967296))
    turn = F.row_number().over(Window.partitionBy("event").orderBy(mixed, "control"))
    return both.withColumn("_n", turn).where(F.col("_n") <= k).select("event", "control")


def window_mask(days: DataFrame, events: DataFrame, windows: dict[str, tuple[int, int]], day: str = "day") -> DataFrame:
    """Days with one 0/1 column for each window: whether any event's window holds them (a day counts once)."""
    for name, (lo, hi) in windows.items():
        held = near_days(events, lo, hi, day).select(day).distinct().withColumn(name, F.lit(1))
        days = days.join(held, day, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return days


def neighbourhood(units: DataFrame, within: int = 56, same_weekday: bool = True, day: str = "day") -> DataFrame:
    """For each day the other days at most `within` days away, on the same weekday if asked: day, other. By buckets of `within` days, not by all pairs."""
    start = F.lit("1970-01-01").cast("date")
    days = units.select(day).distinct().withColumns({"d": F.datediff(day, start), "w": F.weekday(day) if same_weekday else F.lit(0)})
    left = days.withColumn("b", F.explode(F.array(*(F.floor(F.col("d") / within) + k for k in (-1, 0, 1)))))
    right = days.select(F.col(day).alias("other"), F.col("d").alias("e"), "w", F.floor(F.col("d") / within).alias("b"))
    gap = F.abs(F.col("d") - F.col("e"))
    return left.join(right, ["b", "w"]).where((gap > 0) & (gap <= within)).select(day, "other")


def adjacent_periods(df: DataFrame, person: str, period: str, lag: int = 1) -> DataFrame:
    """Rows of a person in two periods that stand `lag` apart in the list of periods: person, p0, p1 and both rows' columns with _0, _1."""
    numbered = df.join(df.select(period).distinct().withColumn("_i", F.row_number().over(Window.orderBy(period))), period)  # a row for each period
    rest = [c for c in df.columns if c not in (person, period)]
    a = numbered.select(person, F.col(period).alias("p0"), F.col("_i").alias("i0"), *(F.col(c).alias(f"{c}_0") for c in rest))
    b = numbered.select(person, F.col(period).alias("p1"), (F.col("_i") - lag).alias("i0"), *(F.col(c).alias(f"{c}_1") for c in rest))
    return a.join(b, [person, "i0"]).drop("i0")


#: Rows of either side that a task holds at once where all of one side meet all of the other.
BLOCK_ROWS = 2048
#: Queries that meet as many base rows at once where every pair is a row of the result.
PAIR_QUERIES = 256


def in_blocks(queries: DataFrame, base: DataFrame, fn, schema: str, query_rows: int | None = None) -> DataFrame:
    """fn(queries, base) as pandas frames for every block of BLOCK_ROWS (or query_rows) queries and of BLOCK_ROWS base rows, by cogroups of two hashes: nothing is broadcast, no group grows with the data."""
    blocks = [max(1, -(-side.count() // rows)) for side, rows in ((queries, query_rows or BLOCK_ROWS), (base, BLOCK_ROWS))]

    def dealt(side: DataFrame, own: int) -> DataFrame:
        key = F.pmod(F.xxhash64(*side.columns[:1]), F.lit(blocks[own])).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.lit(blocks[1 - own] - 1)))
        return side.select("*", key.alias(f"_{own}"), other.alias(f"_{1 - own}"))

    return dealt(queries, 0).groupBy("_0", "_1").cogroup(dealt(base, 1).groupBy("_0", "_1")).applyInPandas(lambda q, b: fn(q, b), schema)


def cosine_links(rows: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """Links a, b between rows with a cosine above `least` that give the components of all such pairs: every two blocks meet once, and each meeting gives a spanning forest of its pairs."""
    from ..functions import kernels as K

    kind = rows.schema[key].dataType.simpleString()
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    own = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    a = rows.select(F.col(key).alias("a"), F.col(vector).alias("_x"), own.alias("_i")).withColumn("_j", F.explode(F.sequence(F.col("_i"), F.lit(n - 1))))
    b = rows.select(F.col(key).alias("b"), F.col(vector).alias("_y"), own.alias("_j")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_j"))))

    def links(p, q):
        import numpy as np
        import pandas as pd

        if not len(p) or not len(q):
            return pd.DataFrame(columns=["a", "b"])
        x, y = (np.stack(v.to_numpy()).astype(float) for v in (p["_x"], q["_y"]))
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
        one, two = p["a"].to_numpy(), q["b"].to_numpy()
        found = K.block_links((x @ y.T > least) & (one[:, None] != two[None]))
        return pd.DataFrame({"a": one[[i for i, _ in found]], "b": two[[j for _, j in found]]}) if found else pd.DataFrame(columns=["a", "b"])

    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInPandas(links, f"a {kind}, b {kind}")


def cosines_to_all(queries: DataFrame, base: DataFrame, key: str, vector: str, least: float | None = None) -> DataFrame:
    """Cosines of every query with every base row but itself, in blocks: key, other, sim; with least, those of that size or more, so that
    what leaves a block is links, not pairs; without, blocks are of PAIR_QUERIES queries, since every pair of a block is a row in memory."""
    kind = base.schema[key].dataType.simpleString()

    def pairs(q, b):
        import numpy as np
        import pandas as pd

        if not len(q) or not len(b):
            return pd.DataFrame(columns=[key, "other", "sim"])
        x, y = (np.stack(v.to_numpy()).astype(float) for v in (q[vector], b["_v"]))
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
        own, others = q[key].to_numpy(), b["other"].to_numpy()
        sim, held = x @ y.T, own[:, None] != others[None]
        i, j = np.nonzero(held if least is None else held & (sim >= least))
        return pd.DataFrame({key: own[i], "other": others[j], "sim": sim[i, j]})

    others = base.select(F.col(key).alias("other"), F.col(vector).alias("_v"))
    return in_blocks(queries.select(key, vector), others, pairs, f"{key} {kind}, other {kind}, sim double", PAIR_QUERIES if least is None else None)


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The k nearest base rows of each query by cosine to 12 decimals (ties by key), itself left out: key, other, sim, rank. Each block gives its k best, those are ranked."""
    kind = base.schema[key].dataType.simpleString()

    def best(q, b):
        import numpy as np
        import pandas as pd

        if not len(q) or not len(b):
            return pd.DataFrame(columns=[key, "other", "sim"])
        b = b.sort_values(key)
        x, y = (np.stack(d[vector].to_numpy()).astype(float) for d in (q, b))
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
        sim, others = np.round(x @ y.T, 12), b[key].to_numpy()
        sim[q[key].to_numpy()[:, None] == others[None]] = -np.inf
        m = min(k, len(b))
        # all above the m-th greatest, and of those equal to it the least keys (b comes in their order)
        least = -np.partition(-sim, m - 1, axis=1)[:, m - 1 : m]
        above, equal = sim > least, sim == least
        i, j = np.nonzero(above | (equal & (equal.cumsum(1) <= m - above.sum(1, keepdims=True))))
        out = pd.DataFrame({key: q[key].to_numpy()[i], "other": others[j], "sim": sim[i, j]})
        return out[np.isfinite(out["sim"])]

    found = in_blocks(queries.select(key, vector), base.select(key, vector), best, f"{key} {kind}, other {kind}, sim double")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("sim"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def drop_near_own(test: DataFrame, train: DataFrame, key: str, person: str, vector: str, most: float = 0.98) -> DataFrame:
    """Test rows whose greatest cosine to the same person's training rows is at most `most`. Every row meets all of its person's, in blocks
    that hold the rows of persons of one hash; vectors with a NULL in them, of another length or of zeros have no cosine."""
    whole = lambda side, *columns: side.select(*columns, F.size(vector).alias("_l")).where(F.forall(vector, lambda x: x.isNotNull()) & F.exists(vector, lambda x: x != 0) & F.col(person).isNotNull())
    t, v = whole(test, F.col(key).alias("_k"), person, vector), whole(train, F.xxhash64(key).alias("_k"), person, vector)
    buckets = max(1, -(-v.count() // BLOCK_ROWS))
    bucket = F.pmod(F.xxhash64(person, "_l"), F.lit(buckets)).alias("_b")
    t, v = t.select("*", bucket), v.select("*", bucket)
    blocks = [max(1, -(-(side.groupBy("_b").count().agg(F.max("count")).first()[0] or 0) // BLOCK_ROWS)) for side in (t, v)]

    def dealt(side: DataFrame, own: int) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0), F.lit(blocks[1 - own] - 1)))
        return side.select("*", F.pmod(F.xxhash64("_k"), F.lit(blocks[own])).cast("int").alias(f"_{own}"), other.alias(f"_{1 - own}"))

    def closest(q, b):
        import numpy as np
        import pandas as pd

        if not len(q) or not len(b):
            return pd.DataFrame(columns=["_k", "closest"])
        x, y = (np.stack(side[vector].to_numpy()).astype(float) for side in (q, b))
        sim = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None])
        best = np.where(q[person].to_numpy()[:, None] == b[person].to_numpy()[None], sim, -np.inf).max(1)
        return pd.DataFrame({"_k": q["_k"], "closest": best})[~np.isneginf(best)]

    keys = ["_b", "_l", "_0", "_1"]
    met = dealt(t, 0).groupBy(*keys).cogroup(dealt(v, 1).groupBy(*keys)).applyInPandas(closest, f"_k {test.schema[key].dataType.simpleString()}, closest double")
    seen = met.groupBy(F.col("_k").alias(key)).agg(F.max("closest").alias("closest"))
    return test.join(seen, key, "left").where(F.coalesce("closest", F.lit(-1.0)) <= most).drop("closest")


def rank_of_true(test: DataFrame, centroids: DataFrame, key: str, person: str, vector: str) -> DataFrame:
    """For each test row the rank of its own person's centroid among all by dot product (ties by person): key, person, rank. In blocks, whose counts add up."""
    c = centroids.select(F.col(person).alias("_p"), F.col(vector).alias("_c"))
    t = test.select(F.col(key).alias(key), F.col(person).alias(person), F.col(vector).alias(vector))
    own = t.join(c, F.col(person) == F.col("_p")).select(key, person, vector, dot(F.col(vector), F.col("_c")).alias("_own"))
    kinds = {n: test.schema[n].dataType.simpleString() for n in (key, person)}

    def better(q, b):
        import numpy as np
        import pandas as pd

        if not len(q) or not len(b):
            return pd.DataFrame(columns=[key, person, "n"])
        sim = np.stack(q[vector].to_numpy()).astype(float) @ np.stack(b["_c"].to_numpy()).astype(float).T
        mine, who = q["_own"].to_numpy()[:, None], b["_p"].to_numpy()[None]
        same = who == q[person].to_numpy()[:, None]
        above = (sim > mine + 1e-12) | ((np.abs(sim - mine) <= 1e-12) & (who < q[person].to_numpy()[:, None]))
        return pd.DataFrame({key: q[key], person: q[person], "n": (above & ~same).sum(1)})

    again = centroids.select(F.col(person).alias("_p"), F.col(vector).alias("_c"))
    counts = in_blocks(own, again, better, f"{key} {kinds[key]}, {person} {kinds[person]}, n long")
    return counts.groupBy(key, person).agg((F.sum("n") + 1).alias("rank"))


def identification(ranks: DataFrame, people: int) -> DataFrame:
    r = F.col("rank")
    top1 = F.avg((r == 1).cast("int"))
    return ranks.agg(F.count("*").alias("n"), top1.alias("top1"), F.avg((r <= 5).cast("int")).alias("top5"), F.avg(1 / r).alias("mrr"), (top1 * people).alias("lift"))
