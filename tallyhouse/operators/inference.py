"""Regression and variance operators: sums of products are formed by Spark, small systems are solved on what is left.

gram() gives a design's normal equations as one bounded matrix (columns squared, whatever the rows), so the driver never sees rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.arrays import dot
from ..functions.calendar import calendar_design
from ..sources.shared import saved, sized
from .ranks import ranked
from .windows import filled


def gram(df: DataFrame, columns: list[str], weight: str | None = None) -> np.ndarray:
    """Sums of w x_i x_j over rows without NULLs: a matrix of columns squared."""
    w = F.col(weight) if weight else F.lit(1.0)
    c = len(columns)
    known = df.dropna(subset=columns)
    terms = [(i, j) for i in range(c) for j in range(i, c)]
    row = known.agg(*(F.sum(w * F.col(columns[i]) * F.col(columns[j])) for i, j in terms)).first()
    m = np.zeros((c, c))
    for (i, j), v in zip(terms, row, strict=True):
        m[i, j] = m[j, i] = v or 0.0
    return m


def solved(df: DataFrame, y: str, x: list[str], weight: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """beta and the inverse Gram matrix of least squares."""
    g = gram(df, [*x, y], weight)
    inverse = np.linalg.pinv(g[:-1, :-1])
    return inverse @ g[:-1, -1], inverse


def fitted(x: list[str], beta: np.ndarray) -> Column:
    return sum((F.col(c) * float(b) for c, b in zip(x[1:], beta[1:], strict=True)), F.col(x[0]) * float(beta[0]))


def residual(df: DataFrame, y: str, x: list[str], weight: str | None = None, name: str = "resid") -> DataFrame:
    """Adds y less its least-squares fit on x."""
    beta, _ = solved(df, y, x, weight)
    return df.withColumn(name, F.col(y) - fitted(x, beta))


def clustered(df: DataFrame, y: str, x: list[str], clusters: list[list[str]]) -> DataFrame:
    """Each coefficient with its standard error clustered by each entry of `clusters` (a list of columns), and by two ways where two are given: term, beta, se_<k>, se_two_way.

    Scores are summed by cluster where the rows are; only columns-squared sums of products come together.
    """
    beta, inverse = solved(df, y, x)
    rows = df.dropna(subset=[y, *x]).withColumn("_e", F.col(y) - fitted(x, beta))
    scored = rows.withColumns({f"_s{k}": F.col(c) * F.col("_e") for k, c in enumerate(x)})
    n, k = rows.count(), len(x)

    def covariance(by: list[str]) -> np.ndarray:
        sums = scored.groupBy(*by).agg(*(F.sum(f"_s{i}").alias(f"_s{i}") for i in range(k)))
        g = sums.count()
        return inverse @ gram(sums, [f"_s{i}" for i in range(k)]) @ inverse * (g / max(g - 1, 1)) * ((n - 1) / (n - k))

    each = [covariance(by) for by in clusters]
    columns = {f"se_{i}": np.sqrt(np.maximum(np.diag(v), 0)) for i, v in enumerate(each)}
    if len(clusters) == 2:
        both = covariance([*clusters[0], *clusters[1]])
        columns["se_two_way"] = np.sqrt(np.maximum(np.diag(each[0] + each[1] - both), 0))
    out = [(x[i], float(beta[i]), *(float(v[i]) for v in columns.values())) for i in range(k)]
    return df.sparkSession.createDataFrame(out, ", ".join(["term string", "beta double", *(f"{c} double" for c in columns)]))


def demeaned(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Columns less their group's mean: what fixed effects leave."""
    own = Window.partitionBy(*by)
    return df.withColumns({f"{c}_within": F.col(c) - F.avg(c).over(own) for c in columns})


def slope_within(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """One row: the slope of y on x over all rows and within groups."""
    d = demeaned(df, [y, x], by)
    return d.agg(F.regr_slope(y, x).alias("raw"), F.regr_slope(f"{y}_within", f"{x}_within").alias("within"), F.count("*").alias("n"))


def two_way_effects(df: DataFrame, value: str, person: str, day: str, rounds: int = 500, tolerance: float = 1e-10) -> DataFrame:
    """One row on y = person + day + rest on an unbalanced panel: variances and the rest's variance by degrees of freedom.

    With persons' effects put in, days' effects solve a system that is never formed: conjugate gradients ask for its product with a
    vector of days, two sums over the person-day cells, which are written once, by person. Only vectors over the calendar reach the
    driver. A panel that doesn't settle within `rounds` is an error.
    """
    spark = df.sparkSession
    cells = df.where(F.col(value).isNotNull()).groupBy(person, day).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    cells = saved(cells.repartition(person), "two-way-cells")
    kind = cells.schema[day].dataType.simpleString()
    sums = cells.groupBy(day).agg(F.sum("n").alias("w"), F.sum(F.col("n") * F.col("m")).alias("wm")).orderBy(day).collect()  # a row a day
    days = [r[day] for r in sums]
    w, wm = (np.array([float(r[c]) for r in sums]) for c in ("w", "wm"))
    place = {d: k for k, d in enumerate(days)}

    def persons(x: np.ndarray) -> DataFrame:
        """The cells with their day's x as b."""
        b = spark.createDataFrame([(d, float(v)) for d, v in zip(days, x, strict=True)], f"{day} {kind}, b double")
        return cells.join(F.broadcast(b), day)

    def over_days(a: DataFrame) -> np.ndarray:
        out = np.zeros(len(days))
        for r in cells.join(a, person).groupBy(day).agg(F.sum(F.col("n") * F.col("a")).alias("s")).collect():
            out[place[r[day]]] = r["s"]
        return out

    def product(x: np.ndarray) -> np.ndarray:
        return w * x - over_days(persons(x).groupBy(person).agg((F.sum(F.col("n") * F.col("b")) / F.sum("n")).alias("a")))

    beta = np.zeros(len(days))
    n = 0
    if days:
        own = cells.groupBy(person).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("a"))
        rest = wm - over_days(own)
        z = rest / w  # weights of days precondition the system
        p, now = z.copy(), float(rest @ z)
        while np.abs(z).max() > tolerance:
            n += 1
            if n > rounds:
                raise ArithmeticError(f"day effects have not settled after {rounds} rounds")
            q = product(p)
            step = now / float(p @ q) if p @ q > 0 else 0.0
            if not step:
                break
            beta, rest = beta + step * p, rest - step * q
            z = rest / w
            before, now = now, float(rest @ z)
            p = z + now / before * p
        beta = beta - (w @ beta) / w.sum()
    a = persons(beta).groupBy(person).agg((F.sum(F.col("n") * (F.col("m") - F.col("b"))) / F.sum("n")).alias("a"))
    f = persons(beta).join(a, person)
    w_ = F.col("n")
    e = F.sum(F.col("ss") - 2 * w_ * F.col("m") * (F.col("a") + F.col("b")) + w_ * (F.col("a") + F.col("b")) ** 2)

    def var(c):
        return F.sum(w_ * F.col(c) ** 2) / F.sum(w_) - (F.sum(w_ * F.col(c)) / F.sum(w_)) ** 2

    s = f.agg(F.sum(w_).alias("n_obs"), F.count_distinct(person).alias("n_person"), F.count_distinct(day).alias("n_time"), var("a").alias("var_alpha"), var("b").alias("var_beta"), e.alias("ssr"))
    return s.select("n_obs", "n_person", "n_time", F.lit(n).alias("rounds"), "var_alpha", "var_beta", (F.col("ssr") / F.col("n_obs")).alias("var_resid"), (F.col("ssr") / F.greatest(F.col("n_obs") - F.col("n_person") - F.col("n_time") + 1, F.lit(1))).alias("sigma2_dof"))


def daily_residual(df: DataFrame, value: str, day: str = "day", least: int = 20) -> DataFrame:
    """A day's mean less trend, log volume, weekday and season (weights: root of volume), over its standard error, gaps filled: day, resid, observed."""
    d = df.groupBy(day).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n")).where(F.col("n") >= least)
    x = calendar_design(d, day, "n").withColumns({"one": F.lit(1.0), "logn": F.log("n"), "w": F.col("n").cast("double")})
    terms = ["one", "trend", "logn", *(f"dow{k}" for k in range(1, 7)), "s1", "c1", "s2", "c2"]
    r = residual(x, "m", terms, "w").withColumn("resid", F.col("resid") / (F.col("sd") / F.sqrt("n") + 1e-9))
    return filled(r.select(day, "resid"), "resid", day).select(day, F.col("filled").alias("resid"), "observed")


def rank_sum(df: DataFrame, value: str, group: str) -> DataFrame:
    """Mann-Whitney of a 0/1 group: U, rank-biserial, Cohen's d, normal p."""
    r = ranked(df.where(F.col(value).isNotNull()).select(value, group), [value]).withColumnRenamed(f"_r_{value}", "_r")
    g = F.col(group) == 1
    s = r.agg(F.count_if(g).alias("n1"), F.count_if(~g).alias("n0"), F.sum(F.when(g, F.col("_r"))).alias("r1"), F.avg(F.when(g, F.col(value))).alias("m1"), F.avg(F.when(~g, F.col(value))).alias("m0"), F.var_samp(F.when(g, F.col(value))).alias("v1"), F.var_samp(F.when(~g, F.col(value))).alias("v0"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    nn = F.col("n1") * F.col("n0")
    z = (u - nn / 2) / F.sqrt(nn * (F.col("n1") + F.col("n0") + 1) / 12)
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return s.select("n1", "n0", u.alias("u"), (2 * u / nn - 1).alias("rank_biserial"), ((F.col("m1") - F.col("m0")) / pooled).alias("cohen_d"), z.alias("z"))


def gap_of_means(df: DataFrame, by: str, group: str, value: str, first: str, second: str) -> DataFrame:
    """by and gap: mean value of one group less that of another, by person, from sums of decimals, so that equal gaps are equal and no gap is
    0 in whatever order rows are met. A mean with a value that decimals don't hold (not finite, or 1e12 and more) is that of doubles."""
    exact = F.col(value).try_cast("decimal(18,6)")
    sums = []
    for k, g in enumerate((first, second)):
        own = F.col(group) == g
        sums += [F.count(F.when(own, F.col(value))).alias(f"_n{k}"), F.sum(F.when(own, exact)).alias(f"_s{k}"), F.count(F.when(own, exact)).alias(f"_k{k}"), F.avg(F.when(own, F.col(value))).alias(f"_m{k}")]
    n, s = [F.col(f"_n{k}") for k in (0, 1)], [F.col(f"_s{k}") for k in (0, 1)]
    times = [F.col(f"_n{k}").cast("decimal(10,0)") for k in (0, 1)]
    # millionths as whole numbers: below 2^53 both sides of the division are exact, so equal fractions give one double
    millionths = ((s[0] * times[1] - s[1] * times[0]) * 1_000_000).cast("double") / (n[0] * n[1]).cast("double")
    whole = (F.col("_n0") == F.col("_k0")) & (F.col("_n1") == F.col("_k1"))
    gap = F.when((n[0] > 0) & (n[1] > 0), F.when(whole, millionths / 1e6).otherwise(F.col("_m0") - F.col("_m1")))
    return df.groupBy(by).agg(*sums).select(by, gap.alias("gap"))


def signed_rank(pairs: DataFrame, gap: str) -> DataFrame:
    """Wilcoxon's signed rank of paired differences: n, w_plus, z."""
    d = pairs.where(F.col(gap).isNotNull() & (F.col(gap) != 0)).withColumn("_a", F.abs(gap))
    r = ranked(d.select(gap, "_a"), ["_a"]).withColumnRenamed("_r__a", "_r")
    s = r.agg(F.count("*").alias("n"), F.sum(F.when(F.col(gap) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"))
    n = F.col("n")
    return s.withColumn("z", (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24))


def first_component(panel: DataFrame, key: str, columns: list[str], sign: str) -> DataFrame:
    """key and wave: the first principal component of standardised columns, turned so that it goes with `sign`."""
    known = panel.dropna(subset=columns)
    s = known.agg(*(f(c).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    z = known.withColumns({f"_z{k}": (F.col(c) - F.lit(s[f"m{k}"])) / F.lit(s[f"s{k}"] or 1.0) for k, c in enumerate(columns)})
    names = [f"_z{k}" for k in range(len(columns))]
    v = np.linalg.eigh(gram(z, names))[1][:, -1]
    if v[columns.index(sign)] < 0:
        v = -v
    return z.select(key, dot(F.array(*names), F.array(*(F.lit(float(x)) for x in v))).alias("wave"))


def half_states(df: DataFrame, value: str, person: str, half: Column) -> DataFrame:
    """Leave-one-out deviations made anew inside each half: df with half and dev."""
    h = df.withColumn("half", half)
    own = Window.partitionBy("half", person)
    n, s = F.count(value).over(own), F.sum(value).over(own)
    return h.withColumn("dev", F.when(n > 1, F.col(value) - (s - F.col(value)) / (n - 1)))


def design_f(df: DataFrame, value: str, design: list[str], nested: list[str]) -> DataFrame:
    """F of the columns `nested` within `design` (a constant is added): f, p, df1, df2."""
    rows = df.withColumn("one", F.lit(1.0)).dropna(subset=[value, *design])

    def ssr(x: list[str]) -> tuple[float, int]:
        g = gram(rows, [*x, value])
        inverse = np.linalg.pinv(g[:-1, :-1])
        return float(g[-1, -1] - g[:-1, -1] @ inverse @ g[:-1, -1]), int(np.linalg.matrix_rank(g[:-1, :-1]))

    n = rows.count()
    full, k = ssr(["one", *design])
    less, j = ssr(["one", *(c for c in design if c not in nested)])
    d1, d2 = k - j, n - k
    f = ((less - full) / max(d1, 1)) / (full / max(d2, 1)) if full > 0 else float("nan")
    return df.sparkSession.createDataFrame([(float(f), float(K.f_p(f, d1, d2)) if f == f and d1 > 0 else None, d1, d2)], "f double, p double, df1 int, df2 int")


#: Bins of a score between 0 and 1 in which rows are counted for its AUC; rows of one bin count as ties.
SCORE_BINS = 1 << 16


def folded_auc(rows: DataFrame, features: list[str], label: str, fold: str, by: list[str] | None = None, ridge: float = 1.0, rounds: int = 25) -> DataFrame:
    """by, auc, n: how well a ridge logistic regression of label (0/1) on features, standardised and fitted on the other folds, tells rows apart.

    Every fold's model is fitted in the same passes, by Newton steps on summed gradients, so that only sums of columns squared move.
    """
    by = by or []
    p = len(features) + 1
    base = saved(rows.dropna(subset=features).select(*by, F.col(fold).alias("_fold"), F.col(label).cast("double").alias("_y"), *features), "auc-rows")
    joined = saved(base.select(*by, F.col("_fold").alias("_out")).distinct(), "auc-folds")

    def placed(inside: bool) -> DataFrame:
        on = [F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}")) for b in by]
        on.append(F.col("l._fold") == F.col("r._out") if inside else F.col("l._fold") != F.col("r._out"))
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        return base.alias("l").join(F.broadcast(joined).alias("r"), cond).select("l.*", "r._out")  # a few folds a group

    train = placed(False)
    keys = [*by, "_out"]
    scale = saved(train.groupBy(*keys).agg(*(F.avg(f).alias(f"_m{k}") for k, f in enumerate(features)), *(F.stddev_pop(f).alias(f"_s{k}") for k, f in enumerate(features))), "auc-scale")
    key_of = lambda r: tuple(r[k] for k in keys)
    models = {key_of(r): np.zeros(p) for r in scale.collect()}  # a row for each group and fold
    kinds = ", ".join(f"{k} {scale.schema[k].dataType.simpleString()}" for k in keys)

    def with_score(frame: DataFrame) -> DataFrame:
        beta = base.sparkSession.createDataFrame([(*k, *map(float, b)) for k, b in models.items()], kinds + "".join(f", _b{k} double" for k in range(p)))
        one = scale
        for part in (sized(one), F.broadcast(beta)):
            on = None
            for k in keys:
                c = frame[k].eqNullSafe(part[k])
                on = c if on is None else on & c
            frame = frame.join(part, on).drop(*(part[k] for k in keys))
        z = [F.lit(1.0), *((F.col(f) - F.col(f"_m{k}")) / F.when(F.col(f"_s{k}") > 0, F.col(f"_s{k}")).otherwise(1.0) for k, f in enumerate(features))]
        frame = frame.withColumns({f"_z{k}": c for k, c in enumerate(z)})
        return frame.withColumn("_p", 1 / (1 + F.exp(-sum((F.col(f"_z{k}") * F.col(f"_b{k}") for k in range(1, p)), F.col("_b0")))))

    penalty = ridge * np.diag([0.0, *[1.0] * (p - 1)])
    for _ in range(rounds if models else 0):
        w = F.col("_p") * (1 - F.col("_p"))
        sums = with_score(train).groupBy(*keys).agg(*(F.sum((F.col("_y") - F.col("_p")) * F.col(f"_z{i}")).alias(f"g{i}") for i in range(p)), *(F.sum(w * F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"h{i}_{j}") for i in range(p) for j in range(i + 1)))
        moved = 0.0
        for r in sums.collect():
            h = np.zeros((p, p))
            for i in range(p):
                for j in range(i + 1):
                    h[i, j] = h[j, i] = r[f"h{i}_{j}"]
            beta = models[key_of(r)]
            step = np.linalg.solve(h + penalty + 1e-9 * np.eye(p), np.array([r[f"g{i}"] for i in range(p)]) - penalty @ beta)
            models[key_of(r)] = beta + np.clip(step, -3, 3)
            moved = max(moved, float(abs(step).max()))
        if moved < 1e-8:
            break
    # Mann-Whitney over bins, within folds, and folds together by their numbers of pairs
    bins = with_score(placed(True)).groupBy(*keys, F.floor(F.col("_p") * (SCORE_BINS - 1)).alias("_bin")).agg(F.sum("_y").alias("_one"), F.sum(1 - F.col("_y")).alias("_zero"))
    below = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    ranked = bins.withColumn("_below", F.coalesce(F.sum("_zero").over(below), F.lit(0.0)))
    each = ranked.groupBy(*keys).agg(F.sum(F.col("_one") * (F.col("_below") + F.col("_zero") / 2)).alias("_wins"), (F.sum("_one") * F.sum("_zero")).alias("_pairs"), F.sum(F.col("_one") + F.col("_zero")).alias("_n"))
    return each.groupBy(*by).agg((F.sum("_wins") / F.sum("_pairs")).alias("auc"), F.sum("_n").cast("long").alias("n"))
