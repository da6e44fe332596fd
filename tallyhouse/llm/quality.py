"""Quality rules (operator 10), in DataFrame functions only.

Fixed rules fail texts that are short or repeat themselves. For the others a vector of transformed statistics (symbol share, word
length, capitals, repetition, richness of vocabulary) is held against a minimum-covariance-determinant estimate of its language and
source. Three starts (medians with quartile ranges; the covariance of directions from the median; mean and covariance of all) each
take TRIALS concentration steps, which keep the three quarters of the vectors that lie nearest and estimate mean and covariance from
those alone; the start with the least determinant goes on until its determinant settles. So outliers don't shape what they are judged
by. A text is rejected whose squared Mahalanobis distance passes the cutoff.

No estimate is narrower than NOISE, what chance does to texts of MIN_WORDS words. Where texts are longer, they scatter less than that, so
distances are smaller than chi-square's (their median is 0.3 on sf0.1, not 4.35) and CUTOFF, chi-square's quantile of 0.9999, is a
bound on how many ordinary texts are lost, not their expected number; where texts scatter more, distances are scaled down to chi-square's
median. A rule without NOISE would reject one ordinary text in ten there, whose statistics merely lie beyond three quarters of very like
ones.

A language's and source's estimate is shrunk towards its language's, that towards all texts', and that towards NOISE, each as if
PRIOR_ROWS rows stood for the wider one. The wider estimates start from the kept three quarters of all their sources together and take
steps of their own. So one rule holds at all sizes: a source of a few texts is judged by its language, and in a table of a few texts hardly any lies far enough out
to be rejected.

A step is one pass: counts and exact sums of statistics in whole units by stratum, start and bin of distance, merged before they move;
the nearest bins' sums give the next estimate. Sums don't depend on the order of tasks, so verdicts are the same in every run. Rows
never move: each pass reads the statistics and meets the estimates, a row a stratum and start, in a broadcast join once they have been
measured (in a sort-merge join with skew splitting if there are too many sources for that).

Defined results: null and empty texts have no words and fail the base rules; null languages and sources are values of their own;
repeated rows count each; very long texts are measured whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, dropped, saved, sized

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
PRIOR_ROWS = 50
KEEP_SHARE = 0.75
#: Steps of each start, and of the best one at most; it has settled where no determinant's logarithm changes by more than this (a bin of
#: distances holds some per cent of the rows, so determinants move by about as much in the end).
TRIALS, MOST_STEPS, SETTLED = 2, 3, 1e-2
#: How much of a distance's doubling is one bin of a step.
STEP_BINS = 16
#: Statistics are kept as whole multiples of this.
UNIT = 1e-6
#: Letters of a usual word, and how much more the counts of a text scatter than independent ones would.
LETTERS, BURST = 6, 2
#: The standard deviation that each statistic has by chance in a text of MIN_WORDS words: of a root of a share sqrt(x / n) it is
#: 1 / (2 sqrt(n)), however large the share (a repeated window covers six words or more); of the logarithm of a mean word length a
#: word's variation (0.6) / sqrt(n); of log(distinct) / log(n) at most 0.5 / (sqrt(n) log(n)). No estimate is narrower than that.
NOISE = {
    "symbols": BURST / (2 * math.sqrt(LETTERS * MIN_WORDS)),
    "word_length": 0.6 / math.sqrt(MIN_WORDS),
    "capitals": BURST / (2 * math.sqrt(LETTERS * MIN_WORDS)),
    "repeats": math.sqrt(6) / (2 * math.sqrt(MIN_WORDS)),
    "richness": BURST * 0.5 / (math.sqrt(MIN_WORDS) * math.log(MIN_WORDS)),
}
NAMES = list(NOISE)
SIZE = len(NAMES)
#: Quantiles of chi-square with five degrees of freedom: 0.5 and 0.9999.
MEDIAN, CUTOFF = 4.351, 25.745
#: Bins to one unit of a statistic, and to a doubling of a distance.
FINE, PER_DOUBLING = 1024, 64


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, however often the body's own lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeat_words(words_: Column) -> Column:
    """How many words stand in a three-word window that is found twice or more."""

    def counted(w: Column) -> Column:
        def in_windows(h: Column) -> Column:
            def ranked(s: Column) -> Column:
                def same(k: Column, other: Column) -> Column:
                    return F.coalesce(F.get(s, k)["h"] == F.get(s, other)["h"], F.lit(False))

                found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
                at = F.transform(found, lambda k: F.get(s, k)["p"])
                return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

            return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(F.sort_array(F.transform(h, lambda x, p: F.struct(x.alias("h"), p.alias("p")))), ranked))

        return _let(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), in_windows)

    return F.when(F.size(words_) < 4, 0).otherwise(_let(words_, counted)).cast("long")


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base columns, base_failed and the statistics."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", "lang", "source", text.alias("text"), words(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = split.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        _without(F.col("text"), " \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.char_length("text") - _without(F.col("text"), "#*$%&|<>")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_capitals"),
    )
    def whole(x: Column, name: str) -> Column:
        return F.round(x / UNIT).cast("long").alias(name)

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    n, chars = F.greatest("n_words", F.lit(2)), F.greatest("word_chars", F.lit(1))
    return base.select(
        *base.columns[:8],
        failed.alias("base_failed"),
        whole(F.sqrt(F.col("n_symbols") / chars), "symbols"),
        whole(F.log(chars / n), "word_length"),
        whole(F.sqrt(F.col("n_capitals") / chars), "capitals"),
        whole(F.sqrt(F.col("n_repeat_words") / n), "repeats"),
        whole(F.log(F.greatest("n_distinct", F.lit(1))) / F.log(n), "richness"),
    )


def strata() -> list[Column]:
    """A row's language and source, its language, and all: what estimates it takes part in, from narrow to wide."""
    lang, source = (F.coalesce(F.col(c), F.lit("\x00")) for c in ("lang", "source"))
    return [F.concat(lang, F.lit("\x1f"), source), F.concat(lang, F.lit("\x1e")), F.lit("\x1d")]


def _quantiles(counts: DataFrame, keys: list[str], **shares: float) -> DataFrame:
    """keys, n and the bin in which each share is reached, from counts (keys, bin, n) of a fixed number of bins."""
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy(*keys))})
    return ranked.groupBy(*keys).agg(F.max("all").alias("n"), *(F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("bin"))).alias(name) for name, share in shares.items()))


def _quartiles(rows: DataFrame) -> DataFrame:
    """stratum, n, and each statistic's median m_i and robust spread s_i (the range of its quartiles as a standard deviation's)."""
    one = rows.select("stratum", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(v * FINE).alias("bin")) for i, v in enumerate(_statistics())))).alias("x"))
    counts = one.groupBy("stratum", "x.i", "x.bin").agg(F.count("*").alias("n"))
    found = _quantiles(counts, ["stratum", "i"], low=0.25, half=0.5, high=0.75)
    of = lambda i, c: F.max(F.when(F.col("i") == i, c))
    middle, spread = (F.col("half") + 0.5) / FINE, (F.col("high") - F.col("low")) / (FINE * 1.349)
    return found.groupBy("stratum").agg(*(of(i, middle).alias(f"m_{i}") for i in range(SIZE)), *(of(i, spread).alias(f"s_{i}") for i in range(SIZE)))


def _statistics() -> list[Column]:
    return [F.col(n) * UNIT for n in NAMES]


def _bin(d2: Column, per_doubling: int = PER_DOUBLING) -> Column:
    return F.floor(per_doubling * F.log2(1 + 64 * d2))


def _upper(bin_: Column) -> Column:
    """The distance at which a bin ends."""
    return (F.pow(F.lit(2.0), (bin_ + 1) / PER_DOUBLING) - 1) / 64


def factored(moments: DataFrame) -> DataFrame:
    """Adds the lower Cholesky factor l_i_j of each covariance with NOISE added."""

    def rest(i: int, j: int) -> Column:
        left = F.col(f"c_{i}_{j}") + (F.lit(NOISE[NAMES[i]] ** 2) if i == j else F.lit(0.0))
        for k in range(j):
            left = left - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        return left

    for j in range(SIZE):
        moments = moments.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(rest(j, j), F.lit(1e-12))))
        if j + 1 < SIZE:
            moments = moments.withColumns({f"l_{i}_{j}": rest(i, j) / F.col(f"l_{j}_{j}") for i in range(j + 1, SIZE)})
    return moments


def distance(rows: DataFrame) -> DataFrame:
    """Adds d2 to rows that carry their stratum's m_i and l_i_j."""
    for i, x in enumerate(_statistics()):
        z = x - F.col(f"m_{i}")
        for k in range(i):
            z = z - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        rows = rows.withColumn(f"z_{i}", z / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d2", sum((F.col(f"z_{i}") ** 2 for i in range(1, SIZE)), F.col("z_0") ** 2))


PAIRS = [(i, j) for i in range(SIZE) for j in range(i + 1)]
_SUMS = ["n", *(f"s_{i}" for i in range(SIZE)), *(f"{part}_{i}_{j}" for i, j in PAIRS for part in ("hi", "lo"))]


def _sums(values: list[Column]) -> list[Column]:
    """Count, sums and sums of products (in two parts, so that they stay exact) of whole numbers."""
    out = [F.count("*").alias("n"), *(F.sum(v).alias(f"s_{i}") for i, v in enumerate(values))]
    for i, j in PAIRS:
        product = values[i] * values[j]
        out += [F.sum(F.shiftright(product, 24)).alias(f"hi_{i}_{j}"), F.sum(product.bitwiseAND((1 << 24) - 1)).alias(f"lo_{i}_{j}")]
    return out


def _estimate(sums: DataFrame, *keys: str) -> DataFrame:
    """keys, n, means m_i and covariances c_i_j, from exact sums."""
    n = F.col("n").cast("double")
    product = lambda i, j: F.col(f"hi_{i}_{j}").cast("double") * float(1 << 24) + F.col(f"lo_{i}_{j}")
    means = [(F.col(f"s_{i}") / n * UNIT).alias(f"m_{i}") for i in range(SIZE)]
    spread = [((product(i, j) - F.col(f"s_{i}").cast("double") / n * F.col(f"s_{j}")) / n * UNIT * UNIT).alias(f"c_{i}_{j}") for i, j in PAIRS]
    return sums.select(*keys, "n", *means, *spread)


def _determined(moments: DataFrame) -> DataFrame:
    """factored(), and the logarithm of the determinant."""
    return factored(moments).withColumn("logdet", sum((2 * F.log(f"l_{i}_{i}") for i in range(1, SIZE)), 2 * F.log("l_0_0")))


_FITTED = [*_SUMS, *(f"m_{i}" for i in range(SIZE)), *(f"c_{i}_{j}" for i, j in PAIRS), *(f"l_{i}_{j}" for i, j in PAIRS), "logdet"]


def _starts(rows: DataFrame) -> DataFrame:
    """stratum, start, m_i and l_i_j of the three starts, after one pass for quartiles and one for sums."""
    middle = saved(_quartiles(rows), "quality-quartiles")
    spread = lambda i: F.sqrt(F.col(f"s_{i}") ** 2 + NOISE[NAMES[i]] ** 2)
    z = [(x - F.col(f"m_{i}")) / spread(i) for i, x in enumerate(_statistics())]
    length = F.sqrt(sum((v * v for v in z[1:]), z[0] * z[0]))
    turned = [F.round(F.when(length > 0, v / length).otherwise(0.0) / UNIT).cast("long") for v in z]
    met = rows.join(sized(middle), "stratum").select("stratum", *NAMES, *(t.alias(f"u_{i}") for i, t in enumerate(turned)))
    plain = _sums([F.col(n) for n in NAMES])
    signs = [c.alias(f"u_{n}") for c, n in zip(_sums([F.col(f"u_{i}") for i in range(SIZE)]), _SUMS, strict=True)]
    sums = saved(met.groupBy("stratum").agg(*plain, *signs), "quality-start-sums")
    about = _estimate(sums.select("stratum", *(F.col(f"u_{n}").alias(n) for n in _SUMS)), "stratum").drop("n")
    # of directions: their products about 0, SIZE times, in units of the spreads
    wide = middle.join(about.withColumnsRenamed({f"m_{i}": f"um_{i}" for i in range(SIZE)} | {f"c_{i}_{j}": f"uc_{i}_{j}" for i, j in PAIRS}), "stratum")
    zero = F.lit(0.0)
    own = [F.col(f"m_{i}") for i in range(SIZE)]
    one = wide.select("stratum", F.lit(0).alias("start"), *own, *((F.col(f"s_{i}") ** 2 if i == j else zero).alias(f"c_{i}_{j}") for i, j in PAIRS))
    two = wide.select("stratum", F.lit(1).alias("start"), *own, *((SIZE * (F.col(f"uc_{i}_{j}") + F.col(f"um_{i}") * F.col(f"um_{j}")) * F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"c_{i}_{j}") for i, j in PAIRS))
    three = _estimate(sums, "stratum").select("stratum", F.lit(2).alias("start"), *own, *(f"c_{i}_{j}" for i, j in PAIRS))
    return _determined(one.unionByName(two).unionByName(three))


def _step(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """The estimate, by stratum and start, from the share of rows that lies nearest by the one given: one pass."""
    placed = estimate.select("stratum", "start", *(f"m_{i}" for i in range(SIZE)), *(f"l_{i}_{j}" for i, j in PAIRS))
    placed.saved_at = estimate.saved_at  # fewer columns of the same files
    far = distance(rows.join(sized(placed), "stratum"))
    bins = far.groupBy("stratum", "start", _bin(F.col("d2"), STEP_BINS).alias("bin")).agg(*_sums([F.col(n) for n in NAMES]))
    own = Window.partitionBy("stratum", "start")
    upto = F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    near = bins.withColumns({"upto": upto, "all": F.sum("n").over(own)}).where(F.col("upto") - F.col("n") < KEEP_SHARE * F.col("all"))
    core = near.groupBy("stratum", "start").agg(*(F.sum(c).alias(c) for c in _SUMS))
    made = _estimate(core, "stratum", "start").drop("n").join(core, ["stratum", "start"])
    return saved(_determined(made).select("stratum", "start", *_FITTED), "quality-step")


def _least(steps: DataFrame) -> DataFrame:
    """The row of the least determinant of each stratum (ties: the first start)."""
    best = F.min_by(F.struct("start", *_FITTED), F.struct("logdet", "start")).alias("best")
    return steps.groupBy("stratum").agg(best).select("stratum", "best.*")


def concentrated(rows: DataFrame, wider: tuple[str, ...] = ()) -> DataFrame:
    """stratum, n, m_i, c_i_j: the minimum-determinant estimate of each stratum's rows (stratum, the statistics and the names of the wider
    strata that each belongs to), and of the wider strata, which start from their members' nearest rows together and take TRIALS steps
    over all their rows. Steps go on until every stratum has settled."""
    made = [saved(_starts(rows), "quality-starts")]
    for _ in range(TRIALS):
        made.append(_step(rows, made[-1]))
    best = saved(_least(made[-1]), "quality-best")
    for _ in range(MOST_STEPS):
        new = _step(rows, best)
        settled = new.alias("b").join(best.alias("a"), "stratum").where(F.abs(F.col("b.logdet") - F.col("a.logdet")) > SETTLED).isEmpty()
        made.append(best)
        best = new
        if settled:
            break
    dropped(*made)
    found = _estimate(best.select("stratum", *_SUMS), "stratum")
    if wider:
        belongs = saved(rows.select("stratum", *wider).distinct(), "quality-strata")
        met, start = best.select("stratum", *_SUMS).join(belongs, "stratum"), None
        for w in wider:
            part = met.groupBy(F.col(w).alias("stratum")).agg(*(F.sum(c).alias(c) for c in _SUMS))
            start = part if start is None else start.unionByName(part)
        level = saved(_determined(_estimate(start, "stratum").withColumn("start", F.lit(0))), "quality-wide")
        every = rows.select(*NAMES, F.explode(F.array(*wider)).alias("stratum"))
        for _ in range(TRIALS):
            level = _step(every, level)
        found = found.unionByName(_estimate(level.select("stratum", *_SUMS), "stratum"))
    return found


def shrunk(fitted: DataFrame, named: DataFrame) -> DataFrame:
    """stratum, m_i, l_i_j of every narrow stratum in named (stratum, wide, all), each estimate drawn towards the wider one."""
    own = [*(f"m_{i}" for i in range(SIZE)), *(f"c_{i}_{j}" for i in range(SIZE) for j in range(i + 1))]

    def at(level: str) -> DataFrame:
        return fitted.select(F.col("stratum").alias(level), F.col("n").alias(f"n_{level}"), *(F.col(c).alias(f"{c}_{level}") for c in own))

    wide = named.join(at("all"), "all", "left").join(at("wide"), "wide", "left").join(at("stratum"), "stratum", "left")
    drawn = {}
    for c in own:
        value = F.coalesce(F.col(f"{c}_all"), F.lit(0.0))
        for level in ("wide", "stratum"):
            n = F.coalesce(F.col(f"n_{level}"), F.lit(0))
            value = (n * F.coalesce(F.col(f"{c}_{level}"), F.lit(0.0)) + PRIOR_ROWS * value) / (n + PRIOR_ROWS)
        drawn[c] = value
    # with few rows in all, covariances are those of the prior: NOISE, many times over
    n = F.coalesce(F.col("n_all"), F.lit(0))
    for i in range(SIZE):
        drawn[f"c_{i}_{i}"] = drawn[f"c_{i}_{i}"] + (PRIOR_ROWS / (n + 1.0)) ** 2 * NOISE[NAMES[i]] ** 2
    return factored(wide.select("stratum", *(v.alias(c) for c, v in drawn.items()))).select("stratum", *own[:SIZE], *(f"l_{i}_{j}" for i in range(SIZE) for j in range(i + 1)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, base_failed, distance and kept."""
    stats = saved(measured(docs), "quality-stats")
    narrow, wide, everything = strata()
    good = stats.where(~F.col("base_failed"))
    fitted = concentrated(good.select(*NAMES, narrow.alias("stratum"), wide.alias("wide"), everything.alias("all")), ("wide", "all"))
    named = stats.select(narrow.alias("stratum"), wide.alias("wide"), everything.alias("all")).distinct()
    estimate = saved(shrunk(fitted, named), "quality-shrunk")
    placed = distance(stats.withColumn("stratum", narrow).join(sized(estimate), "stratum"))
    counts = placed.where(~F.col("base_failed")).groupBy("stratum", _bin(F.col("d2")).alias("bin")).agg(F.count("*").alias("n"))
    half = _quantiles(counts, ["stratum"], half=0.5)
    scale = saved(half.select("stratum", ((F.col("n") * F.greatest(_upper(F.col("half")) / MEDIAN, F.lit(1.0)) + PRIOR_ROWS) / (F.col("n") + PRIOR_ROWS)).alias("scale")), "quality-scale")
    judged = placed.join(sized(scale), "stratum", "left").withColumn("distance", F.col("d2") / F.coalesce("scale", F.lit(1.0)))
    return judged.select("doc_id", *stats.columns[3:8], "base_failed", "distance", (~F.col("base_failed") & (F.col("distance") <= CUTOFF)).alias("kept"))
