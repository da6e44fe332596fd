"""Toxicity (operator 2): a weighted lexicon, matched by Aho-Corasick in folded text.

Folding maps look-alike letters, accents, full-width and styled forms and digits that stand for letters to one plain letter each,
drops invisible characters and turns whatever else is no letter into single spaces; letters of other scripts stay. The lexicon holds
whole words and beginnings of words, each with the log-odds of its occurrence among the distinct words of toxic against other labelled
texts; matches that lie inside an exception phrase count nothing. The weight of a text's different words, the weight of all its words
for each hundred and the number of different ones go into a logistic score.

Labels teach from a bounded sample: the SAMPLE_TOXIC and SAMPLE_OTHER labelled rows with the least hash of doc_id, texts that repeat
counting once. Half of it gives the entries, the other half confirms them, all of it fits the score. One rule holds at all sizes: what
the labels say is shrunk towards a prior, SEED_ENTRIES with their weights, nothing for other words, and COEFFICIENTS; so without
labels the prior acts alone, and its part fades as labels come in. PRIOR_WORDS was chosen by folds() among the rows that may teach: of
the 352 toxic ones of sf0.1 309 are found with 0.5, 304 with 1 and 302 with 2 or 4, beside 13, 13, 12 and 12 false alarms.

Defined results: null and empty texts score as texts without any match; very long texts are matched whole; repeated rows score each;
rows with labels that differ, and copies of a text whose labels differ, count as toxic; an empty table gives an empty result; other
columns are ignored by score().
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_steps

SAMPLE_TOXIC, SAMPLE_OTHER = 5_000, 15_000
PREFIXES = range(4, 9)
#: An entry stands in this share of toxic texts at least, which bounds how many entries there are, and has these log-odds.
MIN_SHARE, MIN_ODDS = 0.012, 2.5
#: What the prior counts for: occurrences of a word, toxic texts (of which SEED_SHARE hold a seed entry), labelled texts in the fit.
PRIOR_WORDS, PRIOR_TEXTS, SEED_SHARE, PRIOR_FIT = 0.5, 20.0, 0.05, 1.0
COEFFICIENTS = (-4.0, 0.6, 0.2, 0.5)
#: The prior's entries, with weights.
SEED_ENTRIES = {" idiot ": 5.0, " moron ": 5.0, " scum ": 5.0, " stupid ": 4.0, " pathetic ": 4.0, " worthless ": 4.0, " loser ": 4.0, " disgusting ": 4.0}
#: Innocent phrases that hold a word of abuse.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "circus clown", "clown fish", "idiot proof", "pond scum", "sore loser", "loser bracket")
#: Signs that stand for a letter, beside what Unicode itself decomposes.
LOOK_ALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "|": "i", "!": "i", "l": "i", "ı": "i", "ł": "i", "ø": "o", "đ": "d", "ß": "s",
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "i", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "г": "r", "п": "n",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "μ": "u",
}
#: Signs that count as letters only between letters: "stupid!" ends with a mark, "st!nk" does not.
_ONLY_INSIDE = "!|@$€"
_INVISIBLE = [0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), 0x2060, 0xFEFF]
FEATURES = 3


@cache
def _table() -> np.ndarray:
    """Folded letter, 32 for no letter, 0 for what is dropped, by code point."""
    table = np.full(0x110000, 32, np.uint32)
    for cp in range(0x41, 0x40000):  # there are no letters beyond
        kind = unicodedata.category(chr(cp))[0]
        if kind == "M":
            table[cp] = 0
        elif kind in "LSN":  # styled letters are signs or numbers in part
            c = chr(cp).lower()
            c = c if "\uac00" <= c <= "\ud7a3" else unicodedata.normalize("NFKD", c)[:1].lower()  # a Korean syllable is one letter
            if c.isalpha():
                table[cp] = ord(LOOK_ALIKES.get(c, c))
    for sign, letter in LOOK_ALIKES.items():
        table[ord(sign)] = ord(letter)
    table[_INVISIBLE] = 0
    return table


def fold(points: np.ndarray) -> np.ndarray:
    """Folded code points of one step of texts; a space parts words and is never doubled."""
    out = _table()[points]
    marks = np.isin(points, [ord(c) for c in _ONLY_INSIDE])
    if marks.any():
        letter = (out != 32) & (out != 0) & ~marks
        before, after = np.r_[False, letter[:-1]], np.r_[letter[1:], False]
        out[marks & ~(before & after)] = 32
    digits = (points >= 48) & (points <= 57)
    if digits.any():  # a number is no word: digits stand for letters only in a run that holds a letter
        solid = out != 32
        edge = np.flatnonzero(np.r_[True, solid[1:] != solid[:-1]])
        real = np.add.reduceat((solid & ~digits & (out != 0)).astype(np.int64), edge)
        out[digits & np.repeat(real == 0, np.diff(np.r_[edge, len(out)]))] = 32
    return out


def folded_texts(raw: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Each text folded, with a space before and after."""
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
    at = heads[offsets]
    n = len(at) - 1
    spaced = np.full(len(points) + 2 * n, 32, np.uint32)
    shift = np.repeat(2 * np.arange(n) + 1, np.diff(at))
    spaced[np.arange(len(points)) + shift] = points
    at = at + 2 * np.arange(n + 1)
    out = fold(spaced)
    keep = out != 0
    shown = np.flatnonzero(keep)
    space = out[shown] == 32
    twice = np.r_[False, space[1:] & space[:-1]]
    keep[shown[twice]] = False
    keep[at[:-1]] = True
    total = np.r_[0, np.cumsum(keep)]
    text = out[keep].tobytes().decode("utf-32-le")
    return [text[a:b] if text[b - 1] == " " else text[a:b] + " " for a, b in zip(total[at[:-1]].tolist(), total[at[1:]].tolist(), strict=True)]


class Lexicon:
    """Entries (a space marks a word's edge) with weights, exception phrases, and the logistic score's coefficients."""

    def __init__(self, entries: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, coefficients: tuple[float, ...] = COEFFICIENTS):
        self.entries, self.coefficients = entries, coefficients
        raw = [" ".join(("", e, "")).encode() for e in exceptions]
        self.exceptions = []
        for e in raw:
            self.exceptions += [f" {x.strip()} " for x in folded_texts(np.frombuffer(e, np.uint8), np.array([0, len(e)]))]
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for entry, weight in self.entries.items():
                a.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                a.add_word(phrase, (len(phrase), None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def features(self, folded: str) -> tuple[float, float, float]:
        hits = list(self.automaton.iter(folded)) if len(self.automaton) else []
        if not hits:
            return 0.0, 0.0, 0.0
        spared = sorted((end - n + 1, end) for end, (n, weight) in hits if weight is None)
        opens, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        best: dict[int, float] = {}  # by a word's end: entries for one word count once, by the weightiest
        by_word: dict[str, float] = {}
        for end, (n, weight) in hits:
            start = end - n + 1
            if weight is None or ((k := bisect_right(opens, start)) and reach[k - 1] >= end):
                continue
            word = folded.find(" ", start + 1)
            best[word] = max(best.get(word, 0.0), weight)
            by_word[folded[start:word]] = best[word]
        total = sum(best.values())
        words = max(1, folded.count(" ") - 1)
        return math.log1p(sum(by_word.values())), math.log1p(100 * total / words), float(min(5, len(by_word)))

    def scores(self, features: np.ndarray) -> np.ndarray:
        c = np.array(self.coefficients)
        return 1 / (1 + np.exp(-(c[0] + features @ c[1:])))


COUNTS = "half int, entry string, tf_0 long, tf_1 long, df_0 long, df_1 long"


def folded(text: str) -> str:
    raw = np.frombuffer(text.encode(), np.uint8)
    return folded_texts(raw, np.array([0, len(raw)]))[0]


def _counted(rows: DataFrame) -> DataFrame:
    """Of every folded word and beginning, by half and label, its distinct words in each text (tf) and its texts (df); under "" all distinct words: half, entry, tf_0, tf_1, df_0, df_1."""

    def run(batches):
        counts: dict[tuple[int, str], list[int]] = {}

        def flush():
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys]), *(pa.array([counts[k][j] for k in keys], pa.int64()) for j in range(4))], names=["half", "entry", "tf_0", "tf_1", "df_0", "df_1"])
            counts.clear()
            return out

        for batch in batches:
            half, label = batch.column("half").to_pylist(), batch.column("toxic").to_pylist()
            for row, _, raw, at in text_steps(batch.column("text")):
                for k, folded in enumerate(folded_texts(raw, at)):
                    own: dict[str, int] = {}
                    words = set(folded.split())  # a word counts once a text, however often it is repeated
                    for w in words:
                        for e in (f" {w} ", *(f" {w[:m]}" for m in PREFIXES if len(w) > m)):
                            own[e] = own.get(e, 0) + 1
                    own[""] = len(words)
                    y = label[row + k]
                    for e, n in own.items():
                        c = counts.setdefault((half[row + k], e), [0, 0, 0, 0])
                        c[y] += n
                        c[2 + y] += 1
                    if len(counts) > 500_000:
                        yield flush()
        if counts:
            yield flush()

    return rows.select("half", "toxic", "text").mapInArrow(run, COUNTS)


def learn(docs: DataFrame, labels: DataFrame, prior_words: float = PRIOR_WORDS, without: int | None = None) -> Lexicon:
    """A lexicon from the labelled rows whose crc32(doc_id as text) mod 5 is neither 0 nor `without`."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(~_remainder().isin(0, *([] if without is None else [without])))
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    picked = None
    for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_OTHER)):
        part = known.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(most)
        picked = part if picked is None else picked.union(part)
    # at most SAMPLE_TOXIC + SAMPLE_OTHER rows of two numbers: a bound that doesn't grow with the corpus
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # copies of a text teach once, in one half
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    rows = saved(rows.select(F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half"), "toxic", "text"), "toxicity-sample")
    sizes = {(r.half, r.toxic): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    sums = [F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}_{h}") for h in (0, 1) for c in ("tf_0", "tf_1", "df_1")]
    prior = {f" {folded(e).strip()} ": w for e, w in SEED_ENTRIES.items()}
    seeds = docs.sparkSession.createDataFrame([(0, e, 0, 0, 0, 0) for e in ["", *prior]], COUNTS)
    counts = saved(_counted(rows).union(seeds).groupBy("entry").agg(*sums), "toxicity-counts")
    total = counts.where("entry = ''").first()
    known_before = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in prior.items() for x in pair)), F.col("entry")), F.lit(0.0))

    def odds(*halves: int):
        """Log-odds of a word of a toxic text against one of another text to be the entry, shrunk towards the prior."""
        t, o = (sum((F.col(f"{c}_{h}") for h in halves), F.lit(0)) for c in ("tf_1", "tf_0"))
        w1, w0 = (sum(total[f"{c}_{h}"] for h in halves) for c in ("tf_1", "tf_0"))
        seen = F.log((t + 0.5) / (w1 + 1)) - F.log((o + 0.5) / (w0 + 1))
        return (prior_words * known_before + (t + o) * seen) / (prior_words + t + o)

    strong = counts.where("entry <> ''")
    for h in (0, 1):
        share = (F.col(f"df_1_{h}") + F.when(known_before > 0, PRIOR_TEXTS * SEED_SHARE).otherwise(0.0)) / (PRIOR_TEXTS + sizes.get((h, 1), 0))
        strong = strong.where((share >= MIN_SHARE) & (odds(h) >= MIN_ODDS))
    found = {r.entry: r.weight for r in strong.select("entry", odds(0, 1).alias("weight")).collect()}  # bounded by MIN_SHARE
    # a word or longer beginning adds nothing to a beginning that is as telling
    entries = {e: w for e, w in found.items() if not any(found.get(e[:k], -1) >= w - 1 for k in range(5, len(e)))}
    model = Lexicon(entries)

    def run(batches):
        for batch in batches:
            f = [model.features(t) for _, _, raw, at in text_steps(batch.column("text")) for t in folded_texts(raw, at)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array([x[k] for x in f], pa.float64()) for k in range(FEATURES))], names=["toxic", *(f"f{k}" for k in range(FEATURES))])

    fitted = rows.select("toxic", "text").mapInArrow(run, "toxic int, f0 double, f1 double, f2 double")
    sample = np.array([tuple(r) for r in fitted.collect()], float).reshape(-1, 1 + FEATURES)  # bounded by the sample
    return Lexicon(entries, coefficients=_logistic(sample[:, 1:], sample[:, 0]))


def _remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def folds(docs: DataFrame, labels: DataFrame, priors: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0)) -> list[tuple[float, int, int, int]]:
    """(prior_words, toxic, found, false alarms) over the labelled rows that may teach, each judged by a lexicon taught by the others: in
    four folds, by the remainders 1 to 4. Rows of remainder 0 take no part. PRIOR_WORDS comes from these figures."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    out = []
    for prior in priors:
        total = [0, 0, 0]
        for k in range(1, 5):
            judged = score(docs.where(_remainder() == k), learn(docs, labels, prior, k)).join(known, "doc_id")
            hit = F.col("score") >= 0.5
            r = judged.agg(F.count_if(F.col("toxic") == 1), F.count_if(hit & (F.col("toxic") == 1)), F.count_if(hit & (F.col("toxic") == 0))).first()
            total = [a + b for a, b in zip(total, r, strict=True)]
        out.append((prior, *total))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...] = COEFFICIENTS, strength: float = PRIOR_FIT) -> tuple[float, ...]:
    """Logistic regression by Newton steps, with coefficients drawn towards the prior; classes weigh as they come."""
    x, middle = np.c_[np.ones(len(x)), x], np.array(prior)
    beta = middle.copy()
    penalty = strength * np.eye(len(middle))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ (beta - middle))
        beta = beta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, model: Lexicon, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns of `keep` and score_col (in place of a column of that name), of every whole text."""
    from pyspark.sql import types as T

    keep = tuple(c for c in keep if c != score_col)
    read = docs.select(*dict.fromkeys([*keep, text_col]))

    def run(batches):
        for batch in batches:
            f = np.array([model.features(t) for _, _, raw, at in text_steps(batch.column(text_col)) for t in folded_texts(raw, at)], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.scores(f))], names=[*keep, score_col])

    return read.mapInArrow(run, T.StructType([*(read.schema[c] for c in keep), T.StructField(score_col, T.DoubleType(), False)]))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    held = _remainder() == 0
    return score(docs, learn(docs, labels)).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
