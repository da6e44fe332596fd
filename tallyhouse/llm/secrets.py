"""Secret scans (operator 3) by grammar inference.

Labelled credentials (what the base patterns find in a bounded sample of documents, labelled by their kind) become one prefix tree
for each kind, over character classes, with counts. Red-blue state merging joins states whose outgoing frequencies agree by
Hoeffding's bound, down the whole tree, and leaves a probabilistic automaton. A further automaton is inferred in the same way from
long tokens that are no credentials. Every long token of every text is then scored, those in or around base spans too: the
log-likelihood of its format under the best credential automaton, for each character, less that under the other one. Tokens above the
threshold that reach beyond the base spans, or lie outside of them, are added to the base spans as kind `format`; every span comes with
the score of the tokens that it touches, and every text with the best score of all its tokens.

Defined results: null counts as empty; very long texts are scanned whole; offsets are code points, ends exclusive, and a span is a
whole match (for assign: from the key's first letter to the value's last character); repeated rows are scanned each; with no labelled
credentials only the base patterns act; an empty table gives an empty result; other columns pass through redact() and are ignored
by scan().
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

#: The base patterns, in order; keys in either case, over ASCII alone.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = ("assign", "access", "hex", "format")
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_TOKEN = 12, 18, 16, 16
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: The sample that teaches: documents with the least hash of doc_id, and from them so many credentials of each kind and other tokens.
SAMPLE_DOCUMENTS, SAMPLE_STRINGS = 20_000, 400
ALPHA = 0.01
#: Nats for each character by which a format must be likelier than an ordinary token.
THRESHOLD = 0.5
#: Longer tokens are scored anew each time, so that a worker's memory of scores stays small.
REMEMBERED = 256
SPAN = "array<struct<kind:string,start:int,end:int,value_start:int,score:double>>"


def _key_starts(low: str) -> list[int]:
    found = []
    for key in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        at = low.find(key)
        while at >= 0:
            found.append(at)
            at = low.find(key, at + 1)
    return sorted(found)


_LOWER = {i: i + 32 for i in range(65, 91)}


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, int, int]]:
    """(start, kind index, end, start of the value) of every base match, in order."""
    out = []
    if low is None:
        low = text.translate(_LOWER)
    free = 0
    for at in _key_starts(low):  # a match can only begin with a key; one that fails the length still uses its text up
        if at >= free and (m := ASSIGN.match(text, at)):
            free = m.end()
            if m.end(2) - m.start(2) >= MIN_VALUE:
                out.append((m.start(), 0, m.end(), m.start(2)))
    for run in _RUN.finditer(text):  # the other kinds lie within runs of these characters
        for m in _ACCESS.finditer(text, *run.span()):
            out.append((m.start(), 1, m.end(), m.start()))
        for m in _HEX.finditer(text, *run.span()):
            out.append((m.start(), 2, m.end(), m.start()))
    return sorted(out)


class Touched:
    """Whether a range of a text has a place in common with one of its base spans."""

    def __init__(self, base: list[tuple[int, int, int, int]]):
        self.starts = [b[0] for b in base]
        self.reach = list(accumulate((b[2] for b in base), max))

    def __call__(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.reach[k - 1] > start

    def holds(self, start: int, end: int) -> bool:
        """Whether one base span covers the range."""
        k = bisect_left(self.starts, start + 1)
        return k > 0 and self.reach[k - 1] >= end


def tokens(text: str) -> list[tuple[int, int]]:
    """Start and end of what may be a credential: long runs of its characters, without a dash or sign of equality at the end."""
    out = []
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        end = start + len(m[0].rstrip("=-"))
        if end - start >= MIN_TOKEN:
            out.append((start, end))
    return out


def symbol(c: str) -> str:
    if c.isdigit():
        return "9"
    if "a" <= c <= "f":
        return "h"
    if "A" <= c <= "F":
        return "H"
    if c.islower():
        return "l"
    return "L" if c.isupper() else c


_SHAPES = {i: symbol(chr(i)) for i in range(128)}


def shape(token: str) -> str:
    """The token with each character replaced by its class."""
    return token.translate(_SHAPES)


class Automaton:
    """A deterministic probabilistic automaton, inferred by merging compatible states of a prefix tree."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends = [0]
        self.total = [0]
        for s in strings:
            at = 0
            for c in s:
                self.total[at] += 1
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                    self.total.append(0)
                at = self.next[at][c]
            self.total[at] += 1
            self.ends[at] += 1
        self._merge(math.sqrt(0.5 * math.log(2 / alpha)))
        self.alphabet = max(2, len({c for s in strings for c in s}) + 1)

    def _alike(self, a: int, b: int, width: float) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.total[a], self.total[b]
            if not na or not nb:
                continue
            bound = width * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if bound < 1:
                if abs(self.ends[a] / na - self.ends[b] / nb) > bound:
                    return False
                for c in self.count[a].keys() | self.count[b].keys():
                    if abs(self.count[a].get(c, 0) / na - self.count[b].get(c, 0) / nb) > bound:
                        return False
            for c in self.next[a].keys() & self.next[b].keys():
                if self.next[a][c] != self.next[b][c]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.total[a] += self.total[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    if self.next[a][c] != self.next[b][c]:
                        todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge(self, width: float) -> None:
        red = [0]
        while True:
            known = set(red)
            blue = next(((r, c) for r in red for c in sorted(self.next[r]) if self.next[r][c] not in known), None)
            if blue is None:
                self.states = red
                return
            parent, c = blue
            state = self.next[parent][c]
            for r in red:
                if self._alike(r, state, width):
                    self.next[parent][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)

    def log_likelihood(self, s: str) -> float:
        """Of the whole string with its end; what was never seen has the share of half a count, and leads back to the start, so that a
        string is judged by all its parts."""
        at, out = 0, 0.0
        for c in s:
            n = self.total[at] + 0.5 * self.alphabet
            out += math.log((self.count[at].get(c, 0) + 0.5) / n)
            at = self.next[at].get(c, 0)
        return out + math.log((self.ends[at] + 0.5) / (self.total[at] + 0.5 * self.alphabet))


class Grammar:
    """The credentials' automata, by kind, and the other tokens' one."""

    def __init__(self, credentials: dict[str, list[str]], other: list[str]):
        self.kinds = {k: Automaton([shape(s) for s in v]) for k, v in credentials.items() if len(v) >= 5}
        # ordinary tokens are as ordinary in capitals
        self.other = Automaton([shape(x) for s in other for x in (s, s.upper())] or ["l" * 16, "L" * 16])
        self._score = None

    def __getstate__(self):
        return self.__dict__ | {"_score": None}

    def score(self, token: str) -> float:
        if self._score is None:
            self._score = lru_cache(200_000)(self._of_shape)
        return (self._score if len(token) <= REMEMBERED else self._of_shape)(shape(token))

    def _of_shape(self, s: str) -> float:
        if not self.kinds:
            return -math.inf
        return (max(a.log_likelihood(s) for a in self.kinds.values()) - self.other.log_likelihood(s)) / (len(s) + 1)


def scored(text: str, grammar: Grammar | None) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, float]]]:
    """The base spans, and every long token (start, end, score) of a text."""
    known = grammar is not None and grammar.kinds
    return base_spans(text), [(a, b, grammar.score(text[a:b])) for a, b in tokens(text)] if known else []


def spans_of(text: str, grammar: Grammar | None, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """(start, kind index, end, start of the value) of base and added spans."""
    base, found = scored(text, grammar)
    return _joined(base, found, threshold)


def _joined(base: list, found: list, threshold: float) -> list[tuple[int, int, int, int]]:
    covered = Touched(base)
    added = [(a, 3, b, a) for a, b, score in found if score >= threshold and not covered.holds(a, b)]
    return sorted(base + added) if added else base


def with_scores(text: str, grammar: Grammar | None, threshold: float = THRESHOLD) -> tuple[list[dict], float | None]:
    """Spans with the best score of the tokens that each touches (None if it touches none), and the best score of all tokens."""
    base, found = scored(text, grammar)
    out, k = [], 0
    for a, kind, b, v in _joined(base, found, threshold):
        while k < len(found) and found[k][1] <= a:
            k += 1
        best, j = None, k
        while j < len(found) and found[j][0] < b:
            best = found[j][2] if best is None else max(best, found[j][2])
            j += 1
        out.append({"kind": KINDS[kind], "start": a, "end": b, "value_start": v, "score": best})
    return out, max((x[2] for x in found), default=None)


def learn(docs: DataFrame) -> Grammar:
    """A grammar from the labelled credentials and the other long tokens of SAMPLE_DOCUMENTS documents."""
    order = F.xxhash64(F.lit("secrets"), "doc_id")
    picked = docs.select("doc_id").orderBy(order, "doc_id").limit(SAMPLE_DOCUMENTS).distinct()
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # a bounded number of ids

    def run(batches):
        for batch in batches:
            kinds, strings = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                for _, kind, end, value in base:
                    kinds.append(KINDS[kind])
                    strings.append(text[value:end])
                touched = Touched(base)
                for a, b in tokens(text):
                    if not touched(a, b):
                        kinds.append("other")
                        strings.append(text[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(strings, pa.string())], names=["kind", "string"])

    found = saved(rows.mapInArrow(run, "kind string, string string").distinct(), "secrets-sample")
    best = None
    for kind in (*KINDS[:3], "other"):
        part = found.where(F.col("kind") == kind).orderBy(F.xxhash64("string"), "string").limit(SAMPLE_STRINGS)
        best = part if best is None else best.union(part)
    strings: dict[str, list[str]] = {}
    for r in best.collect():  # at most SAMPLE_STRINGS of each kind
        strings.setdefault(r.kind, []).append(r.string)
    other = strings.pop("other", [])
    return Grammar(strings, other)


def scan(docs: DataFrame, grammar: Grammar | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns of `keep`, secrets (all spans by start, then kind as in KINDS, with scores) and best_score (of all long tokens)."""
    keep = tuple(c for c in keep if c not in ("secrets", "best_score"))
    read = docs.select(*dict.fromkeys([*keep, text_col]))
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            made = [with_scores(text or "", grammar) for text in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([m[0] for m in made], pa.list_(kind)), pa.array([m[1] for m in made], pa.float64())], names=[*keep, "secrets", "best_score"])

    return read.mapInArrow(run, T.StructType([*(read.schema[c] for c in keep), T.StructField("secrets", T._parse_datatype_string(SPAN), False), T.StructField("best_score", T.DoubleType())]))


def redact(docs: DataFrame, grammar: Grammar | None, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """docs with every secret's value replaced by the mark; what touches is one value. Null texts stay null."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(text_col).to_pylist():
                if text:
                    parts, at = [], 0
                    for _, _, b, v in spans_of(text, grammar):
                        if v >= at:
                            parts += [text[at:v], mark]
                        at = max(at, b)
                    text = "".join([*parts, text[at:]]) if parts else text
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text_col else batch.column(c) for c in names], names=names)

    return docs.mapInArrow(run, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the spans that scan() finds."""
    found = scan(docs, learn(docs))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", *map(number, KINDS), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"), "best_score")
