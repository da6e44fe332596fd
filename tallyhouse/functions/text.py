"""Expressions over texts: language, sentences, words, lexicons, keys."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRST_PERSON = r"(?i)\b(i|me|my|mine|myself|we|us|our)\b"


def language(text: Column) -> Column:
    """unknown for blanks; ru where more than a fifth of the letters are Cyrillic; other where more than 0.15 of the characters are beyond ASCII; else en."""
    t = F.coalesce(text, F.lit(""))
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    cyrillic = F.regexp_count(t, F.lit(r"[Ѐ-ӿ]"))
    beyond = F.regexp_count(t, F.lit(r"[^\x00-\x7F]"))
    return F.when(F.length(F.trim(t)) == 0, "unknown").when((letters > 0) & (cyrillic / F.greatest(letters, F.lit(1)) > 0.20), "ru").when(beyond / F.char_length(t) > 0.15, "other").otherwise("en")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def sentences(text: Column, min_words: int = 2, max_chars: int = 200) -> Column:
    """Sentences in order: cut after . ! ? … with white space and at newlines, trimmed, of min_words or more, cut to max_chars."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?…])\s+|\n+"), lambda s: F.trim(s, F.lit(" \t\n\x0b\x0c\r")))
    return F.transform(F.filter(parts, lambda s: word_count(s) >= min_words), lambda s: F.substring(s, 1, max_chars))


def presence(text: Column, lexicon: dict[str, str]) -> dict[str, Column]:
    """0/1 for each axis: whether its pattern occurs, in either case."""
    return {axis: F.coalesce(text.rlike(f"(?iu){pattern}"), F.lit(False)).cast("int") for axis, pattern in lexicon.items()}


def rate(text: Column, pattern: str) -> Column:
    """Matches for each [A-Za-z']+ token (at least one)."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)) / F.greatest(F.regexp_count(text, F.lit("[A-Za-z']+")), F.lit(1)), F.lit(0.0))


def agency(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(FIRST_PERSON)) / F.greatest(word_count(text), F.lit(1)), F.lit(0.0))


def tokens(text: Column, pattern: str = r"\p{L}+") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"))


def quoted_list(text: Column) -> Column:
    """Items of `"a","b"`, or of a plain comma list, lower-cased and trimmed, blanks dropped."""
    t = F.coalesce(text, F.lit(""))
    items = F.when(t.contains('"'), F.regexp_extract_all(t, F.lit('"([^"]*)"'))).otherwise(F.split(t, ","))
    return F.filter(F.transform(items, lambda x: F.lower(F.trim(x))), lambda x: x != "")


def normal_ascii(text: Column) -> Column:
    """Lower case, punctuation to spaces, spaces collapsed: equal to normal() for ASCII texts, and native."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


@F.pandas_udf(T.StringType())
def normal(text: pd.Series) -> pd.Series:
    """NFKC and case folding, which the JVM functions lack."""
    return text.fillna("").map(lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", t).casefold())).strip())


def overlap_keys(normed: Column) -> dict[str, Column]:
    """Three keys of a normalised text: itself, its first 150 characters, its distinct tokens in order."""
    bag = F.concat_ws(" ", F.array_sort(F.array_distinct(F.split(normed, " "))))
    return {"exact": F.sha2(normed, 256), "prefix": F.sha2(F.substring(normed, 1, 150), 256), "bag": F.sha2(bag, 256)}


def content_only(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop))


def style_only(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: w.isin(*stop))


#: Odd multipliers that mix the code points of a gram.
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def gram_counts(texts, sizes=(3, 4, 5), features: int = 40_000):
    """(feature, count) arrays of each text's character grams that stay within a word and the space before or after it, hashed to
    `features` numbers; whole texts, in small letters."""
    import numpy as np

    out = []
    for text in texts:
        x = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        spaces = np.cumsum(x == 32)
        grams = []
        for n in sizes:
            size = len(x) - n + 1
            if size < 1:
                continue
            h, shifted = np.full(size, n, np.uint64), np.empty(size, np.uint64)
            for k in range(n):
                h ^= x[k : k + size]
                h *= np.uint64(_MIX[k])
                h ^= np.right_shift(h, np.uint64(29), out=shifted)
            grams.append(h[spaces[n - 2 : n - 2 + size] == spaces[:size]] % np.uint64(features))  # no space but at the ends
        out.append(np.unique(np.concatenate(grams), return_counts=True) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out
