"""Text scorers and embedders as pluggable functions over Arrow batches, with defaults that need no model.

A scorer is `fn(list of texts) -> sequence of numbers`, an embedder gives one vector a text. Texts go in batches of like length (sorted
within what a task holds at once), a batch that runs out of memory is halved down to LEAST, and rows return in their order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAST = 8
#: Texts that a task holds at once as Python's.
ROWS = 512
_WORD = re.compile(r"\w+")
#: A small valence lexicon, for tests and as a fallback; real uses bring their own.
VALENCE = {"good": 1.0, "happy": 1.0, "love": 1.0, "calm": 0.5, "the": 0.1, "bad": -1.0, "fear": -1.0, "dark": -0.5, "pain": -1.0, "of": -0.1}


def valence(texts: list[str], lexicon: dict[str, float] = VALENCE) -> np.ndarray:
    """Mean lexicon weight of a text's words; 0 for a text without words."""
    out = np.zeros(len(texts))
    for k, t in enumerate(texts):
        words = _WORD.findall(t.lower())
        out[k] = sum(lexicon.get(w, 0.0) for w in words) / max(len(words), 1)
    return out


def hashed_embedding(texts: list[str], size: int = 64) -> np.ndarray:
    """Unit vectors of signed word-hash counts; zeros for a text without words."""
    out = np.zeros((len(texts), size))
    for k, t in enumerate(texts):
        for w in _WORD.findall(t.lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[k, h % size] += 1 if h >> 63 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def in_batches(fn: Callable, texts: list[str], batch: int) -> list:
    """fn over texts in batches of like length; results in the texts' order."""
    order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
    out: list = [None] * len(texts)
    at = 0
    while at < len(order):
        part = order[at : at + batch]
        try:
            made = fn([texts[k] or " " for k in part])
        except MemoryError:
            if batch <= LEAST:
                raise
            batch = max(LEAST, batch // 2)
            continue
        for k, v in zip(part, made, strict=True):
            out[k] = v
        at += len(part)
    return out


def scored(df: DataFrame, text: str, fn: Callable = valence, name: str = "score", batch: int = 128, kind: str = "double", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or `keep`) and fn's result; kind is double or array<double>."""
    keep = [c for c in (keep or df.columns) if c != name]
    read = df.select(*dict.fromkeys([*keep, text]))
    field = T.StructField(name, T.DoubleType() if kind == "double" else T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), ROWS):
                part = whole.slice(lo, ROWS)
                got = in_batches(fn, [t or "" for t in part.column(text).to_pylist()], batch)
                if kind == "double":
                    made = pa.array(np.asarray(got, float))
                else:
                    vectors = [np.asarray(v, float) for v in got]
                    ends = np.cumsum([0, *map(len, vectors)]).astype(np.int32)
                    made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(vectors)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), made], names=[*keep, name])

    return read.mapInArrow(run, T.StructType([*(read.schema[c] for c in keep), field]))
