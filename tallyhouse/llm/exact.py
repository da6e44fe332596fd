"""Exact deduplication by progressive refinement (operator 13).

Three steps, each over what the one before left open: rows whose length in bytes recurs, of those the rows whose length and hash of
the first PREFIX characters recur, of those the rows whose whole text's SHA-256 recurs. Only the last step hashes whole texts, and only
those of rows that share length and beginning with another row.

The first scan writes a slim row for each document (length, hash of the beginning); lengths and beginnings are counted there, so that
texts are read twice more at most: to hash the survivors, and to mark or filter the rows. Texts never move. The surviving lengths and
beginnings, and the classes of equal texts, are written and measured: up to BROADCAST_BYTES they return by broadcast. Beyond that a
beginning can't be asked for where a text lies; then all texts are hashed in place, which costs less than moving them, and the classes
meet the slim digests in a sort-merge join, whose hot keys Spark splits. The rows are the same either way. Counts are partial sums
before they move, so that a text that fills a third of the table is a row a task.

Defined results: a null text is an empty one; texts are equal when their bytes are, without any change. Of equal texts the row with the
largest doc_id stays; null ids come before all others. Rows that repeat a doc_id and a text are one document: marked() keeps or drops
them together, deduplicated() returns one of them. A text that stands alone is its own class of size 1. An empty table gives an empty
result; extra columns pass through, and those named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small_enough, unused

#: Characters of the beginning that the second step hashes.
PREFIX = 256
ADDED = ("keep_id", "group_size", "kept")


def _whole(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _keys(text: Column) -> tuple[Column, Column]:
    """The length in bytes and the hash of the beginning."""
    return F.octet_length(text).alias("length"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("head")


def _recurring(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").drop("n")


class Classes:
    """What the refinement of a table found: the open beginnings (None where there are too many to broadcast) and the classes of equal
    texts with more than one row."""

    def __init__(self, heads: DataFrame | None, found: DataFrame):
        self.heads, self.found = heads, found


def _digested(rows: DataFrame, text: Column, heads: DataFrame | None, *out: Column) -> DataFrame:
    """rows as `out`, with `full`: the digest of the whole text where length and beginning recur, else the eight bytes of the
    beginning's hash, which no other row of this length has; and `open`, which tells them apart."""
    if heads is None:
        return rows.select(*out, F.unhex(F.sha2(text, 256)).alias("full"), F.lit(True).alias("open"))
    length, head = _keys(text)
    keyed = rows.select(F.struct(*out).alias("out"), text.alias("text"), length, head).join(F.broadcast(heads.withColumn("open", F.lit(True))), ["length", "head"], "left")
    full = F.when(F.col("open"), F.unhex(F.sha2("text", 256))).otherwise(F.unhex(F.hex("head")))
    return keyed.select("out.*", full.alias("full"), F.col("open").isNotNull().alias("open"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classes:
    """Refines the table: by length, by length and beginning, by whole text."""
    text = _whole(text_col)
    slim = saved(docs.select(*_keys(text)), "exact-lengths")
    lengths = saved(_recurring(slim, "length"), "exact-open-lengths")
    held = slim.join(F.broadcast(lengths), "length", "left_semi") if small_enough(lengths) else slim  # else the next count drops them
    heads = saved(_recurring(held, "length", "head"), "exact-open-heads")
    heads = heads if small_enough(heads) else None
    whole = _digested(docs, text, heads, F.col(id_col).alias("id")).where("open")
    found = whole.groupBy("full").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    return Classes(heads, saved(found, "exact-classes"))


def _marks(docs: DataFrame, known: Classes, id_col: str, text_col: str, *out: Column) -> DataFrame:
    """The columns `out` as the struct row, with keep_id, group_size, kept and full."""
    rows = _digested(docs, _whole(text_col), known.heads, F.struct(*out).alias("row"), F.col(id_col).alias("id"))
    side = known.found.select(F.col("full").alias("of"), F.col("keep_id").alias("best"), "group_size")
    joined = rows.join(F.broadcast(side) if small_enough(known.found) else side.hint("merge"), F.col("full") == F.col("of"), "left")
    keep = F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("best"))
    return joined.select("row", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), "full")


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with keep_id, group_size and kept."""
    own = [F.col(c) for c in docs.columns if c.lower() not in ADDED]
    return _marks(docs, classes(docs, id_col, text_col), id_col, text_col, *own).select("row.*", *ADDED)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each different text, with all columns of docs."""
    held = _marks(docs, classes(docs, id_col, text_col), id_col, text_col, *docs.columns).where("kept")
    alone, several = held.where("group_size = 1"), held.where("group_size > 1").dropDuplicates(["full"])  # rows that repeat id and text
    return alone.unionByName(several).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; the digest of each text is taken where the text lies."""
    sha = F.sha2(_whole("text"), 256).alias("text_sha256")
    return _marks(docs, classes(docs), "doc_id", "text", F.col("doc_id"), sha).select("row.doc_id", *ADDED, "row.text_sha256")


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.text) AS text_sha256 FROM d JOIN g ON d.text = g.text
"""
