"""A training corpus from raw documents: five stages, each over all rows that the one before kept.

Null and empty texts pass every stage (they score as harmless, have no near duplicates and no secrets) up to the mix, where a text
without words is never taken. Texts without a doc_id take part in the near-duplicate stage after all ids, so that of copies one with
an id stays if there is any; rows that repeat a doc_id and a text count as one row, and rows of one doc_id stay or go together. Extra
columns of documents, whatever their names, pass through to the last stage, which returns doc_id, lang, source, n_chars, ids and
n_tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.llm import bpe, mixing, neardup, secrets, toxicity
from tallyhouse.llm.common import WORD, saved, table, unused
from tallyhouse.llm.queries import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, taught by labels, scores below one half."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    name = unused("score", docs)
    return toxicity.score(docs, model, keep=tuple(docs.columns), score_col=name).where(F.col(name) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id."""
    key, same, turn = (unused(c, docs) for c in ("key", "same", "turn"))
    # texts without an id take one from their text, above all real ids; what has neither id nor words stays as it is
    made = F.xxhash64(F.lit("no id"), "text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    no_key = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    keyed = docs.where(~no_key).withColumn(key, F.coalesce("doc_id", made))
    kept = neardup.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias(key)).distinct()
    first = Window.partitionBy(key, same).orderBy("lang", "source")
    one = keyed.join(kept, key, "left_semi").withColumn(same, F.xxhash64("text")).withColumn(turn, F.row_number().over(first)).where(F.col(turn) == 1)
    return one.select(*docs.columns).unionByName(docs.where(no_key))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets replaced by a mark."""
    clean = secrets.redact(docs, secrets.learn(docs))
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight says."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each taken document's token ids."""
    coded = bpe.encode(docs, vocabulary_path("byte_bpe_multi_50k.tiktoken"), keep=("doc_id", "lang", "source", "n_chars"))
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Minima of hashes and inferred automata have no SQL; tests hold the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
