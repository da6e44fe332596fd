"""The queries opN_<name> of this subpackage, with production parameters, and the SQL that some can be held against."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact, html, idfile, manifest, merkle, mixing, neardup, negatives, quality, secrets, toxicity
from .common import table


def vocabulary_path(name: str) -> str:
    """Where the box keeps a public tokenizer's file; TALLYHOUSE_VOCABULARIES names another folder."""
    if folder := os.environ.get("TALLYHOUSE_VOCABULARIES"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_edits(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_multi_50k.tiktoken"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = html.extract(table(spark, sf_dir, "pages"))
    return shown.select("page_id", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(spark, table(spark, sf_dir, "conversations"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.digest(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op11_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digest(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.digest(table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.digest(table(spark, sf_dir, "documents"))


ALL = (op1_mix_sources, op2_toxicity, op3_secrets, op4_fingerprints, op5_byte_bpe, op6_html_text, op7_near_duplicates, op8_chat_format, op9_token_files, op10_quality, op11_dataset_manifest, op12_hard_negatives, op13_exact_dedup)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.SQL, "op8_chat_format": chat.SQL, "op11_dataset_manifest": manifest.SQL, "op12_hard_negatives": negatives.SQL, "op13_exact_dedup": exact.SQL}
