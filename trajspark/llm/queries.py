"""One query for each operation, over its whole table, and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, langid, line_dedup, mixing, packing, quality, secrets, simhash, toxicity
from .common import table

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_positions(table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def op4_rabitq_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")


def op6_tool_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(*chat.from_turns(table(spark, sf_dir, "conversations")), chat.TURN_TOOLS, every_row=True)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op10_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_source_mixing,
        op2_simhash_dedup,
        op3_quality_rules,
        op4_rabitq_ann,
        op5_line_dedup,
        op6_tool_linking,
        op7_secret_scan,
        op8_toxicity,
        op9_language_id,
        op10_length_packing,
    )
}
ORACLE_SQL: dict[str, str] = {"op3_quality_rules": quality.oracle(), "op5_line_dedup": line_dedup.oracle(), "op6_tool_linking": chat.oracle()}
