"""A corpus pipeline from five stages; each works on everything that the one before it kept.

Stages get (spark, docs, sf_dir); their results are written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.

Defined results. A null, empty or very short text fails the quality rules, so that nothing of it goes on;
an empty table passes through all stages as an empty one. Of repeated rows one stays. Null ids, languages
and sources are values like any other. Very long texts go through whole. Extra columns pass through all
stages but the last, whatever their names, and are dropped there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import line_dedup, mixing, packing, quality, simhash
from trajspark.llm.common import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their group's thresholds go."""
    return quality.keep_good(docs)


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line passages go from the texts; n_chars follows. A document left without text goes."""
    cleaned = line_dedup.dedup_lines(docs)
    touched = F.col("n_removed_chunks") > 0
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.where(~touched | (F.trim("text") != "")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_first(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nothing goes; files and their rows come in mixed order, which packing follows."""
    return mixing.in_mixed_order(docs)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bucket and batch."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_chunks),
    ("simhash_dedup", near_duplicates),
    ("source_mixing", source_mixing),
    ("length_packing", length_packing),
]
#: Hashing of 3-word shingles and the dynamic program are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with a Parquet table in the shared folder after each but the last.

    A table is removed as soon as the next one stands; the last remains, as the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(table := f"{top}/{k}-{name}")
        if before:
            _remove(spark, before)
        docs, before = spark.read.parquet(table), table
    return STAGES[-1][1](spark, docs, sf_dir)
