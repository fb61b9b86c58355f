"""A corpus pipeline in stages: quality rules, line dedup, near-dedup, mixing, packing.

Null, empty and very long texts, ties, repeated rows, empty tables and extra columns are handled as each
stage's operator says; all stages but the last return the columns that they get.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import lines, mixing, neardup, packing, quality
from pulsegrid.llm.common import materialise, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; a null or empty text has no words and is rejected."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line is similar to; null texts pass, a text may become empty."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies; rows without an id or text are groups of their own."""
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in training order, a row per copy that the mix takes; documents without a word are not in it."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document: where it stands in which sequence of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL cannot express byte-pair encoding, order MinHash and the packing; the tests hold
#: run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)
    return docs
