"""The corpus pipeline: quality rules, language identification, near-dedup, packing.

Every stage works on all documents that the one before kept. Its result is written as Parquet to the shared
folder and read again, so that a lost executor costs one stage at most. No stage can be written in SQL as a whole (XXH64
fingerprints, a trained classifier, a tokenizer); each is tested against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilstream.llm.langid import filter_language
from veilstream.llm.nearcopies import keep_distinct
from veilstream.llm.packing import pack_power_of_two, packing_digest
from veilstream.llm.quality import filter_quality
from veilstream.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the fences of their language and source."""
    return filter_quality(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence."""
    return filter_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies: SimHash parts and bit planes find them, 5-word similarity of 0.8 or more decides."""
    return keep_distinct(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, each a sequence of its own."""
    return packing_digest(pack_power_of_two(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("language identification", language_id),
    ("simhash near-dedup", near_dedup),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
