"""Queries over the driver's tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.bpe import bpe_digest

    return bpe_digest(_read(spark, sf_dir, "documents"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.urls import judge_urls, url_digest

    return url_digest(judge_urls(_read(spark, sf_dir, "pages")))


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.chat import chat_digest, link_turns

    return chat_digest(link_turns(_read(spark, sf_dir, "conversations")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.quality import quality_digest, quality_rules

    return quality_digest(quality_rules(_read(spark, sf_dir, "documents")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.licenses import license_digest, scan_licenses

    return license_digest(scan_licenses(_read(spark, sf_dir, "documents")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.langid import language_digest

    return language_digest(_read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.packing import pack_power_of_two, packing_digest

    return packing_digest(pack_power_of_two(_read(spark, sf_dir, "documents")))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.ann import nearest_neighbours

    return nearest_neighbours(_read(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.simhash import near_duplicates, simhash_digest

    return simhash_digest(near_duplicates(_read(spark, sf_dir, "documents")))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.tokenfile import read_token_files, token_digest, write_token_files

    return token_digest(read_token_files(spark, write_token_files(_read(spark, sf_dir, "documents"))))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from veilstream.llm.chat import chat_sql
    from veilstream.llm.licenses import license_sql
    from veilstream.llm.quality import quality_sql
    from veilstream.llm.urls import url_sql

    return {"op2_urls": url_sql(), "op3_tool_calls": chat_sql(), "op4_quality": quality_sql(), "op5_licenses": license_sql()}
