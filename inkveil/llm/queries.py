"""The queries of the subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from inkveil.llm import chat, decontaminate, html_extract, lines, mixing, oracles, quality, secrets, simhash, suffixes, warc
from inkveil.llm.common import documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.compared(documents(spark, sf_dir))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.compared(documents(spark, sf_dir))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compared(documents(spark, sf_dir))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.compared(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.compared(documents(spark, sf_dir))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.reported(documents(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.compared(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compared(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_source_mix": op2_source_mix,
        "op3_chat_format": op3_chat_format,
        "op4_simhash": op4_simhash,
        "op5_decontaminate": op5_decontaminate,
        "op6_line_dedup": op6_line_dedup,
        "op7_html_text": op7_html_text,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_warc": op9_warc,
        "op10_quality_rules": op10_quality_rules,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """Queries without an entry (2, 3, 4, 7, 8, 9, pipeline) are held against brute force in ``tests/llm``."""
    return {
        "op1_secret_scan": oracles.secrets_sql(),
        "op5_decontaminate": oracles.decontaminate_sql(),
        "op6_line_dedup": oracles.lines_sql(),
        "op10_quality_rules": oracles.quality_sql(),
    }
