"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html, licenses, lines, mixing, neardup, quality, sharding, substrings, tokens
from .common import read, small_batches

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    field = quality.fit(quality.labelled_sample(docs, read(spark, sf_dir, "labels")))
    return quality.score(docs, field)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"), sharding.tree())


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(read(spark, sf_dir, "documents"))


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_and_digest(read(spark, sf_dir, "documents"), tokens.public_spec())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(read(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: _prepared(f) for name, f in globals().items() if name.startswith("op") and callable(f)}


def _prepared(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontamination": decontaminate.ORACLE,
        "op5_substring_dedup": substrings.ORACLE,
        "op7_minhash_neardup": neardup.ORACLE,
        "op9_line_dedup": lines.ORACLE,
    }
