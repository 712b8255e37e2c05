"""The corpus pipeline: quality rules, near duplicates, benchmark contamination, source mix, token files.

Each stage takes the rows that its predecessor kept, written as Parquet, and works on all of them. All but the
last return the columns of ``documents``, and any others that came along, whatever their names; the mix returns a row as often as it takes it. Long texts are
read whole by every stage, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, neardup, quality, tokens
from tessera.llm.common import forget, read, scratch, small_batches, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the line labelling.

    A null or empty text goes, a null id is no matter; rows that repeat are judged alike, so all of them stay or go.
    """
    small_batches(spark)
    return quality.keep_quality(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Rows without words are in no group and stay; a null id comes last in its group; of rows that tie for the smallest id, or repeat, one stays.
    """
    small_batches(spark)
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items.

    A null or empty text is clean; rows that repeat are judged alike.
    """
    small_batches(spark)
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source, the last one; a row without words is never taken; rows that repeat are taken each for itself, and where only some fit, those with smaller ids.
    """
    small_batches(spark)
    return mixing.keep_mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all that is left, described from the files.

    A null id comes first, a null text is an empty document; rows that tie in id go by a hash of the text, then the text; rows that repeat are each written.
    """
    small_batches(spark)
    return tokens.encode_and_digest(docs, tokens.public_spec())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_files),
]

#: The stages can't be written in SQL; ``tests/llm/test_pipeline.py`` holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage has stored is removed once its result is written, and that once the next one's is."""
    docs, last = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = stored(stage(spark, docs, sf_dir))
            keep.append(docs)
        if last is not None:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
