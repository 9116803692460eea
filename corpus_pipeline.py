"""A training corpus from documents: quality rules, near-duplicates, benchmark passages, mixture, token ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontaminate, mixing, near_dedup, quality, token_output
from docloom.llm._shared import small_batches, written
from docloom.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that break a rule.

    Null or wordless texts go; null lang or source is a group of its own; repeated rows stay or go alike; an empty table gives an empty table; all columns stay.
    """
    small_batches(spark)
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest doc_id (ties of one doc_id: the smallest hash of text).

    Rows with a null doc_id stay, as do texts without words; an empty table gives an empty table; all columns stay.
    """
    small_batches(spark)
    return near_dedup.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without passages of the benchmark.

    Null stays null and empty empty; repeated rows are cut alike; an empty table, or benchmark, changes nothing; all columns stay.
    """
    small_batches(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fill each source's budget.

    Rows with a null doc_id, or without tokens, go; a null source is a source of its own; repeated rows stay or go alike; ties fall by hash, then doc_id;
    an empty table gives an empty table; all columns stay.
    """
    small_batches(spark)
    return mixing.mix_sources(docs)


def token_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequency-ranked ids of every row, and the vocabulary's row.

    Null text has null codes and empty text empty ones; an empty table gives the vocabulary's row alone; other columns are left out.
    """
    small_batches(spark)
    return token_output.encode_tokens(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("mixture", mixture),
    ("token_codes", token_codes),
]

#: SQL can express neither the components of near-duplicates nor the knapsack nor the tokenizer; tests/llm holds stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
