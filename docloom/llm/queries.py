"""The queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, html_diff, language_id, mixing, near_dedup, quality, substring_dedup, token_output, toxicity, warc
from docloom.llm._shared import small_batches
from docloom.sources.tables import read_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payload as base64 text, which compares alike everywhere."""
    rows = warc.warc_chunks(_table(spark, sf_dir, "pages"))
    return rows.withColumn("payload", F.base64("payload")).drop("digest_ok").withColumn("payload", F.regexp_replace("payload", "[\r\n]+", ""))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "group_id", "duplicate")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    cut = decontaminate.decontaminate(docs.select("doc_id", "text"), items, flag="removed_words")
    return cut.withColumn("contaminated", F.col("removed_words") > 0)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.filter_quality(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate_passages(_table(spark, sf_dir, "documents"))


def op6_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode_tokens(_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_language(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_html_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract_by_difference(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_warc_chunks, op2_near_dedup, op3_decontaminate, op4_quality_rules, op5_substring_dedup, op6_token_codes, op7_mix_sources, op8_language_id, op9_toxicity, op10_html_diff)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    chunk = warc.CHUNK_BYTES
    return {
        "op1_warc_chunks": f"""select 'urn:docloom:page:' || page_id record_id, page_id, url, i chunk_no, i * {chunk} chunk_offset,
            octet_length(b[i * {chunk} + 1 : (i + 1) * {chunk}]) chunk_bytes, base64(b[i * {chunk} + 1 : (i + 1) * {chunk}]) payload, sha256(b[1 : (i + 1) * {chunk}]) digest, (i + 1) * {chunk} >= octet_length(b) is_last
            from (select page_id, url, b, unnest(range(greatest(1, cast(ceil(octet_length(b) / {chunk}) as bigint)))) i from (select page_id, url, encode(html) b from pages))""",
        "op4_quality_rules": quality.oracle("doc_id, text, lang, source, n_chars"),
    }
