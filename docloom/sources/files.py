"""Parsed sections, review decisions, rules, batches and the cache index."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom import conf, schemas


def read_parsed(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Sections of parsed JSON files, a row each; content is derived from the mixed elements. lines: a document a line, as sinks.write_json() has it, not a file."""
    files = spark.read.schema(schemas.PARSED_FILE).option("multiLine", not lines).option("recursiveFileLookup", True).json(path)
    rows = files.select("source_file", "document_index", F.posexplode("sections").alias("pos", "s")).select("source_file", "document_index", "pos", "s.*")
    return rows.withColumn("content", derived_content(F.col("mixed_content"))).withColumn("code_blocks", derived_code(F.col("mixed_content")))


def derived_content(mixed: Column) -> Column:
    """Text of a section: its text elements, and [title] for code, joined by blanks."""
    said = F.transform(F.filter(mixed, lambda e: e["type"].isin("text", "code")), lambda e: F.when(e["type"] == "text", e["content"]).otherwise(F.concat(F.lit("["), F.coalesce(e["title"], F.lit("code")), F.lit("]"))))
    return F.array_join(said, " ")


def derived_code(mixed: Column) -> Column:
    return F.transform(F.filter(mixed, lambda e: e["type"] == "code"), lambda e: F.struct(F.coalesce(e["language"], F.lit("text")).alias("language"), F.trim(e["content"]).alias("content")))


def _version(name: Column) -> Column:
    return F.expr("0") if name is None else F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(name, r"_v(\d+)\.csv(?:/[^/]*)?$", 1), F.lit("")), F.lit("9999999999")).cast("int"), F.lit(0))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of review CSV files with a selector; numbers that can't be read are 0. Adds version (0: an unversioned file)."""
    names = ["pattern_id", "selector_type", "selector_value", "frequency", "evidence_score", "sample_content", "suggested_type", "human_decision", "notes"]
    schema = ", ".join(f"`{c}` string" for c in conf.REVIEW_COLUMNS)
    raw = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    df = raw.select(*[F.col(f"`{old}`").alias(new) for old, new in zip(conf.REVIEW_COLUMNS, names)], F.input_file_name().alias("file"))
    number = F.coalesce(F.expr("try_cast(try_cast(frequency as double) as bigint)"), F.lit(0))
    score = F.coalesce(F.expr("try_cast(evidence_score as double)"), F.lit(0.0))
    text = {c: F.coalesce(c, F.lit("")) for c in ("sample_content", "suggested_type", "human_decision", "notes")}
    kept = df.where("length(trim(selector_type)) > 0 and length(trim(selector_value)) > 0")
    return kept.withColumns({"frequency": number, "evidence_score": score, **text, "version": _version(F.col("file"))}).drop("file")


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """One row a selector: the unversioned file's, else that of the highest version."""
    order = W.partitionBy("selector_type", "selector_value").orderBy((F.col("version") != 0), F.desc("version"), "pattern_id")
    return decisions.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")


def rules_frame(spark: SparkSession, rules: dict[str, list[dict[str, str]]]) -> DataFrame:
    """Rules as rows in their order: type_ord (0: skip_content), rule_ord, content_type, selector_type, selector_value."""
    order = sorted(rules, key=lambda t: t != "skip_content")
    rows = [(i, j, kind, *next(iter(rule.items()))) for i, kind in enumerate(order) for j, rule in enumerate(rules[kind] or [])]
    return spark.createDataFrame(rows, schemas.RULES)


def read_rules(path: str) -> dict[str, list[dict[str, str]]]:
    """A rule file; none if it isn't there."""
    import os

    import yaml

    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file) or {}


def default_rules() -> dict[str, list[dict[str, str]]]:
    return {kind: [{t: v} for t, names in (("class", classes), ("attr", attributes), ("tag", tags)) for v in names.split()] for kind, classes, attributes, tags in conf.DEFAULT_RULES}


def latest_batch(spark: SparkSession, folder: str) -> str | None:
    """Of folder's directories batch_YYYYmmdd_HHMMSS, the one changed last (ties: the last by name), on any file system Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        return None
    found = [(s.getModificationTime(), s.getPath().getName(), s.getPath().toString()) for s in system.listStatus(at) if s.isDirectory()]
    found = [x for x in found if re.fullmatch(r"batch_\d{8}_\d{6}", x[1])]
    return max(found)[2] if found else None


def file_index(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size and modification time, without reading contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def stale_files(originals: DataFrame, cache: DataFrame) -> DataFrame:
    """originals (path, mtime) without a cache row (path, cached_mtime) younger than they are."""
    fresh = cache.select("path", "cached_mtime")
    return originals.join(fresh, "path", "left").where("cached_mtime is null or cached_mtime <= mtime").drop("cached_mtime")


def refreshed_cache(originals: DataFrame, cache: DataFrame, now: datetime, force_refresh: bool = False) -> DataFrame:
    """The cache's rows after a run at now: stale files (all, if forced) are cached anew, and rows whose file is gone go; refreshed tells which."""
    todo = (originals if force_refresh else stale_files(originals, cache)).select("path")
    kept = cache.select("path", "cached_mtime").join(originals.select("path"), "path", "left_semi").join(todo, "path", "left_anti").withColumn("refreshed", F.lit(False))
    return kept.unionByName(todo.select("path", F.lit(now).cast("timestamp").alias("cached_mtime"), F.lit(True).alias("refreshed")))


def purge_cache(cache: DataFrame, days: int, now: datetime) -> DataFrame:
    """Cache rows of the last days."""
    return cache.where(F.col("cached_mtime") >= F.lit(now) - F.expr(f"interval {int(days)} days"))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("n_files"), F.round(F.coalesce(F.sum("size"), F.lit(0)) / 1048576, 2).alias("mb"), F.min("cached_mtime").alias("oldest"), F.max("cached_mtime").alias("newest"))


def fresh_answers(cache: DataFrame, now: datetime, hours: int = conf.CACHE_HOURS, source_version: str | None = None) -> DataFrame:
    """Answers within their time to live, of the given source version."""
    kept = cache.where(F.col("created_at") >= F.lit(now) - F.expr(f"interval {int(hours)} hours"))
    return kept if source_version is None else kept.where(F.col("source_version") == source_version)
