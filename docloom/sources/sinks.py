"""Exports: sections and chunks as JSON, review CSV, rules, summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import conf
from docloom.functions.text import table_markdown
from docloom.operators.review import review_order


def rag_rows(sections: DataFrame, *keys: str, most_rows: int = 10) -> DataFrame:
    """Sections for retrieval: code as it is, tables of most_rows rows at most."""
    tables = F.transform("tables", lambda t: F.struct(t["headers"].alias("headers"), F.slice(t["rows"], 1, most_rows).alias("rows"), t["caption"].alias("caption")))
    return sections.select(*keys, "id", "title", "level", "content", "breadcrumb", "code_blocks", tables.alias("tables"))


def rag_rows_v1(sections: DataFrame, *keys: str) -> DataFrame:
    """The earlier form: path, flags, and code_block_i and table_i (Markdown) in maps."""
    code, tables = F.coalesce("code_blocks", F.array()), F.coalesce("tables", F.array())
    entries = lambda prefix, xs, value: F.map_from_entries(F.transform(xs, lambda x, i: F.struct(F.concat(F.lit(prefix), i.cast("string")), value(x))))
    return sections.select(
        *keys, "id", "title", "level", "path", "content", (F.size(code) > 0).alias("has_code"), (F.size(tables) > 0).alias("has_tables"), F.array_sort(F.array_distinct(F.transform(code, lambda b: b["language"]))).alias("code_languages"), "parent_id", "breadcrumb", "section_number",
        entries("code_block_", code, lambda b: b).alias("code"), entries("table_", tables, lambda t: table_markdown(t["headers"], t["rows"], t["caption"])).alias("table"),
    )


def section_statistics(sections: DataFrame, *keys: str) -> DataFrame:
    grouped = sections.groupBy(*keys) if keys else sections.groupBy()
    return grouped.agg(*_statistics())


def _statistics() -> list[Column]:
    languages = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("code_blocks", lambda b: b["language"])))))
    return [F.count("*").alias("total_sections"), F.sum(F.size("code_blocks")).alias("total_code_blocks"), F.sum(F.size("tables")).alias("total_tables"), F.sum(F.size("mixed")).alias("total_mixed_elements"), languages.alias("languages")]


def parsed_files(sections: DataFrame, file: str = "source_file", index: str = "doc_index") -> DataFrame:
    """A row a document, as schemas.PARSED_FILE has it, with statistics; to be written as JSON. sections have parent_id."""
    mixed = F.transform("mixed", lambda m: F.struct(*[m[c].alias(c) for c in ("type", "content", "order", "language", "title", "context")]))
    each = F.struct("id", "title", "level", "section_number", "breadcrumb", mixed.alias("mixed_content"), "tables", "parent_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", each.alias("s")))), lambda x: x["s"])
    keys = [F.col(file).cast("string").alias("source_file"), F.col(index).cast("int").alias("document_index")]
    numbered = sections.withColumns({"__file": keys[0], "__index": keys[1]})
    made = numbered.where("__file is not null and __index is not null").groupBy("__file", "__index").agg(ordered.alias("sections"), *_statistics())
    statistics = F.struct(*[c for c in made.columns if c not in ("__file", "__index", "sections")]).alias("statistics")
    return made.select(F.col("__file").alias("source_file"), F.col("__index").alias("document_index"), "sections", statistics)


def batch_summary(sections: DataFrame, file: str = "source_file", index: str = "doc_index") -> DataFrame:
    """One row: totals, and details of every file's documents."""
    each = sections.groupBy(file, index).agg(F.count("*").alias("sections"), F.sum(F.size("code_blocks")).alias("code_blocks"), F.sum(F.size("tables")).alias("tables"))
    by_file = each.groupBy(file).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("document_index"), "sections", "code_blocks", "tables", F.lit("success").alias("status")))).alias("documents"))
    return by_file.agg(F.count("*").alias("files"), F.sum(F.size("documents")).alias("documents_processed"), F.sum(F.aggregate("documents", F.lit(0).cast("bigint"), lambda a, d: a + d["sections"])).alias("total_sections"), F.array_sort(F.collect_list(F.struct(F.col(file).alias("file"), "documents"))).alias("details"))


def chunk_statistics(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections with and without chunks, chunks, characters, mean size."""
    some = chunks.select(F.col("section_id").alias("id")).distinct()
    numbers = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"), F.coalesce(F.avg(F.length("content")), F.lit(0.0)).alias("avg_chars"))
    counted = sections.join(some.withColumn("known", F.lit(True)), "id", "left").agg(F.count_if(F.col("known")).alias("sections_processed"), F.count_if(F.col("known").isNull()).alias("sections_skipped"))
    return counted.crossJoin(numbers)


def write_json(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).json(path)


def write_chunks(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def next_review_name(names: list[str], base: str = "patterns_for_review") -> str:
    versions = [int(m[1]) for n in names if (m := re.search(rf"{re.escape(base)}_v(\d+)\.csv$", n))]
    return f"{base}_v{max(versions, default=0) + 1}.csv"


def write_review(merged: DataFrame, folder: str) -> str:
    """A new version of the review file, a table for people: one file, evidence with three decimals. On any file system Spark writes."""
    spark = merged.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = f"{folder.rstrip('/')}/{next_review_name([s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else [])}"
    names = ("pattern_id", "selector_type", "selector_value", "frequency", "evidence_score", "sample_content", "suggested_type", "human_decision", "notes")
    ordered = review_order(merged).withColumn("evidence_score", F.format_string("%.3f", "evidence_score"))
    ordered.select(*[F.col(c).alias(title) for c, title in zip(names, conf.REVIEW_COLUMNS)]).coalesce(1).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return path


def rules_document(rules: DataFrame) -> str:
    """Rules as YAML, in order; rules are few."""
    import yaml

    out: dict[str, list] = {}
    for r in rules.orderBy("type_ord", "rule_ord").collect():
        out.setdefault(r["content_type"], []).append({r["selector_type"]: r["selector_value"]})
    return yaml.safe_dump(out, sort_keys=False, allow_unicode=True)


REVIEW_GUIDE = """# Reviewing patterns

Write into Human Decision of each row one of: code_content, api_reference, tutorial_content, table_content,
navigation_content, documentation_text, or skip. Empty counts as skip. Rows come new first, then changed (see Notes), then
those already decided. The first fifty by evidence cover most of the content.
"""
