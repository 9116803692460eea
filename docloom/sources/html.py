"""HTML files: scan, split into documents, flatten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DOCTYPE = r"<!DOCTYPE\s+html[^>]*>"


def read_html(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """source_file and html of every file."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.text(path, wholetext=True).select(F.input_file_name().alias("source_file"), F.col("value").alias("html"))


def count_documents(html: Column) -> Column:
    return F.regexp_count(html, F.lit("(?i)" + _DOCTYPE))


def split_documents(df: DataFrame, html: str = "html") -> DataFrame:
    """A row a document, with doc_index and total_documents; text before the first DOCTYPE goes; without one all is document 0."""
    trimmed = F.transform(F.split(F.col(html), "(?i)(?=" + _DOCTYPE + ")"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    parts = F.filter(trimmed, lambda x: x.rlike("(?i)^" + _DOCTYPE))
    whole = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.col(html)))
    rest = [c for c in df.columns if c != html]
    return df.where(F.col(html).isNotNull()).select(*rest, F.size(whole).alias("total_documents"), F.posexplode(whole).alias("doc_index", html))


def select_document(df: DataFrame, index: int) -> DataFrame:
    """Document index of each file; an error where a file has no such document."""
    wanted = F.when(F.lit(index) < F.col("total_documents"), F.col("doc_index") == index).otherwise(F.raise_error(F.concat(F.lit(f"no document {index} among "), F.col("total_documents").cast("string"))))
    return df.where(wanted.cast("boolean"))


def content_documents(df: DataFrame) -> DataFrame:
    """Without document 0 where there are several: it repeats the rest."""
    return df.where((F.col("total_documents") == 1) | (F.col("doc_index") > 0))


def without_doctype(html: Column) -> Column:
    return F.regexp_replace(html, "(?i)^<!DOCTYPE[^>]*>", "")


def flattened(html: Column, title: str = "Documents") -> Column:
    """One document of all: without inner DOCTYPE, html and body tags, wrapped once."""
    bare = html
    for pattern in (_DOCTYPE, r"<html[^>]*>", r"<body[^>]*>", r"</html>", r"</body>"):
        bare = F.regexp_replace(bare, "(?i)" + pattern, "")
    head = f'<!DOCTYPE html>\n<html>\n<head><meta charset="utf-8"><title>{title}</title></head>\n<body>\n'
    return F.concat(F.lit(head), F.regexp_replace(bare, r"^\s+|\s+$", ""), F.lit("\n</body>\n</html>"))
