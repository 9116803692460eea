"""Mining of markup patterns: counts, samples, coverage, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom import conf
from docloom.functions import evidence as E
from docloom.functions.text import any_hit, generalise_id
from docloom.operators.lineage import cut

_TAG = r"<([a-zA-Z][a-zA-Z0-9]*)((?:\s[^<>]*)?)>"


def opening_tags(html: Column) -> Column:
    """All opening tags of a page, by regex in the JVM: for counts that need no tree."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.regexp_extract_all(bare, F.lit(_TAG), F.lit(0))


def tag_elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, tag and attributes (raw) of every opening tag."""
    tags = pages.select(F.col(key), F.posexplode(opening_tags(F.col(html))).alias("pos", "raw"))
    return tags.select(key, "pos", F.lower(F.regexp_extract("raw", _TAG, 1)).alias("tag"), F.regexp_extract("raw", _TAG, 2).alias("attributes"))


def classes_of(attributes: Column) -> Column:
    value = F.regexp_extract(attributes, r"""(?i)\sclass\s*=\s*["']([^"']*)["']""", 1)
    return F.filter(F.split(value, r"\s+"), lambda c: c != "")


def data_attributes(attributes: Column) -> Column:
    return F.transform(F.regexp_extract_all(attributes, F.lit(r"\s(data-[a-zA-Z0-9_-]+)"), F.lit(1)), F.lower)


def element_patterns(tag: Column, classes: Column, attributes: Column, element_id: Column, ids: bool = True, tags: bool = False) -> Column:
    """Pattern ids of an element: class_, attr_ (data- attributes), id_ (generalised) and tag_."""
    parts = [F.transform(classes, lambda c: F.concat(F.lit("class_"), c)), F.transform(attributes, lambda a: F.concat(F.lit("attr_"), a))]
    none = F.array().cast("array<string>")
    if ids:
        parts.append(F.when(F.length(element_id) > 0, F.array(F.concat(F.lit("id_"), generalise_id(element_id)))).otherwise(none))
    if tags:
        parts.append(F.array(F.concat(F.lit("tag_"), tag)))
    return F.concat(*parts)


def pattern_rows(elements: DataFrame, ids: bool = True, tags: bool = False) -> DataFrame:
    """A row a pattern of each element (tag_elements() or nodes with classes and attrs)."""
    if "attrs" in elements.columns:
        classes, attributes, own = F.col("classes"), F.filter(F.map_keys("attrs"), lambda k: F.startswith(k, F.lit("data-"))), F.element_at("attrs", F.lit("id"))
    else:
        classes, attributes = classes_of(F.col("attributes")), data_attributes(F.col("attributes"))
        own = F.regexp_extract("attributes", r"""(?i)\sid\s*=\s*["']([^"']*)["']""", 1)
    return elements.select("*", F.explode(element_patterns(F.col("tag"), classes, attributes, own, ids, tags)).alias("pattern_id"))


def pattern_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pattern_id").agg(F.count("*").alias("frequency"))


def top_patterns(counts: DataFrame, k: int) -> DataFrame:
    """The k commonest; ties: the smaller id."""
    return counts.orderBy(F.desc("frequency"), "pattern_id").limit(k)


def with_value(counts: DataFrame) -> DataFrame:
    """high_value and tier of each pattern."""
    return counts.withColumn("high_value", E.high_value(F.col("pattern_id"), F.col("frequency"))).withColumn("tier", E.tier(F.col("pattern_id"), F.col("frequency")))


def _digest(seed: int, keys: tuple[str, ...]) -> Column:
    """A row's digest by keys, the same in every run and in every engine."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def hash_sample(df: DataFrame, ratio: float, *keys: str, seed: int = 0) -> DataFrame:
    """Rows by digest of keys: the same in every run, and of a larger ratio a superset."""
    return df.where(F.conv(F.substring(_digest(seed, keys), 1, 7), 16, 10).cast("bigint") < int(ratio * (1 << 28)))


def reservoir(df: DataFrame, k: int, *keys: str, seed: int = 0) -> DataFrame:
    """A uniform sample of k rows, the same in every run."""
    return df.orderBy(_digest(seed, keys), *keys).limit(k)


def sampling_ratio(sampled: DataFrame, processed: DataFrame) -> DataFrame:
    """Rows sampled over rows processed, null where there are none, in one row."""
    return sampled.agg(F.count("*").alias("n_sampled")).crossJoin(processed.agg(F.count("*").alias("n_processed"))).withColumn("ratio", F.try_divide("n_sampled", "n_processed"))


def hybrid_scan(rows: DataFrame, valuable: DataFrame, sampled: DataFrame, ratio: float) -> DataFrame:
    """Counts of valuable patterns over all rows, and of the others over sampled rows, scaled by ratio."""
    full = pattern_counts(rows.join(F.broadcast(valuable.select("pattern_id")), "pattern_id", "left_semi")) if _small(valuable) else pattern_counts(rows.join(valuable.select("pattern_id"), "pattern_id", "left_semi"))
    rest = pattern_counts(sampled.join(valuable.select("pattern_id"), "pattern_id", "left_anti"))
    return combine_scans(full, rest, ratio)


def _small(df: DataFrame, most: int = 100_000) -> bool:
    return df.limit(most + 1).count() <= most


def combine_scans(full: DataFrame, sampled: DataFrame, ratio: float) -> DataFrame:
    """full, and of sampled what full lacks, scaled up."""
    rest = sampled.join(full.select("pattern_id"), "pattern_id", "left_anti")
    return full.select("pattern_id", "frequency").unionByName(rest.select("pattern_id", E.scaled(F.col("frequency"), ratio).alias("frequency")))


def coverage(baseline: DataFrame, discovered: DataFrame) -> DataFrame:
    """overall_coverage (0 without a baseline), coverage of each tier (1 without patterns) and the patterns' numbers, in one row."""
    both = with_value(baseline).join(discovered.select("pattern_id", F.col("frequency").alias("found")), "pattern_id", "left")
    part = lambda t: F.coalesce(F.try_divide(F.sum(F.when(F.col("tier") == t, F.coalesce("found", F.lit(0)))), F.sum(F.when(F.col("tier") == t, F.col("frequency")))), F.lit(1.0))
    whole = F.coalesce(F.try_divide(F.sum(F.coalesce("found", F.lit(0))), F.sum("frequency")), F.lit(0.0))
    return both.agg(whole.alias("overall_coverage"), *[part(t).alias(f"{t}_coverage") for t in ("high", "medium", "low")], F.count("*").alias("n_baseline"), F.count("found").alias("n_found"))


def coverage_by_type(baseline: DataFrame, discovered: DataFrame) -> DataFrame:
    """Coverage of each content type with patterns; a pattern may belong to several."""
    kinds = F.filter(F.array(*[F.when(any_hit(F.lower("pattern_id"), words.split()), F.lit(t)) for t, words in conf.COVERAGE_TYPES.items()]), lambda t: t.isNotNull())
    both = baseline.join(discovered.select("pattern_id", F.col("frequency").alias("found")), "pattern_id", "left")
    each = both.select("frequency", "found", F.explode(kinds).alias("content_type"))
    return each.groupBy("content_type").agg((F.sum(F.coalesce("found", F.lit(0))) / F.sum("frequency")).alias("coverage"))


def missing_patterns(baseline: DataFrame, discovered: DataFrame, k: int = 50) -> DataFrame:
    return top_patterns(baseline.join(discovered.select("pattern_id"), "pattern_id", "left_anti"), k)


def class_depths(nodes: DataFrame, least: int = 3) -> DataFrame:
    """Depths of each class seen least times or more."""
    each = nodes.select(F.explode("classes").alias("class"), "depth")
    return each.groupBy("class").agg(F.avg("depth").alias("avg_depth"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), F.count("*").alias("n")).where(F.col("n") >= least)


def class_texts(nodes: DataFrame, least: int = 3) -> DataFrame:
    each = nodes.select(F.explode("classes").alias("class"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))
    out = each.groupBy("class").agg(F.avg("n_chars").alias("avg_length"), F.max("n_chars").alias("max_length"), F.avg(F.when(F.col("n_chars") > 10, 1.0).otherwise(0.0)).alias("content_share"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least)


def class_characteristics(nodes: DataFrame) -> DataFrame:
    """Mean text length, three commonest tags and share with children of each class."""
    each = nodes.select(F.explode("classes").alias("class"), "tag", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), "has_children")
    tags = each.groupBy("class", "tag").count().withColumn("place", F.row_number().over(W.partitionBy("class").orderBy(F.desc("count"), "tag"))).where("place <= 3")
    tags = tags.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "tag"))), lambda x: x["tag"]).alias("top_tags"))
    return each.groupBy("class").agg(F.avg("n_chars").alias("avg_text_length"), F.avg(F.col("has_children").cast("double")).alias("children_share")).join(tags, "class")


def first_samples(rows: DataFrame, *order: str, most: int = 200) -> DataFrame:
    """Of each pattern, the first non-empty text, cut and trimmed."""
    text = F.trim(F.substring("text", 1, most))
    return rows.where(F.length(text) > 0).groupBy("pattern_id").agg(F.min_by(text, F.struct(*order)).alias("sample_content"))


def pattern_scan(rows: DataFrame, *order: str, most: int = 200) -> DataFrame:
    """pattern_counts() and first_samples() in one aggregation."""
    text = F.trim(F.substring("text", 1, most))
    return rows.groupBy("pattern_id").agg(F.count("*").alias("frequency"), F.min_by(text, F.when(F.length(text) > 0, F.struct(*order))).alias("sample_content"))


def snapshot(nodes: DataFrame, ratio: float = conf.SAMPLE_RATIO, seed: int = 0) -> dict[str, DataFrame]:
    """Counts (of all kinds in one pass), depths, texts and a sample of nodes (doc, node, tag, classes, attrs, depth, text)."""
    rows = pattern_rows(nodes, tags=True)
    sample = reservoir(hash_sample(nodes, ratio, "doc", "node", seed=seed), int(conf.RESERVOIR * ratio), "doc", "node", seed=seed)
    counts = cut(pattern_counts(rows))
    kinds = {name: counts.where(F.startswith("pattern_id", F.lit(p))) for name, p in (("classes", "class_"), ("attributes", "attr_"), ("ids", "id_"), ("tags", "tag_"))}
    limits = {"tags": 30, "classes": 100, "attributes": 50, "ids": 30}
    return {k: top_patterns(v, limits[k]) for k, v in kinds.items()} | {"depths": class_depths(nodes), "texts": class_texts(nodes), "sample": sample}


def candidates(counts: DataFrame, samples: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """Patterns but for tags as scored candidates. samples: pattern_id, sample_content (else counts' own); lengths: pattern_id, avg_text_length."""
    kind = F.when(F.startswith("pattern_id", F.lit("class_")), "class").when(F.startswith("pattern_id", F.lit("attr_")), "attr").when(F.startswith("pattern_id", F.lit("id_")), "id_pattern")
    value = F.regexp_replace("pattern_id", "^(?:class|attr|id)_", "")
    out = counts.withColumn("selector_type", kind).where("selector_type is not null").withColumn("selector_value", value)
    if samples is not None:
        out = out.join(samples, "pattern_id", "left")
    elif "sample_content" not in out.columns:
        out = out.withColumn("sample_content", F.lit(None).cast("string"))
    out = out.join(lengths, "pattern_id", "left") if lengths is not None else out.withColumn("avg_text_length", F.lit(0.0))
    out = out.withColumn("sample_content", F.coalesce("sample_content", F.lit(""))).withColumn("avg_text_length", F.coalesce("avg_text_length", F.lit(0.0)))
    out = out.withColumn("evidence_score", E.evidence_score(F.col("selector_value"), F.col("frequency"), F.col("sample_content"), F.col("avg_text_length")))
    return out.withColumn("suggested_type", E.suggested_type(F.col("selector_value"), F.col("sample_content"), F.col("evidence_score")))


def frequent_candidates(scored: DataFrame, classes: int = 3, attributes: int = 5) -> DataFrame:
    return scored.where(((F.col("selector_type") == "class") & (F.col("frequency") >= classes)) | ((F.col("selector_type") == "attr") & (F.col("frequency") >= attributes)))


def top_candidates(scored: DataFrame, k: int = 200) -> DataFrame:
    return scored.orderBy(F.desc("evidence_score"), "pattern_id").limit(k)


def adaptive_discovery(nodes: DataFrame, target: float = conf.TARGET_COVERAGE, ratio: float = conf.SAMPLE_RATIO, attempts: int = conf.MOST_ATTEMPTS, seed: int = 0) -> tuple[DataFrame, DataFrame, float]:
    """Scans until the coverage reaches target, with a larger sample each time; patterns, coverage and the last ratio.

    The whole is counted in one pass over nodes. A sample of a ratio below 1 is a pass each, over nodes that are written before the first of them.
    """
    counts = cut(pattern_counts(pattern_rows(nodes, tags=True)))
    baseline, whole = counts.where(~F.startswith("pattern_id", F.lit("tag_"))), counts.where(~F.startswith("pattern_id", F.lit("id_")))
    valuable = with_value(baseline).where("high_value").select("pattern_id")
    full, written = whole.join(valuable, "pattern_id", "left_semi"), None
    for _ in range(attempts):
        sampled = whole
        if ratio < 1:
            written = written or cut(nodes)
            sampled = cut(pattern_counts(pattern_rows(hash_sample(written, ratio, "doc", "node", seed=seed), ids=False, tags=True)))
        found = combine_scans(full, sampled.join(valuable, "pattern_id", "left_anti"), ratio)
        measured = coverage(baseline, found)
        row = measured.first()
        if row["overall_coverage"] >= target:
            break
        if row["low_coverage"] < 0.8:
            ratio = min(1.5 * ratio, conf.MOST_RATIO)
    return found, measured, ratio


def cross_check(nodes: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Tags counted by the tree's nodes and by regex, side by side."""
    by_tree = nodes.groupBy("tag").agg(F.count("*").alias("by_tree"))
    by_regex = tag_elements(pages, key).groupBy("tag").agg(F.count("*").alias("by_regex"))
    return by_tree.join(by_regex, "tag", "full").select("tag", F.coalesce("by_tree", F.lit(0)).alias("by_tree"), F.coalesce("by_regex", F.lit(0)).alias("by_regex"))
