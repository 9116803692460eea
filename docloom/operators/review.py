"""Human review: merge with earlier decisions, rules from decisions, classification by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom import conf
from docloom.functions import evidence as E

MAP_RULES = 20_000


def merge_review(scored: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates beside earlier decisions. priority 1: new; 2: changed much, to be decided again; 3: as before, its decision kept.

    decisions has one row a selector (sources.files.latest_decisions()).
    """
    old = decisions.select("selector_type", "selector_value", F.col("frequency").alias("old_frequency"), F.col("evidence_score").alias("old_evidence"), F.col("suggested_type").alias("old_type"), "human_decision", F.col("notes").alias("old_notes"), F.lit(True).alias("known"))
    both = scored.join(old, ["selector_type", "selector_value"], "left")
    note = E.change_note(F.coalesce("old_frequency", F.lit(0)), F.col("frequency"), F.coalesce("old_evidence", F.lit(0.0)), F.col("evidence_score"))
    both = both.withColumn("change", F.when(F.col("known"), note))
    priority = F.when(F.col("known").isNull(), 1).when(F.col("change") != "", 2).otherwise(3)
    kept = lambda c, other: F.when(F.col("priority") == 3, F.coalesce(c, F.lit(""))).otherwise(other)
    both = both.withColumn("priority", priority)
    return both.select(
        "pattern_id", "selector_type", "selector_value", "frequency", "evidence_score", F.substring("sample_content", 1, 100).alias("sample_content"),
        kept("old_type", F.col("suggested_type")).alias("suggested_type"), kept("human_decision", F.lit("")).alias("human_decision"), kept("old_notes", F.coalesce("change", F.lit(""))).alias("notes"), "priority",
    )


def review_order(merged: DataFrame) -> DataFrame:
    """New, changed, old; by falling evidence of three decimals; ties: the smaller id."""
    return merged.orderBy("priority", F.desc(F.round("evidence_score", 3)), "pattern_id")


def decision_breakdown(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy(F.coalesce(F.nullif(F.trim("human_decision"), F.lit("")), F.lit("empty")).alias("decision")).agg(F.count("*").alias("n"))


def decision_statistics(decisions: DataFrame) -> DataFrame:
    """One row: rows, files (versions), the latest version, and rows that are decided."""
    decided = F.length(F.trim(F.coalesce("human_decision", F.lit("")))) > 0
    return decisions.agg(F.count("*").alias("n_rows"), F.count_distinct("version").alias("n_files"), F.max("version").alias("latest_version"), F.count_if(decided).alias("n_decided"))


def compile_rules(decisions: DataFrame) -> DataFrame:
    """Rules of decided patterns: undecided and skip go to skip_content, with the media rules if there is any; id patterns go nowhere.

    The rules' order within a type is that of pattern_id.
    """
    kind = F.lower(F.trim(F.coalesce("human_decision", F.lit(""))))
    own = decisions.where(F.col("selector_type").isin("class", "attr", "tag")).select(F.when(kind.isin("", "skip"), "skip_content").otherwise(kind).alias("content_type"), "selector_type", "selector_value", F.col("pattern_id").alias("by"))
    spark = decisions.sparkSession
    media = spark.createDataFrame([("tag", t) for t in conf.MEDIA_TAGS] + [("class", c) for c in conf.MEDIA_CLASSES], "selector_type string, selector_value string")
    media = media.withColumn("by", F.lit("￿")).withColumn("content_type", F.lit("skip_content"))
    media = media.join(own.where("content_type = 'skip_content'").limit(1).select(F.lit(True).alias("some")), F.lit(True), "left_semi")
    every = own.unionByName(media.select(own.columns))
    types = every.groupBy("content_type").agg(F.min("by").alias("by")).withColumn("type_ord", F.row_number().over(W.orderBy(F.col("content_type") != "skip_content", "by", "content_type")) - 1)
    place = W.partitionBy("content_type").orderBy("by", "selector_type", "selector_value")
    return every.withColumn("rule_ord", F.row_number().over(place) - 1).join(types.select("content_type", "type_ord"), "content_type").select("type_ord", "rule_ord", "content_type", "selector_type", "selector_value")


def rules_by_type(rules: DataFrame) -> DataFrame:
    each = F.struct("rule_ord", "selector_type", "selector_value")
    return rules.groupBy("type_ord", "content_type").agg(F.transform(F.array_sort(F.collect_list(each)), lambda r: F.struct(r["selector_type"].alias("selector_type"), r["selector_value"].alias("selector_value"))).alias("rules"))


def classify(nodes: DataFrame, rules: DataFrame, *keys: str) -> DataFrame:
    """keys and label of each node (tag, classes, attrs): SKIP, or the type of the first rule that fits, else the default.

    Up to MAP_RULES rules become one broadcast map of selectors that each node probes, so nodes aren't shuffled; more are joined to the nodes' selectors by hash.
    keys identify a node in the second case.
    """
    order = F.struct("type_ord", "rule_ord", "content_type")
    by_selector = rules.groupBy(F.concat_ws("\0", "selector_type", F.when(F.col("selector_type") == "tag", F.lower("selector_value")).otherwise(F.col("selector_value"))).alias("selector")).agg(F.min(order).alias("rule"))
    selectors = F.concat(F.transform("classes", lambda c: F.concat(F.lit("class\0"), c)), F.transform(F.map_keys("attrs"), lambda a: F.concat(F.lit("attr\0"), a)), F.array(F.concat(F.lit("tag\0"), F.lower("tag"))))
    if rules.limit(MAP_RULES + 1).count() <= MAP_RULES:
        lookup = by_selector.agg(F.map_from_entries(F.collect_list(F.struct("selector", "rule"))).alias("lookup"))
        joined = nodes.crossJoin(F.broadcast(lookup)).withColumn("rule", F.array_min(F.transform(selectors, lambda s: F.element_at(F.col("lookup"), s))))
    else:
        joined = nodes.select(*keys, F.explode(selectors).alias("selector")).join(by_selector, "selector", "left").groupBy(*keys).agg(F.min("rule").alias("rule"))
    kind = F.col("rule.content_type")
    return joined.select(*keys, F.when(kind == "skip_content", "SKIP").otherwise(F.coalesce(kind, F.lit(conf.DEFAULT_TYPE))).alias("label"))
