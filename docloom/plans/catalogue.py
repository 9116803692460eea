"""Named queries over the driver's tables, one or more for each operator family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom import conf
from docloom.conf import ChunkConfig
from docloom.functions import evidence as E
from docloom.functions import text as T
from docloom.operators import chunking as C
from docloom.operators import html as H
from docloom.operators import patterns as P
from docloom.operators import placeholders as PH
from docloom.operators import retrieval as R
from docloom.operators import review as V
from docloom.operators import section_chunks as SC
from docloom.operators.lineage import cut, scratch
from docloom.plans import documentation, documentation_sql, oracles
from docloom.sources import files, html as S
from docloom.sources.tables import read_table
from docloom.sources import sinks as K

__all__ = ["entry_query", "oracle_sql", "queries"]

LINES = ChunkConfig(max_size=1000, overlap=200, paragraph="\n", header=False, sentences=False)
ENDS = ChunkConfig(max_size=1000, min_size=100, overlap=200, header=False)
RATIO = 0.1

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return {**_QUERIES, **documentation.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**oracles.oracle_sql(), **documentation_sql.oracle_sql(), **documentation_sql.chunk_sql()}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


# --- sources ---


@_query
def doc_count_per_page(spark, sf):
    return _t(spark, sf, "pages").select("page_id", S.count_documents(F.col("html")).alias("n_docs"))


@_query
def flatten_multi_html(spark, sf):
    flat = S.flattened(F.concat("html", F.lit("\n"), "html"))
    return _t(spark, sf, "pages").select("page_id", F.md5(flat.cast("binary")).alias("digest"), F.length(flat).alias("n_chars"))


@_query
def split_multi_html(spark, sf):
    twice = _t(spark, sf, "pages").select("page_id", F.concat(F.lit("lost "), "html", F.lit("\n "), "html").alias("html"))
    return S.content_documents(S.split_documents(twice)).select("page_id", "total_documents", "doc_index", F.length("html").alias("n_chars"))


@_query
def undoctyped(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.md5(S.without_doctype(F.col("html")).cast("binary")).alias("digest"))


# --- markup patterns ---


def _tags(spark, sf):
    return P.tag_elements(_t(spark, sf, "pages").select("page_id", "html"))


@_query
def tag_freq(spark, sf):
    return _tags(spark, sf).groupBy("tag").agg(F.count("*").alias("n"))


@_query
def class_freq(spark, sf):
    return _tags(spark, sf).select(F.explode(P.classes_of(F.col("attributes"))).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@_query
def attr_freq(spark, sf):
    names = F.regexp_extract_all("attributes", F.lit(r"\s([a-zA-Z-]+)\s*="), F.lit(1))
    return P.top_patterns(_tags(spark, sf).select(F.explode(names).alias("pattern_id")).groupBy("pattern_id").agg(F.count("*").alias("frequency")), 50)


def _counts(spark, sf, where=None):
    rows = P.pattern_rows(_tags(spark, sf), tags=True)
    return P.pattern_counts(rows if where is None else rows.where(where))


@_query
def top_tags(spark, sf):
    return P.top_patterns(_counts(spark, sf), 5)


@_query
def pattern_tiers(spark, sf):
    return P.with_value(_counts(spark, sf)).select("pattern_id", "frequency", "tier")


@_query
def high_value_patterns(spark, sf):
    return P.with_value(_counts(spark, sf)).where("high_value").select("pattern_id", "frequency")


@_query
def id_patterns(spark, sf):
    made = F.concat(F.lit("sec"), F.col("o_orderkey").cast("string"), F.lit("-"), F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 12))
    return _t(spark, sf, "orders").select("o_orderkey", T.generalise_id(made).alias("id_pattern"))


def _sampled_rows(spark, sf):
    return P.pattern_rows(P.hash_sample(_tags(spark, sf), RATIO, "page_id"), tags=True)


@_query
def hash_sample_scan(spark, sf):
    return P.pattern_counts(_sampled_rows(spark, sf)).select("pattern_id", E.scaled(F.col("frequency"), RATIO).alias("frequency"))


@_query
def reservoir_sample(spark, sf):
    return P.reservoir(_tags(spark, sf), 50, "page_id", "pos").select("page_id", "pos", "tag")


def _scans(spark, sf):
    """Counts of all patterns, and a scan: valuable patterns in full, the rest from the sample; those of two letters stay unknown, so that something is missing."""
    tags = cut(_tags(spark, sf))  # read three times
    rows = P.pattern_rows(tags, tags=True)
    counts = cut(P.pattern_counts(rows))
    valuable = P.with_value(counts).where("high_value and pattern_id rlike '[^_]{3,}$'")
    sampled = P.pattern_rows(P.hash_sample(tags, RATIO, "page_id"), tags=True).where("not pattern_id rlike '_..$'")
    return counts, P.hybrid_scan(rows, valuable, sampled, RATIO)


@_query
def combine_scans(spark, sf):
    return _scans(spark, sf)[1]


@_query
def coverage_overall(spark, sf):
    return P.coverage(*_scans(spark, sf)).select(F.round("overall_coverage", 6).alias("overall_coverage"), "n_baseline", "n_found")


@_query
def coverage_by_tier(spark, sf):
    return P.coverage(*_scans(spark, sf)).select(*[F.round(f"{t}_coverage", 6).alias(f"{t}_coverage") for t in ("high", "medium", "low")])


@_query
def coverage_by_type(spark, sf):
    return P.coverage_by_type(*_scans(spark, sf)).select("content_type", F.round("coverage", 6).alias("coverage"))


@_query
def missing_patterns(spark, sf):
    return P.missing_patterns(*_scans(spark, sf))


def _scored(spark, sf, where=None):
    """Tags as if they were classes; their sample is the title of their first page."""
    pages = _t(spark, sf, "pages") if where is None else _t(spark, sf, "pages").where(where)
    titled = pages.select("page_id", "html", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("text"))
    rows = titled.select("page_id", "text", F.explode(P.opening_tags(F.col("html"))).alias("raw")).select("page_id", "text", F.concat(F.lit("class_"), F.lower(F.regexp_extract("raw", r"<([a-zA-Z0-9]+)", 1))).alias("pattern_id"))
    return P.candidates(P.pattern_scan(rows, "page_id"))


@_query
def evidence_scores(spark, sf):
    return _scored(spark, sf).select("pattern_id", "selector_type", "selector_value", "frequency", F.round("evidence_score", 6).alias("evidence_score"))


@_query
def suggested_types(spark, sf):
    return _scored(spark, sf).select("pattern_id", "suggested_type")


@_query
def top_candidates(spark, sf):
    return P.top_candidates(P.frequent_candidates(_scored(spark, sf)), 8).select("pattern_id", F.round("evidence_score", 6).alias("evidence_score"))


@_query
def review_merge(spark, sf):
    """Even pages were reviewed before, but for tags of one letter."""
    old = _scored(spark, sf, F.col("page_id") % 2 == 0).where("length(selector_value) > 1").withColumns({"human_decision": F.lit("skip"), "notes": F.lit("seen")})
    return V.merge_review(_scored(spark, sf), old).select("pattern_id", "frequency", "priority", "human_decision", "notes", F.round("evidence_score", 6).alias("evidence_score"))


def _decisions(spark, sf):
    part = _t(spark, sf, "part")
    return part.select(
        F.concat(F.lit("class_"), "p_brand").alias("pattern_id"), F.lit("class").alias("selector_type"), F.col("p_brand").alias("selector_value"),
        F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, "code_content").otherwise("table_content").alias("human_decision"), F.col("p_partkey").alias("version"),
    )


@_query
def decision_breakdown(spark, sf):
    return V.decision_breakdown(_decisions(spark, sf))


@_query
def latest_decision(spark, sf):
    return files.latest_decisions(_decisions(spark, sf)).select("selector_value", "human_decision", "version")


@_query
def rules_compiled(spark, sf):
    return V.compile_rules(files.latest_decisions(_decisions(spark, sf))).select("content_type", "selector_type", "selector_value", "rule_ord", "type_ord")


@_query
def rules_grouped(spark, sf):
    made = V.rules_by_type(V.compile_rules(files.latest_decisions(_decisions(spark, sf))))
    return made.select("type_ord", "content_type", F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["selector_type"], r["selector_value"])), ",").alias("rules"))


@_query
def rules_round_trip(spark, sf):
    """Compiled rules as a YAML document, read again."""
    import os
    import tempfile

    rules = V.compile_rules(files.latest_decisions(_decisions(spark, sf)))
    with tempfile.TemporaryDirectory() as folder:  # the driver writes and reads it, within this call
        path = os.path.join(folder, "rules.yaml")
        with open(path, "w", encoding="utf-8") as file:
            file.write(K.rules_document(rules))
        return files.rules_frame(spark, files.read_rules(path))


@_query
def decision_statistics(spark, sf):
    return V.decision_statistics(_decisions(spark, sf))


@_query
def review_first_ten(spark, sf):
    """In the order of review."""
    old = _scored(spark, sf, F.col("page_id") % 2 == 0).where("length(selector_value) > 1").withColumns({"human_decision": F.lit("skip"), "notes": F.lit("seen")})
    return V.review_order(V.merge_review(_scored(spark, sf), old)).limit(10).select("pattern_id", "priority")


@_query
def review_round_trip(spark, sf):
    """The review file of all candidates, written and read as decisions."""
    new = _scored(spark, sf)
    path = K.write_review(V.merge_review(new, new.where("false").withColumns({"human_decision": F.lit(""), "notes": F.lit("")})), scratch(spark, "review"))
    return files.read_decisions(spark, path).select("pattern_id", "selector_type", "selector_value", "frequency", "evidence_score", "suggested_type", "human_decision", "version")


@_query
def classify_elements(spark, sf):
    rows = _tags(spark, sf).select("page_id", "pos", "tag", P.classes_of(F.col("attributes")).alias("classes"), F.create_map(F.lit("href"), F.lit("")).alias("attrs"))
    rules = files.rules_frame(spark, files.default_rules() | {"navigation_content": [{"tag": "nav"}, {"class": "ad"}]})
    return V.classify(rows, rules, "tag").groupBy("tag", "label").agg(F.count("*").alias("n"))


# --- trees ---


@_query
def parser_cross_check(spark, sf):
    pages = _t(spark, sf, "pages").select("page_id", "html")
    return P.cross_check(H.html_nodes(pages), pages)


def _tree(spark, sf):
    """Regions, nations and customers as a tree of dotted ids."""
    region, nation, customer = (_t(spark, sf, t) for t in ("region", "nation", "customer"))
    r = region.select((F.col("r_regionkey") + 1).cast("string").alias("id"), F.col("r_name").alias("title"), F.lit(1).alias("level"))
    n = nation.select(F.concat_ws(".", (F.col("n_regionkey") + 1).cast("string"), (F.col("n_nationkey") + 1).cast("string")).alias("id"), F.col("n_name").alias("title"), F.lit(2).alias("level"))
    c = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).where("c_custkey % 20 = 0")
    c = c.select(F.concat_ws(".", (F.col("n_regionkey") + 1).cast("string"), (F.col("n_nationkey") + 1).cast("string"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("title"), F.lit(3).alias("level"))
    return H.with_parents(r.unionByName(n).unionByName(c))


@_query
def section_hierarchy(spark, sf):
    return _tree(spark, sf).select("id", "level", "parent_id")


@_query
def section_paths(spark, sf):
    return H.with_paths(_tree(spark, sf)).select("id", "path")


@_query
def section_children(spark, sf):
    return H.with_children(_tree(spark, sf)).select("id", "n_children")


@_query
def leaf_sections(spark, sf):
    return H.with_children(_tree(spark, sf)).where("is_leaf").select("id", "title")


@_query
def section_siblings(spark, sf):
    return H.siblings(_tree(spark, sf).where("level < 3")).select("id", "sibling")


@_query
def section_descendants(spark, sf):
    return H.descendants(_tree(spark, sf)).groupBy("ancestor").agg(F.count("*").alias("n"), F.max("distance").alias("deepest"))


@_query
def sections_by_level(spark, sf):
    return H.sections_at_level(_tree(spark, sf), 2).select("id", "title")


@_query
def ordered_ids(spark, sf):
    key = H.id_order(F.col("id"))
    return _tree(spark, sf).orderBy(key, "id").select("id", F.array_join(key.cast("array<string>"), "/").alias("sort_key"))


@_query
def level_hierarchy(spark, sf):
    docs = _t(spark, sf, "documents").select("lang", F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"), (1 + F.col("doc_id") * 7 % 4).cast("int").alias("level"))
    return H.with_level_parents(docs, "lang").select("id", "parent_id")


@_query
def breadcrumb_asof(spark, sf):
    """The last long document before each, in its source."""
    crumb = H.last_before(_t(spark, sf, "documents"), F.when(F.col("n_chars") > 3000, F.col("doc_id")), "source", order="doc_id")
    return _t(spark, sf, "documents").select("doc_id", F.coalesce(crumb, F.lit(-1)).alias("crumb"))


# --- chunking ---


def _chunked(kind, config, mode="clean", prepare=lambda c: c):
    def run(spark, sf):
        docs = read_table(spark, f"{sf}/documents.parquet", heavy=True).select("doc_id", prepare(F.col("text")).alias("text"))
        made = C.chunk_documents(docs, "text", kind, config, mode=mode)
        return made.select("doc_id", "chunk_index", "total_chunks", "start_char", "end_char", "char_count", F.md5(F.col("content").cast("binary")).alias("digest"))

    return run


_QUERIES["fixed_chunks"] = _chunked("fixed_size", LINES)
_QUERIES["fixed_chunks_at_sentences"] = _chunked("fixed_size", ENDS)
_QUERIES["paragraph_chunks"] = _chunked("paragraph_based", LINES)
_QUERIES["sentence_chunks"] = _chunked("sentence_based", ENDS)
_QUERIES["sentence_chunks_paired"] = _chunked("sentence_based", ENDS, "paired")
_QUERIES["text_chunks"] = _chunked("text", ENDS)
_QUERIES["advanced_text_chunks"] = _chunked("advanced_text", LINES, prepare=lambda c: F.replace(c, F.lit("\n"), F.lit("\n\n")))


def _paragraphs(spark, sf, *more):
    docs = read_table(spark, f"{sf}/documents.parquet", heavy=True)
    return C.chunk_documents(docs.select("doc_id", *more, "text"), "text", "paragraph_based", LINES)


@_query
def chunk_overlap(spark, sf):
    made = C.chunk_documents(_t(spark, sf, "documents").select("doc_id", "text"), "text", "fixed_size", LINES)
    return C.with_overlaps(made, "doc_id").select("doc_id", "chunk_index", "overlap_previous", "overlap_next")


@_query
def paragraph_chunks_by_lang(spark, sf):
    return _paragraphs(spark, sf, "lang").groupBy("lang").agg(F.count("*").alias("n_chunks"), F.round(F.avg("char_count"), 6).alias("avg_chars"), F.max("char_count").alias("max_chars"))


@_query
def chunk_ids(spark, sf):
    return _paragraphs(spark, sf, "source").select("doc_id", "chunk_index", C.chunk_id(F.col("source"), F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), F.col("content")).alias("chunk_id"))


@_query
def chunk_sizes(spark, sf):
    return _paragraphs(spark, sf).select("doc_id", "chunk_index", "char_count", "word_count")


@_query
def chunk_quality_size(spark, sf):
    return _paragraphs(spark, sf).select("doc_id", "chunk_index", T.size_score(F.col("char_count")).alias("score"))


@_query
def chunk_completeness(spark, sf):
    return _paragraphs(spark, sf).select("doc_id", "chunk_index", T.completeness_score(F.col("content")).alias("score"))


@_query
def chunk_coherence(spark, sf):
    return _paragraphs(spark, sf).select("doc_id", "chunk_index", F.round(T.coherence_score(F.col("content")), 6).alias("score"))


@_query
def chunk_quality(spark, sf):
    """Mean quality of each document's paragraph chunks."""
    made = _paragraphs(spark, sf, "lang", "source").select("doc_id", T.chunk_quality(F.col("content"), F.col("lang"), F.col("source"), F.lit("text")).alias("quality"))
    return made.groupBy("doc_id").agg(F.round(F.avg("quality"), 6).alias("quality"))


@_query
def chunks_round_trip(spark, sf):
    """Chunks written by language and read again."""
    path = scratch(spark, "chunks")
    K.write_chunks(_paragraphs(spark, sf, "lang"), path, "lang")
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n_chunks"), F.sum("char_count").alias("chars"))


@_query
def chunk_context(spark, sf):
    made = _paragraphs(spark, sf, "lang", "source").select("doc_id", "chunk_index", "lang", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("path"), F.when(F.col("doc_id") % 3 == 0, "text").otherwise("mixed").alias("kind"))
    return made.select("doc_id", "chunk_index", F.round(T.context_score(F.col("lang"), F.col("path"), F.col("kind")), 6).alias("score"), C.context_string(F.lit("f"), F.coalesce("path", F.lit("")), F.col("lang")).alias("context"))


# --- scalar functions ---


def _scalar(**columns):
    def run(spark, sf):
        return _t(spark, sf, "documents").select("doc_id", *[f(F.col("text")).alias(name) for name, f in columns.items()])

    return run


_QUERIES["detect_code_language"] = _scalar(language=T.detect_code_language)
_QUERIES["clean_text"] = _scalar(digest=lambda t: F.md5(T.clean_text(t).cast("binary")), n_chars=lambda t: F.length(T.clean_text(t)))
_QUERIES["slug_ids"] = _scalar(slug=lambda t: T.slug(F.substring(t, 1, 60)))
_QUERIES["readability"] = _scalar(score=lambda t: F.round(T.readability(t), 6))
_QUERIES["tech_density"] = _scalar(density=lambda t: F.round(T.technical_density(t), 6))
_QUERIES["text_flags"] = _scalar(lists=T.has_lists, formulas=T.has_formulas, references=T.has_references)
_QUERIES["enough_content"] = _scalar(enough=lambda t: C.normalised(t).isNotNull())


@_query
def code_titles(spark, sf):
    names = _t(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "PY").when(F.col("doc_id") % 5 == 1, "C#").when(F.col("doc_id") % 5 == 2, "Bash").when(F.col("doc_id") % 5 == 3, "text").otherwise(F.col("lang")).alias("name"))
    return names.select("doc_id", T.normalise_language(F.col("name")).alias("language"), T.code_title(T.normalise_language(F.col("name"))).alias("title"))


def _once(df: DataFrame, *names: str) -> DataFrame:
    """df with names worked out once a row: as fields of one element of an array, they aren't put into the expressions that use them."""
    made = df.withColumn("__once", F.explode(F.array(F.struct(*names))))
    return made.select(*[c for c in df.columns if c not in names], *[F.col(f"__once.{n}").alias(n) for n in names])


def _typed(spark, sf):
    """Documents as sections: a third of them with code of a tenth to half their size."""
    docs = _t(spark, sf, "documents").select("doc_id", "text", (1 + F.col("doc_id") % 4).cast("int").alias("level"), (F.col("doc_id") % 6 / 10.0).alias("code_ratio"), (F.col("doc_id") % 5 / 10.0).alias("table_ratio"), F.col("n_chars"))
    docs = docs.withColumn("density", T.technical_density(F.col("text")))
    docs = _once(docs.withColumn("complexity", T.structure_complexity(F.col("level"), (F.col("code_ratio") * 10).cast("int"), F.lit(0), F.col("text"))), "density", "complexity")
    docs = docs.withColumn("content_type", T.content_type(1 - F.col("code_ratio"), F.col("code_ratio"), F.col("table_ratio"), F.col("level"), F.col("density")))
    return docs.withColumn("strategy", T.strategy(F.col("content_type"))).withColumn("confidence", T.confidence(F.col("content_type"), F.col("complexity"), F.col("code_ratio"), F.col("n_chars")))


@_query
def content_type(spark, sf):
    return _typed(spark, sf).select("doc_id", "content_type", "strategy", F.round("complexity", 6).alias("complexity"), F.round("confidence", 6).alias("confidence"))


@_query
def strategy_vote(spark, sf):
    return SC.strategy_votes(_typed(spark, sf)).select("strategy", "votes", F.round("weight", 4).alias("weight"))


@_query
def section_complexity(spark, sf):
    docs = _t(spark, sf, "documents")
    score = T.section_complexity(F.col("n_chars"), F.col("doc_id") % 7, F.col("doc_id") % 4, F.col("doc_id") % 12, F.col("text"))
    flags = T.size_flags(F.col("n_chars") + F.col("doc_id") % 3 * 700, F.col("n_chars"), F.col("doc_id") % 3 * 700, F.col("doc_id") % 5)
    return docs.select("doc_id", F.round(score, 6).alias("score"), flags.alias("f")).select("doc_id", "score", "f.*")


@_query
def config_for_title(spark, sf):
    title = F.substring("text", 1, 200)
    return _t(spark, sf, "documents").select("doc_id", T.config_for_title(title).alias("preset"), T.config_for_file(F.concat(F.when(F.col("doc_id") % 3 == 0, "Research-").when(F.col("doc_id") % 3 == 1, "a-lean-cli-").otherwise("x"), F.lit(".html"))).alias("by_file"))


def _tables(spark, sf):
    """Orders as ragged tables of strings."""
    lines = _t(spark, sf, "lineitem").where("l_orderkey % 10 = 0").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.array(F.col("l_partkey").cast("string"), F.col("l_returnflag"))).otherwise(F.array(F.col("l_partkey").cast("string"), F.col("l_returnflag"), F.col("l_linestatus"), F.lit("x"))).alias("row"))
    made = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "row"))), lambda x: x["row"]).alias("rows"))
    return made.select("l_orderkey", F.array(F.lit("part"), F.lit("flag"), F.lit("status")).alias("headers"), "rows", F.when(F.col("l_orderkey") % 20 == 0, F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"))).alias("caption"))


@_query
def table_markdown(spark, sf):
    return _tables(spark, sf).select("l_orderkey", T.table_markdown(F.col("headers"), F.col("rows"), F.col("caption")).alias("markdown"))


@_query
def table_sizes(spark, sf):
    args = [F.col(c) for c in ("headers", "rows", "caption")]
    return _tables(spark, sf).select("l_orderkey", T.table_chars(*args).alias("with_separators"), T.table_chars(*args, 0).alias("chars"))


# --- placeholders, retrieval, caches ---


@_query
def patched_placeholders(spark, sf):
    """Each part's page names its brand and its type; brands ending in 1 to 3 are known in Python, in 3 and 4 in C#."""
    part = _t(spark, sf, "part")
    pages = part.select("p_partkey", F.concat(F.lit('<p>a</p><div data-tree="'), "p_brand", F.lit('">gone</div><DIV data-tree=\''), "p_type", F.lit("'/>")).alias("html"))
    brands = part.select(F.col("p_brand").alias("name")).distinct().select("name", F.explode(F.array(F.lit("python"), F.lit("csharp"))).alias("language")).where("(language = 'python' and name rlike '[123]$') or (language = 'csharp' and name rlike '[34]$')")
    types = PH.rendered(brands.withColumn("response", F.to_json(F.struct(F.col("name").alias("type-name"), F.lit("d").alias("description")))))
    return PH.patch(pages, types, "p_partkey").select("p_partkey", "n_found", "n_patched", "n_failed", "status", F.contains("html", F.lit("gone")).alias("unpatched"))


@_query
def resolution_stats(spark, sf):
    part = _t(spark, sf, "part").select(F.col("p_brand").alias("value"), F.when(F.col("p_brand").rlike("[123]$"), F.lit("x")).alias("content"))
    return PH.resolution_stats(part).select("total", "successful", "failed", F.round("rate", 6).alias("rate"))


@_query
def vector_topk(spark, sf):
    vectors = _t(spark, sf, "embeddings")
    query = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.top_k(vectors, query, 5).select("query_id", "vec_id", "rank", F.round("similarity", 5).alias("similarity"))


@_query
def vector_topk_filtered(spark, sf):
    vectors = _t(spark, sf, "embeddings")
    query = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.top_k(vectors, query, 3, F.col("label") == 1).select("query_id", "vec_id", "rank", F.round("similarity", 5).alias("similarity"))


@_query
def stale_files(spark, sf):
    """Orders as files, cached as of a fixed day."""
    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"))
    cache = orders.where("path % 3 > 0").select("path", F.to_timestamp(F.lit("1996-01-01")).alias("cached_mtime"))
    return files.stale_files(orders, cache).select("path")


@_query
def cache_stats(spark, sf):
    orders = _t(spark, sf, "orders").select((F.col("o_orderkey") * 1000).alias("size"), F.col("o_orderdate").alias("cached_mtime"))
    return files.cache_stats(orders).select("n_files", "mb", F.date_format("oldest", "yyyy-MM-dd").alias("oldest"), F.date_format("newest", "yyyy-MM-dd").alias("newest"))


@_query
def upserted(spark, sf):
    from docloom.streaming.incremental import upsert

    events = _t(spark, sf, "events").select("user_id", "event_id", "event_type")
    return upsert(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id"], "event_id")


@_query
def batch_totals(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("source").alias("source_file"), F.col("lang").alias("doc_index"), F.array().cast("array<struct<language:string,content:string>>").alias("code_blocks"), F.array().cast("array<string>").alias("tables"))
    return K.batch_summary(docs).select("files", "documents_processed", "total_sections")


@_query
def purged_cache(spark, sf):
    import datetime

    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("cached_mtime"))
    return files.purge_cache(orders, 30, datetime.datetime(1996, 3, 1)).select("path")


@_query
def fresh_answers(spark, sf):
    import datetime

    answers = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("question"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("source_version"))
    return files.fresh_answers(answers, datetime.datetime(1996, 3, 1), 240, "1-URGENT").select("question")


@_query
def sampling_ratio(spark, sf):
    tags = _tags(spark, sf)
    return P.sampling_ratio(P.hash_sample(tags, RATIO, "page_id"), tags).select("n_sampled", "n_processed", F.round("ratio", 6).alias("ratio"))


@_query
def class_text_stats(spark, sf):
    """Titles of pages as the text of each of their tags."""
    pages = _t(spark, sf, "pages").select("page_id", "html", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("text"))
    nodes = pages.select("text", F.explode(P.opening_tags(F.col("html"))).alias("raw")).select("text", F.array(F.lower(F.regexp_extract("raw", r"<([a-zA-Z0-9]+)", 1))).alias("classes"))
    return P.class_texts(nodes, 300).select("class", F.round("avg_length", 6).alias("avg_length"), "max_length", F.round("content_share", 6).alias("content_share"), "n")


@_query
def class_tags(spark, sf):
    """Sources of documents as classes, languages as tags."""
    nodes = _t(spark, sf, "documents").select(F.array("source").alias("classes"), F.col("lang").alias("tag"), "text", (F.col("doc_id") % 2 == 0).alias("has_children"))
    out = P.class_characteristics(nodes)
    return out.select("class", F.round("avg_text_length", 6).alias("avg_text_length"), F.round("children_share", 6).alias("children_share"), F.array_join("top_tags", ",").alias("top_tags"))


@_query
def languages_of_sources(spark, sf):
    return _t(spark, sf, "documents").groupBy("source").agg(F.array_join(T.distinct_languages(F.col("lang")), ",").alias("languages"))


@_query
def chunk_statistics(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    made = C.chunk_documents(docs.where("length(text) > 500"), "text", "paragraph_based", LINES).select(F.col("doc_id").alias("section_id"), "content")
    return K.chunk_statistics(made, docs.select(F.col("doc_id").alias("id"))).select("sections_processed", "sections_skipped", "chunks", "chars", F.round("avg_chars", 6).alias("avg_chars"))


@_query
def event_windows(spark, sf):
    """The batch form of the stream's counts."""
    from docloom.streaming.incremental import event_counts

    out = event_counts(_t(spark, sf, "events"))
    return out.select(F.date_format(F.col("window.start"), "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@_query
def event_sliding_windows(spark, sf):
    from docloom.streaming.incremental import event_counts

    out = event_counts(_t(spark, sf, "events"), "2 hours", slide="1 hour")
    return out.select(F.date_format(F.col("window.start"), "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@_query
def event_sessions(spark, sf):
    from docloom.streaming import incremental

    out = incremental.event_sessions(_t(spark, sf, "events"), "user_id", gap="1 hour")
    return out.select("user_id", F.date_format(F.col("session_window.start"), "yyyy-MM-dd HH:mm:ss").alias("began"), "n", F.round("total", 4).alias("total"))


@_query
def refreshed_cache(spark, sf):
    """Orders as files, some of them gone, cached as of a fixed day."""
    import datetime

    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"))
    cache = orders.where("path % 3 > 0").select("path", F.to_timestamp(F.lit("1996-01-01")).alias("cached_mtime"))
    out = files.refreshed_cache(orders.where("path % 7 > 0"), cache, datetime.datetime(1999, 1, 1))
    return out.select("path", F.date_format("cached_mtime", "yyyy-MM-dd").alias("day"), "refreshed")


@_query
def select_second_document(spark, sf):
    """Of pages that repeat themselves, document 1."""
    twice = _t(spark, sf, "pages").where("html ilike '<!DOCTYPE html%'").select("page_id", F.concat("html", F.lit("\n<!DOCTYPE html><p>"), F.col("page_id").cast("string"), F.lit("</p>")).alias("html"))
    return S.select_document(S.split_documents(twice), 1).select("page_id", "html")


@_query
def config_round_trip(spark, sf):
    """Presets as JSON files, read again."""
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # the driver writes and reads it, within this call
        rows = []
        for name, preset in conf.PRESETS.items():
            conf.save_config(preset, os.path.join(folder, name))
            back = conf.load_config(os.path.join(folder, name))
            rows.append((name, back.max_size, back.min_size, back.overlap, back.max_code, back.strategy))
    return spark.createDataFrame(rows, "preset string, max_size int, min_size int, overlap int, max_code int, strategy string")


@_query
def rendered_types(spark, sf):
    """Each part as an API type with fields, properties and methods; every third an enumeration."""
    k = F.col("p_partkey")
    response = F.to_json(F.struct(
        F.col("p_name").alias("type-name"), F.concat(F.lit("Shop."), F.col("p_brand")).alias("full-type-name"), F.when(k % 2 == 0, F.col("p_type")).alias("description"), F.when(k % 3 == 0, "System.Enum").alias("base-type-full-name"),
        F.array(F.struct(F.lit("f1").alias("field-name"), F.col("p_brand").alias("field-description")), F.struct(F.lit("f2").alias("field-name"), F.lit("").alias("field-description"))).alias("fields"),
        F.array(F.struct(F.lit("Size").alias("property-name"), F.lit(None).cast("string").alias("property-description"), F.lit("int").alias("property-short-type-name"))).alias("properties"),
        F.array(F.struct(F.lit("Get").alias("method-name"), F.lit("gets").alias("method-description"), F.when(k % 5 == 0, "bool").alias("method-return-short-type-name"))).alias("methods"),
    ))
    return PH.rendered(_t(spark, sf, "part").select("p_partkey", response.alias("response"))).select("p_partkey", "fragment")


@_query
def table_rows_for_export(spark, sf):
    tables = _tables(spark, sf).select("l_orderkey", F.array(F.struct("headers", "rows", "caption")).alias("tables"))
    made = tables.select("l_orderkey", F.lit("i").alias("id"), F.lit("t").alias("title"), F.lit(1).alias("level"), F.lit("c").alias("content"), F.lit("b").alias("breadcrumb"), F.array().cast("array<struct<language:string,content:string>>").alias("code_blocks"), "tables")
    cut = K.rag_rows(made, "l_orderkey", most_rows=3)
    return cut.select("l_orderkey", F.size(F.col("tables")[0]["rows"]).alias("n_rows"), F.array_join(F.flatten(F.col("tables")[0]["rows"]), "|").alias("cells"))


def entry_query(spark: SparkSession, sf: str) -> DataFrame:
    return paragraph_chunks_by_lang(spark, sf)
