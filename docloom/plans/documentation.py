"""Queries over documentation pages that are built from the driver's parts: contents, numbered sections, breadcrumbs, code, tables, marked blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import conf
from docloom.functions import text as T
from docloom.operators import html as H
from docloom.operators import patterns as P
from docloom.operators import section_chunks as SC
from docloom.operators.lineage import cut, scratch
from docloom.sources import files
from docloom.sources import html as S
from docloom.sources import sinks as K
from docloom.sources.tables import read_table

ENDS = conf.ChunkConfig(max_size=1000, min_size=100, overlap=200, header=False)
_NAMES = ("p_partkey", "p_name", "p_brand", "p_type", "p_size")


def _filled(template: str) -> Column:
    """template with {k}, {n}, {b}, {t} and {z} taken from a part."""
    parts, rest = [], template
    columns = dict(zip("knbtz", _NAMES))
    while rest:
        text, brace, rest = rest.partition("{")
        parts.append(F.lit(text))
        if brace:
            name, _, rest = rest.partition("}")
            parts.append(F.col(columns[name]).cast("string"))
    return F.concat(*parts)


_HEAD = (
    '<!DOCTYPE html><html><head><style>p{k}</style></head><body><nav class="site"><a href="/">Home</a></nav><h3>Table of Contents</h3><nav><ul>'
    '<li><a class="toc-h1" href="#1">1 {n}</a></li><li><a class="toc-h2" href="#1.1">1.1 Price of {n}</a></li><li><a class="toc-h2" href="#1.2">1.2 Code</a></li>'
    '<li><a class="toc-h3" href="#1.2.1">1.2.1 API</a></li></ul></nav>'
    '<p class="page-breadcrumb">Parts / {t}</p><div class="page-heading"><section id="1"><h1>The {n}</h1></section></div>'
    "<p>The <b>{n}</b> of {b}\n  has size {z}.</p><h3>Notes on {t}</h3><ul><li>first note </li><li>note {z}</li></ul><p>short</p><script>var x = {k};</script>"
    '<p style="page-break-after: always">never seen at all</p>'
)
_PRICE = (
    '<p class="page-breadcrumb">Parts / {t} / Price</p><section id="1.1"><h2>Price of {n}</h2></section>'
    '<p>Call <code class="python">price({k})</code> or <code>{b}</code> now.</p>'
    "<table><caption>Prices {k}</caption><thead><tr><th>Brand</th><th>Price</th></tr></thead><tbody><tr><td>{b}</td><td>{z}</td></tr><tr><td>all</td><td> {k} </td></tr></tbody></table>"
    "<table><tr><th>Size</th></tr><tr><td>{z}</td></tr></table>"
    '<div class="box"><div class="error-messages">Do not sell {n}</div></div><div class="box"><div class="tutorial-step"><p>First {k}</p><p>then {z}</p></div></div>'
    '<div><div class="example-fieldset"><div class="example-legend">Examples</div><a class="example-algorithm-link" href="/x/{b}.py">x<span class="badge-py">Py</span></a></div></div>'
)
_CODE = (
    '<p class="page-breadcrumb">Parts / {t} / Code</p><section id="1.2"></section>'
    '<div class="section-example-container"><pre class="csharp">var p = {k};</pre><pre class="python">p = {k}</pre></div>'
    '<div class="plain"><pre>not an example {k}</pre></div><pre>import numpy as np\ndef f(self):\n    return {k}</pre><pre>pip install {n}</pre><pre> </pre>'
)
_API = (
    '<p class="page-breadcrumb">API</p><section id="1.2.1"><h2>API of {b}</h2></section><div data-tree="{b}"><div class="base-expandable-type"><div class="python"><div class="inner-tree-container"><h4>{b}</h4><p>A brand of size {z}.</p>'
    '<div class="code-snippet">get({k})</div></div></div><div class="csharp"><div class="inner-tree-container"><h4>{b}CS</h4></div></div></div></div>'
)
_EMPTY = '<p class="page-breadcrumb">Nothing</p><section id="2"><h2>Nothing {k}</h2></section>'


def pages(part: DataFrame) -> DataFrame:
    """p_partkey and html; every third page has an empty section."""
    html = F.concat(_filled(_HEAD), _filled(_PRICE), _filled(_CODE), _filled(_API), F.when(F.col("p_partkey") % 3 == 0, _filled(_EMPTY)).otherwise(F.lit("")), F.lit("</body></html>"))
    return part.select("p_partkey", html.alias("html"))


def heading_pages(part: DataFrame) -> DataFrame:
    """Pages without numbered sections: headings with an id and without."""
    html = _filled(
        '<html><body><h1 id="top{k}">Part {k}</h1><p>The {n}.</p><p>More on {b}.</p><h2>Type <i>{t}</i></h2><ul><li>one</li><li>{z}</li></ul><pre class="python">p = {k}</pre>'
        '<div><h3>Deep</h3><p>Below.</p></div><h2>Table of Contents</h2><p>none</p><h4>Last &amp; least</h4><ol><li>end {z}</li></ol></body></html>'
    )
    return part.select("p_partkey", html.alias("html"))




def nested_pages(part: DataFrame) -> DataFrame:
    """A section followed by a document within the document."""
    html = _filled(
        '<html><body><section id="1"><h1>A {n}</h1></section><html><body>bare {n}<pre>x = {k}</pre><table><tr><th>h</th></tr><tr><td>{z}</td></tr></table>'
        '<div class="error-messages">bad {b}</div><p>A paragraph of {b}.</p></body></html></body></html>'
    )
    return part.select("p_partkey", html.alias("html"))


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, f"{sf}/part.parquet")


def _sections(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return H.sections(pages(_part(spark, sf)), columns=columns)


def _trees(spark: SparkSession, sf: str, *columns: str, depth: int | None = None) -> DataFrame:
    return H.section_trees(pages(_part(spark, sf)), columns=columns, depth=depth)


def doc_contents(spark, sf):
    return H.table_of_contents(pages(_part(spark, sf))).select("p_partkey", "id", "title", "level", "href", "full_text")


def page_sections(spark, sf):
    columns = ("pos", "id", "title", "level", "section_number", "breadcrumb", "content")
    return _sections(spark, sf, *columns).select("p_partkey", *columns)


def heading_titles(spark, sf):
    found = H.sections(heading_pages(_part(spark, sf)))
    return found.select("p_partkey", "pos", "id", "title", "level", "content", F.size("code_blocks").alias("n_code"))


def _elements(found: DataFrame) -> DataFrame:
    return H.elements(found, "p_partkey").select("p_partkey", "id", "pos", "type", "content", F.col("order").alias("ord"), "language", "title", "context")


def doc_elements(spark, sf):
    return _elements(_sections(spark, sf, "id", "mixed"))


def nested_body_elements(spark, sf):
    return _elements(H.sections(nested_pages(_part(spark, sf)), columns=("id", "mixed")))


def nested_body_sections(spark, sf):
    return H.sections(nested_pages(_part(spark, sf))).select("p_partkey", "id", "content", F.size("tables").alias("n_tables"))


def doc_code(spark, sf):
    return _sections(spark, sf, "id", "code_blocks").select("p_partkey", "id", F.posexplode("code_blocks").alias("place", "b")).select("p_partkey", "id", "place", "b.language", "b.content")


def doc_tables(spark, sf):
    each = _sections(spark, sf, "id", "tables").select("p_partkey", "id", F.posexplode("tables").alias("place", "t"))
    rows = F.array_join(F.transform("t.rows", lambda r: F.array_join(r, "|")), ";")
    return each.select("p_partkey", "id", "place", F.array_join("t.headers", "|").alias("headers"), rows.alias("cells"), F.col("t.caption").alias("caption"))


def class_depth_stats(spark, sf):
    out = P.class_depths(H.html_nodes(pages(_part(spark, sf)), columns=("depth", "classes")))
    return out.select("class", F.round("avg_depth", 6).alias("avg_depth"), "min_depth", "max_depth", "n")


def nodes_within(spark, sf):
    return H.nodes_within(pages(_part(spark, sf)), "nav", "ul", "table").groupBy("tag").agg(F.count("*").alias("n"))


def sections_with_language(spark, sf):
    return H.sections_with_code(_sections(spark, sf, "id", "code_blocks"), "csharp").select("p_partkey", "id")


def point_lookup(spark, sf):
    """The part is looked up before its page is parsed: a filter isn't pushed through the parser."""
    found = H.sections(pages(_part(spark, sf).where("p_partkey = 7")), columns=("pos", "id", "title"))
    return H.find_section(found, "1.1").select("p_partkey", "id", "title")


def tree_to_depth(spark, sf):
    """Roots and two levels below."""
    return _trees(spark, sf, "id", "depth", "parent_id", depth=1).select("p_partkey", "id", "depth", "parent_id")


def contents_joined(spark, sf):
    """Sections beside their entries in the table of contents; those without one keep nulls."""
    columns = ("id", "toc_title", "toc_level")
    return H.sections_with_contents(pages(_part(spark, sf)), columns=columns).select("p_partkey", *columns)


def api_texts(spark, sf):
    made = _part(spark, sf).select("p_partkey", F.col("p_brand").alias("value"), _filled('<h4>{b}</h4><p>Size {z}.</p><div class="code-snippet">get({k})</div><div class="x">not</div>').alias("html"))
    return H.api_plain_texts(made).select("p_partkey", "text")


def config_of_sections(spark, sf):
    found = _sections(spark, sf, "id", "title", "code_blocks")
    language, some = F.element_at("code_blocks", 1)["language"], F.size("code_blocks") > 0
    return found.select("p_partkey", "id", T.config_for_title(F.col("title"), F.when(some, language), some).alias("preset"))


def rag_rows_v1(spark, sf):
    found = _trees(spark, sf, "id", "title", "level", "path", "content", "code_blocks", "tables", "parent_id", "breadcrumb", "section_number")
    out = K.rag_rows_v1(found, "p_partkey")
    return out.select("p_partkey", "id", "path", "has_code", "has_tables", F.array_join("code_languages", ",").alias("languages"), F.array_join(F.array_sort(F.map_keys("code")), ",").alias("code_keys"), F.element_at("table", F.lit("table_0")).alias("table_0"), "parent_id")


def section_statistics(spark, sf):
    out = K.section_statistics(_sections(spark, sf, "code_blocks", "tables", "mixed"), "p_partkey")
    return out.select("p_partkey", "total_sections", "total_code_blocks", "total_tables", "total_mixed_elements", F.array_join("languages", ",").alias("languages"))


def parsed_round_trip(spark, sf):
    """Sections as JSON files, a document a row, read again; content is derived from the mixed elements."""
    found = _trees(spark, sf).withColumn("doc_index", F.lit(0))
    path = scratch(spark, "parsed")
    K.write_json(K.parsed_files(found, "p_partkey"), path)
    back = files.read_parsed(spark, path, lines=True)
    return back.select(F.col("source_file").cast("bigint").alias("p_partkey"), "pos", "id", "title", "level", "breadcrumb", "parent_id", "content", F.size("code_blocks").alias("n_code"), F.size("tables").alias("n_tables"))


def parsed_statistics(spark, sf):
    found = _trees(spark, sf).withColumn("doc_index", F.lit(0))
    out = K.parsed_files(found, "p_partkey").select(F.col("source_file").cast("bigint").alias("p_partkey"), F.size("sections").alias("n_sections"), "statistics.*")
    return out.withColumn("languages", F.array_join("languages", ","))


def html_files(spark, sf):
    """Pages of some parts as files of two directories, one file a part, scanned by glob and recursion."""
    path = scratch(spark, "html")
    made = pages(_part(spark, sf).where("p_partkey < 24")).withColumn("k", F.col("p_partkey"))
    made.select(F.col("p_partkey") % 2, F.col("k"), "html").toDF("half", "k", "html").repartition(4, "k").write.partitionBy("half", "k").text(path)
    (spark.range(1).selectExpr("'no page' value").coalesce(1).write.mode("append").text(f"{path}/half=0"))
    found = S.read_html(spark, f"{path}/half=*", "*.txt", recursive=True).where("html like '<!DOCTYPE%'")
    return found.select(F.regexp_extract("source_file", r"/k=(\d+)/", 1).cast("bigint").alias("p_partkey"), F.md5(F.regexp_replace("html", r"\n$", "").cast("binary")).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_contents, page_sections, heading_titles, doc_elements, nested_body_elements, nested_body_sections, doc_code, doc_tables, class_depth_stats, nodes_within, sections_with_language,
        point_lookup, tree_to_depth, contents_joined, api_texts, config_of_sections, rag_rows_v1, section_statistics,
        parsed_round_trip, parsed_statistics, html_files,
    )
}


def _nodes(spark, sf, *columns):
    return H.html_nodes(pages(_part(spark, sf)), columns=columns).withColumnRenamed("p_partkey", "doc")


def snapshot_counts(spark, sf):
    """The commonest classes, attributes and ids of the nodes' snapshot."""
    made = P.snapshot(_nodes(spark, sf, "node", "depth", "tag", "classes", "attrs", "text"))
    return made["classes"].unionByName(made["attributes"]).unionByName(made["ids"])


def adaptive_coverage(spark, sf):
    """A whole sample: what is missing are the ids, which the scan doesn't look for."""
    _, measured, ratio = P.adaptive_discovery(_nodes(spark, sf, "node", "tag", "classes", "attrs"), target=0.85, ratio=1.0)
    return measured.select(F.round("overall_coverage", 6).alias("coverage"), "n_baseline", "n_found", F.lit(float(ratio)).alias("last_ratio"))


QUERIES |= {f.__name__: f for f in (snapshot_counts, adaptive_coverage)}


# --- chunks of sections ---

_BLOCK = "struct<language:string,content:string>"
#: A fenced block without units: nine lines and an empty one, over and over.
_FENCED = "y = 1234567890\n" * 9 + "\n"


def chunk_sections(docs: DataFrame) -> DataFrame:
    """Documents as sections, some with small code and tables."""
    k, none = F.col("doc_id"), F.array()
    block = lambda language, content: F.array(F.struct(F.lit(language).alias("language"), content.alias("content")))
    python = F.when(k % 3 == 0, block("python", F.concat(F.lit("x = "), k.cast("string")))).otherwise(none.cast(f"array<{_BLOCK}>"))
    csharp = F.when(k % 6 == 0, block("csharp", F.lit("y();"))).otherwise(none.cast(f"array<{_BLOCK}>"))
    table = F.struct(F.array(F.lit("a"), F.lit("b")).alias("headers"), F.array(F.array("lang", "source")).alias("rows"), F.when(k % 8 == 0, "Cap").alias("caption"))
    return docs.select(
        "doc_id", F.concat(F.lit("s"), k.cast("string")).alias("id"), F.col("lang").alias("title"), F.lit(2).alias("level"), F.col("source").alias("breadcrumb"), F.col("text").alias("content"),
        F.concat(python, csharp).alias("code_blocks"), F.when(k % 4 == 0, F.array(table)).otherwise(F.array().cast("array<struct<headers:array<string>,rows:array<array<string>>,caption:string>>")).alias("tables"),
    )


def code_sections(docs: DataFrame) -> DataFrame:
    """Documents of which the heads surround a fenced block; some have large code, by doc_id % 5: 0 none, 1 functions, 2 classes, 3 fenced lines, 4 a fenced script."""
    k = F.col("doc_id")
    fenced = F.when(k % 5 == 3, F.concat(F.lit("```python\n"), F.expr(f"left(repeat('{_FENCED}', 20), {20 * len(_FENCED) - 1})"), F.lit("\n```"))).when(
        k % 5 == 4, F.concat(F.lit("```bash\n"), F.expr("left(repeat('echo twenty letters.\n', 200), 4199)"), F.lit("\n```"))
    ).otherwise(F.lit("```python\nprint(1)\n```"))
    content = F.concat(F.lit("Before "), k.cast("string"), F.lit(".\n"), fenced, F.lit("\nAfter."))
    functions = F.expr("left(repeat('def f():\n    return \"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa\"\n', 100), 5399)")
    classes = F.expr("left(repeat('public class C {\n    int x;\n}\n', 200), 6199)")
    large = F.when(k % 5 == 1, F.array(F.struct(F.lit("python").alias("language"), functions.alias("content")))).when(k % 5 == 2, F.array(F.struct(F.lit("csharp").alias("language"), classes.alias("content")))).otherwise(F.array().cast(f"array<{_BLOCK}>"))
    small = F.when(k % 2 == 0, F.array(F.struct(F.lit("csharp").alias("language"), F.concat(F.lit("z = "), k.cast("string")).alias("content")))).otherwise(F.array().cast(f"array<{_BLOCK}>"))
    return docs.select("doc_id", F.concat(F.lit("c"), k.cast("string")).alias("id"), F.lit("T").alias("title"), F.lit(1).alias("level"), F.lit("").alias("breadcrumb"), content.alias("content"), F.concat(large, small).alias("code_blocks"), F.array().cast("array<struct<headers:array<string>,rows:array<array<string>>,caption:string>>").alias("tables"))


def _documents(spark, sf):
    return read_table(spark, f"{sf}/documents.parquet", heavy=True)


def _chunk_rows(made: DataFrame, key: str) -> DataFrame:
    return made.select(key, "section_id", "chunk_index", "total_chunks", "chunk_type", "strategy", "language", "has_code", "has_table", "start_char", "end_char", F.length("content").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("digest"))


def section_based_section_chunks(spark, sf):
    return _chunk_rows(SC.chunk_sections(chunk_sections(_documents(spark, sf)), "section_based", "doc_id", config=ENDS), "doc_id")


def code_aware_section_chunks(spark, sf):
    return _chunk_rows(SC.chunk_sections(code_sections(_documents(spark, sf)), "code_aware", "doc_id", config=conf.ChunkConfig(header=False)), "doc_id")


def section_chunk_quality(spark, sf):
    """Mean quality of the chunks of each document's section."""
    made = SC.chunk_sections(chunk_sections(_documents(spark, sf)), "section_based", "doc_id", config=ENDS)
    return made.groupBy("doc_id").agg(F.round(F.avg("quality_score"), 6).alias("quality"))


def tree_sections(part: DataFrame) -> DataFrame:
    """Each part as a document: a parent with children, a small leaf, a large section with small children, a medium leaf."""
    paragraph = lambda c: "repeat('" + c + "', 900)"
    large = F.expr(f"concat_ws('\n\n', {paragraph('a')}, {paragraph('b')}, {paragraph('c')})")
    none, no_tables = F.array().cast(f"array<{_BLOCK}>"), F.array().cast("array<struct<headers:array<string>,rows:array<array<string>>,caption:string>>")
    code = F.array(F.struct(F.lit("python").alias("language"), _filled("p = {k}").alias("content")))
    table = F.array(F.struct(F.array(F.lit("h"), F.lit("i")).alias("headers"), F.array(F.array(F.col("p_brand"))).alias("rows"), F.lit(None).cast("string").alias("caption")))
    rows = (
        ("1", "Parent", None, _filled("About {n}."), none, no_tables),
        ("1.1", "First child", "1", _filled("Child of {b}."), code, no_tables),
        ("1.2", "Second child", "1", F.lit(""), none, table),
        ("2", "Small {n}", None, _filled("Small {t}."), none, no_tables),
        ("3", "Large", None, large, code, table),
        ("3.1", "One", "3", _filled("One {k}."), none, no_tables),
        ("3.2", "Two", "3", _filled("Two {z}."), code, no_tables),
        ("3.3", "Wide", "3", F.expr("repeat('w', 790)"), none, no_tables),
        ("3.4", "Rest", "3", F.expr("repeat('r', 790)"), none, no_tables),
        ("4", "Medium", None, F.expr("repeat('m', 1500)"), none, no_tables),
    )
    made = F.array(*[
        F.struct(F.lit(i).alias("id"), _filled(title).alias("title"), F.lit(i.count(".") + 1).alias("level"), F.lit("").alias("breadcrumb"), content.alias("content"), blocks.alias("code_blocks"), tables.alias("tables"), F.lit(up).cast("string").alias("parent_id"))
        for i, title, up, content, blocks, tables in rows
    ])
    return part.select("p_partkey", F.posexplode(made).alias("pos", "s")).select("p_partkey", "pos", "s.*")


def hierarchical_section_chunks(spark, sf):
    return _chunk_rows(SC.chunk_sections(tree_sections(_part(spark, sf)), "hierarchical", "p_partkey", config=conf.ChunkConfig()), "p_partkey")


def _analysed(spark, sf):
    """Documents' heads with growing code and tables."""
    k = F.col("doc_id")
    code = F.when(k % 4 == 0, F.array().cast(f"array<{_BLOCK}>")).otherwise(F.array(F.struct(F.when(k % 2 == 0, "python").otherwise("cli").alias("language"), F.expr("repeat('z = f(1)\n', cast(doc_id % 4 * 12 as int))").alias("content"))))
    table = F.struct(F.array(F.lit("h")).alias("headers"), F.array_repeat(F.array(F.lit("some cell"), F.col("lang")), (k % 3 * 9).cast("int")).alias("rows"), F.when(k % 2 == 0, "c").alias("caption"))
    return _documents(spark, sf).select(
        "doc_id", F.concat(F.lit("a"), k.cast("string")).alias("id"), F.col("lang").alias("title"), (1 + k % 4).cast("int").alias("level"), F.col("source").alias("breadcrumb"), F.when(k % 97 > 0, F.substring("text", 1, 600)).otherwise(F.lit("")).alias("content"), code.alias("code_blocks"),
        F.when(k % 3 > 0, F.array(table)).otherwise(F.array().cast("array<struct<headers:array<string>,rows:array<array<string>>,caption:string>>")).alias("tables"),
    )


def section_analysis(spark, sf):
    out = SC.analyses(_analysed(spark, sf), "doc_id")
    numbers = [F.round(c, 6).alias(c) for c in ("text_ratio", "code_ratio", "table_ratio", "complexity", "readability", "density", "confidence")]
    return out.select("doc_id", "content_type", "strategy", F.array_join("languages", ",").alias("languages"), *numbers)


def analysis_votes(spark, sf):
    return SC.strategy_votes(SC.analyses(_analysed(spark, sf), "doc_id").withColumn("lang", F.col("doc_id") % 7), "lang").select("lang", "strategy", "votes", F.round("weight", 4).alias("weight"))


def _hybrid_sections(part: DataFrame) -> DataFrame:
    """One section a part, by p_partkey % 4: text alone (every second of them too poor for any strategy), text with much code, a table alone, nothing."""
    k = F.col("p_partkey")
    text = _filled("The {n} of {b} is here. It has a size of {z} and that is all there is to say about it, more or less; the {n} is a {t} one. Nobody knows why it is so, and nobody has asked.")
    code = F.array(F.struct(F.lit("csharp").alias("language"), F.concat(F.lit("var x = 1;\nvar y = "), k.cast("string"), F.lit(";\nreturn new Thing(" + "x, y, " * 30 + "x);")).alias("content")))
    table = F.array(F.struct(F.array(F.lit("brand"), F.lit("size")).alias("headers"), F.array(F.array("p_brand", F.col("p_size").cast("string"))).alias("rows"), F.lit("Sizes").alias("caption")))
    return part.select(
        "p_partkey", F.lit(0).alias("pos"), F.lit("h").alias("id"), F.col("p_name").alias("title"), F.lit(1).alias("level"), F.lit("").alias("breadcrumb"), F.when(k % 8 == 4, _filled("a b c d e f g h i j k l {z}")).when(k % 4 < 2, text).otherwise(F.lit("")).alias("content"),
        F.when(k % 4 == 1, code).otherwise(F.array().cast(f"array<{_BLOCK}>")).alias("code_blocks"), F.when(k % 4 == 2, table).otherwise(F.array().cast("array<struct<headers:array<string>,rows:array<array<string>>,caption:string>>")).alias("tables"),
    )


def hybrid_section_chunks(spark, sf):
    return _chunk_rows(SC.chunk_sections(_hybrid_sections(_part(spark, sf)), "hybrid", "p_partkey", config=conf.ChunkConfig()), "p_partkey")


QUERIES |= {f.__name__: f for f in (section_based_section_chunks, code_aware_section_chunks, section_chunk_quality, hierarchical_section_chunks, section_analysis, analysis_votes, hybrid_section_chunks)}
