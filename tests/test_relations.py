"""Hierarchies, intervals, samples, caches, tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docloom.conf import ChunkConfig
from docloom.operators import chunking as C
from docloom.operators import html as H
from docloom.operators import patterns as P
from docloom.operators import section_chunks as SC
from docloom.sources import files, sinks, tables
from docloom.streaming import incremental as I


def _chain(spark, n):
    """Two documents: a chain of n sections, and a section that is its own parent beside one whose parent is missing."""
    rows = [("a", f"s{i}", f"T{i}", f"s{i - 1}" if i else None) for i in range(n)] + [("b", "x", "X", "x"), ("b", "y", "Y", "gone"), ("b", "p", "P", "q"), ("b", "q", "Q", "p"), ("b", "n", None, None)]
    return spark.createDataFrame(rows, "doc string, id string, title string, parent_id string")


def test_paths_of_any_depth(spark):
    paths = {(r["doc"], r["id"]): r["path"] for r in H.with_paths(_chain(spark, 40), "doc").collect()}
    assert all(paths["a", f"s{i}"] == " > ".join(f"T{k}" for k in range(i + 1)) for i in range(40)) and len(paths) == 45
    assert paths["b", "x"] == "X" and paths["b", "y"] == "Y" and paths["b", "n"] == "" and paths["b", "p"] == "Q > P"
    assert H.with_paths(_chain(spark, 3).where("false"), "doc").count() == 0


def test_descendants_of_any_depth(spark):
    chain = _chain(spark, 12).where("doc = 'a'")
    assert {(r["ancestor"], r["id"], r["distance"]) for r in H.descendants(chain, "doc").collect()} == {(f"s{i}", f"s{k}", k - i) for k in range(12) for i in range(k)}
    assert H.descendants(chain, "doc", depth=2).agg(F.max("distance")).first()[0] == 2
    assert H.descendants(_chain(spark, 1).where("id in ('x', 'y')"), "doc").count() == 2


def test_tree_and_intervals(spark):
    chain = _chain(spark, 6).where("doc = 'a'")
    assert {r["id"]: r["depth"] for r in H.tree(chain, "doc", depth=3).collect()} == {f"s{i}": i for i in range(4)}
    nodes = H.html_nodes(spark.createDataFrame([(1, "<ul><li><b>x</b></li><li>y</li></ul><p>z</p>")], "page int, html string"))
    pairs = {(r["tag"], r["inner_tag"], r["inner_node"]) for r in H.within(nodes, nodes.select("page", "node", "tag"), "page").collect()}
    assert pairs == {("ul", "li", 1), ("ul", "b", 2), ("ul", "li", 3), ("li", "b", 2)}


def test_last_before_and_contents(spark):
    rows = spark.createDataFrame([("d", 0, "a"), ("d", 1, None), ("d", 2, "b"), ("d", 3, None), ("e", 0, None)], "doc string, pos int, crumb string")
    assert {(r["doc"], r["pos"]): r["last"] for r in rows.withColumn("last", H.last_before(rows, F.col("crumb"), "doc")).collect()} == {("d", 0): None, ("d", 1): "a", ("d", 2): "a", ("d", 3): "b", ("e", 0): None}


def test_samples_are_supersets_and_repeatable(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc"), (F.col("id") % 7).alias("node"))
    small, large = ({r["doc"] for r in P.hash_sample(rows.repartition(n), ratio, "doc", "node").collect()} for n, ratio in ((3, 0.1), (5, 0.3)))
    assert small < large and 140 < len(small) < 260 and 500 < len(large) < 700
    assert P.reservoir(rows.repartition(3), 50, "doc").collect() == P.reservoir(rows, 50, "doc").collect()
    assert P.sampling_ratio(rows.limit(500), rows).first()["ratio"] == 0.25 and P.sampling_ratio(rows.limit(0), rows.limit(0)).first()["ratio"] is None


def test_own_strategies(spark, monkeypatch):
    monkeypatch.setitem(C.STRATEGIES, "halves", lambda text, config, header, mode: F.array(F.struct(F.substring(text, 1, 2).alias("content"), F.lit(0).alias("start"), F.lit(2).alias("end"))))
    made = C.chunk_documents(spark.createDataFrame([(1, "abcd"), (2, "")], "doc int, text string"), kind="halves")
    assert [(r["doc"], r["content"]) for r in made.collect()] == [(1, "ab")]
    with pytest.raises(ValueError, match="halves"):
        C.chunk_array(F.col("text"), "none", ChunkConfig())


def test_section_strategies_have_no_shuffle(spark):
    one = spark.createDataFrame([(1, "i", "t", 1, "", "Some text.", [], [])], "doc int, id string, title string, level int, breadcrumb string, content string, code_blocks array<struct<language:string,content:string>>, tables array<struct<headers:array<string>,rows:array<array<string>>,caption:string>>")
    made = SC.chunk_sections(one, "section_based", "doc")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString() and made.first()["content"] == "[Section i: t]\n\nSome text."
    with pytest.raises(ValueError, match="pos"):
        SC.chunk_sections(one, "hybrid", "doc")
    assert SC.analyses(one, "doc").first()["content_type"] == "pure_text"


def test_cache_refresh(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    originals = spark.createDataFrame([("a", t(2)), ("b", t(5)), ("c", t(2))], "path string, mtime timestamp")
    cache = spark.createDataFrame([("a", t(3)), ("b", t(3)), ("gone", t(3))], "path string, cached_mtime timestamp")
    assert {(r["path"], r["refreshed"]) for r in files.refreshed_cache(originals, cache, t(9)).collect()} == {("a", False), ("b", True), ("c", True)}
    assert {r["refreshed"] for r in files.refreshed_cache(originals, cache, t(9), force_refresh=True).collect()} == {True}


def test_parsed_files_are_read_again(spark, tmp_path):
    pages = spark.createDataFrame([("f.html", 0, '<body><section id="1"><h1>A</h1></section><p>Some words of text.</p><pre>x = 1</pre></body>')], "source_file string, doc_index int, html string")
    made = sinks.parsed_files(H.with_parents(H.sections(pages), "source_file", "doc_index"))
    sinks.write_json(made, str(tmp_path / "lines"))
    made.coalesce(1).write.option("lineSep", "\n").json(str(tmp_path / "one"))
    for path, lines in ((tmp_path / "lines", True), (tmp_path / "one", False)):
        (row,) = files.read_parsed(spark, str(path), lines).collect()
        assert (row["id"], row["content"], row["source_file"]) == ("1", "Some words of text. [Code Example]", "f.html")
    assert made.select("statistics.total_code_blocks").first()[0] == 1


def test_small_tables_are_dealt_out(spark, tmp_path):
    spark.range(40_000).selectExpr("id", "md5(cast(id as string)) text").coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(40_000).selectExpr("id", "md5(cast(id as string)) text").repartition(9).write.parquet(str(tmp_path / "many"))
    cores = spark.sparkContext.defaultParallelism
    one, many = (tables.read_table(spark, str(tmp_path / x)) for x in ("one", "many"))
    counts = [r["count"] for r in one.groupBy(F.spark_partition_id()).count().collect()]
    assert one.count() == 40_000 and len(counts) == cores and max(counts) < 2 * min(counts)
    assert "Exchange" in one._jdf.queryExecution().executedPlan().toString() and "Exchange" not in many._jdf.queryExecution().executedPlan().toString()


def test_sessions_and_sliding_windows(spark):
    t = lambda h, m: dt.datetime(2025, 1, 1, h, m)
    events = spark.createDataFrame([(1, t(1, 0), "a", 1.0), (1, t(1, 20), "a", 2.0), (1, t(3, 0), "a", 4.0), (2, t(1, 10), "b", 8.0)], "user int, ts timestamp, event_type string, value double")
    assert sorted((r["user"], r["n"], r["total"]) for r in I.event_sessions(events, "user").collect()) == [(1, 1, 4.0), (1, 2, 3.0), (2, 1, 8.0)]
    assert I.event_counts(events, "2 hours", slide="1 hour").agg(F.sum("n")).first()[0] == 8


def test_passes_agree_with_joins(spark):
    """What a document's pass makes of its own sections and nodes is what joins make of them as relations, and neither is broadcast."""
    some = lambda *ids: "".join(f'<section id="{i}"><h2>T{n} {i}</h2></section><p>Text of section {i}, no {n}.</p><p class="page-breadcrumb">b</p>' for n, i in enumerate(ids))
    contents = '<h3>Table of Contents</h3><nav><ul><li><a class="toc-h1" href="#1">1 First</a></li><li><a class="toc-h1" href="#1">1 Again</a></li><li><a href="#x.y">x</a></li></ul></nav>'
    pages = spark.createDataFrame([(1, contents + some("1", "1.1", "1.1.1", "1", "2.1", "2.1.4")), (2, some("x.y", "x", "1..2", "1.", "1.1", ".")), (3, None), (4, "<h1>no sections</h1><p>here</p>")], "k int, html string")
    found = H.sections(pages)
    tree = H.with_parents(found, "k")
    rows = lambda df, *columns: sorted(df.select(*columns).collect(), key=str)
    assert rows(H.section_trees(pages), "k", "pos", "id", "parent_id", "path") == rows(H.with_paths(tree, "k"), "k", "pos", "id", "parent_id", "path")
    for depth in (0, 1, 2):
        assert rows(H.section_trees(pages, depth=depth), "k", "pos", "id", "depth") == rows(H.tree(tree, "k", depth=depth), "k", "pos", "id", "depth")
    joined = H.with_contents(found, H.table_of_contents(pages).dropDuplicates(["k", "id"]), "k")
    assert {(r["k"], r["pos"], r["toc_level"]) for r in joined.collect()} == {(r["k"], r["pos"], r["toc_level"]) for r in H.sections_with_contents(pages).collect()}
    assert {r["toc_title"] for r in H.sections_with_contents(pages).where("id = '1'").collect()} == {"First"}
    nodes = H.html_nodes(pages)
    pairs = H.within(nodes.where("tag in ('nav', 'ul', 'body')"), nodes, "k")
    assert rows(H.nodes_within(pages, "nav", "ul", "body"), "k", "node", "tag", "inner_node", "inner_tag") == rows(pairs, "k", "node", "tag", "inner_node", "inner_tag")
    for df in (pairs, tree, H.with_children(tree, "k"), H.siblings(tree, "k"), joined, H.tree(tree, "k", depth=1)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()
    assert H.sections(pages, columns=("id", "pos")).columns == ["k", "id", "pos"] and rows(H.sections(pages, columns=("id", "pos")), "k", "id", "pos") == rows(found, "k", "id", "pos")
    assert rows(H.html_nodes(pages, columns=("depth",)), "k", "depth") == rows(nodes, "k", "depth")
