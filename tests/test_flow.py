import datetime as dt
import importlib
import json
import sys

from docloom.operators import html as H
from docloom.operators import patterns as P
from docloom.operators import placeholders as PH
from docloom.operators import retrieval as R
from docloom.sources import files, sinks
from docloom.streaming import incremental as I

PAGE = '<!DOCTYPE html><html><body><h1 id="a">T</h1><p>text of some length here</p></body></html>'


def test_new_files_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text(PAGE)
    run = lambda: I.process_new(I.html_stream(spark, str(tmp_path / "in")), lambda df: H.sections(df.select("source_file", "html")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    (tmp_path / "in" / "b.html").write_text(PAGE)
    run()
    assert spark.read.parquet(str(tmp_path / "out")).select("source_file").distinct().count() == 2


def test_cache_rules(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    originals = spark.createDataFrame([("a", t(2)), ("b", t(2)), ("c", t(2))], "path string, mtime timestamp")
    cache = spark.createDataFrame([("a", t(3), 10), ("b", t(2), 20)], "path string, cached_mtime timestamp, size bigint")
    assert {r["path"] for r in files.stale_files(originals, cache).collect()} == {"b", "c"}
    assert files.purge_cache(cache, 7, t(10)).count() == 1 and files.cache_stats(cache).first()["n_files"] == 2
    answers = spark.createDataFrame([("q", t(9), "v1"), ("r", t(1), "v1")], "question string, created_at timestamp, source_version string")
    assert files.fresh_answers(answers, t(9)).count() == 1 and files.fresh_answers(answers, t(9), source_version="v2").count() == 0


def test_upsert(spark):
    old, new = (spark.createDataFrame(rows, "k int, v string, n int") for rows in ([(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (3, "d", 2)]))
    assert {(r["k"], r["v"]) for r in I.upsert(old, new, ["k"], "n").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_placeholders(spark):
    response = json.dumps({"type-name": "T", "full-type-name": "Lib.T", "base-type-full-name": "System.Enum", "fields": [{"field-name": "X", "field-description": "ex"}, {"field-name": "Y"}], "methods": [{"method-name": "Go", "method-return-short-type-name": "int"}]})
    types = PH.rendered(spark.createDataFrame([("Lib.T", "python", response), ("Lib.N", "python", "{}")], "name string, language string, response string"))
    fragment = {r["name"]: r["fragment"] for r in types.collect()}
    assert fragment["Lib.N"] is None and "<h4>T Enumeration</h4>" in fragment["Lib.T"] and ">enum</span> <code>Lib.T" in fragment["Lib.T"] and "<code>X</code>" in fragment["Lib.T"] and "<code>Y</code>" not in fragment["Lib.T"] and "Returns:" in fragment["Lib.T"]
    pages = spark.createDataFrame([(1, '<div data-tree="Lib.T">a</div><p/><div data-tree="Lib.N">b</div>'), (2, "none"), (3, None)], "k int, html string")
    done = PH.patch(pages, types, "k")
    by = {r["k"]: r for r in done.collect()}
    assert (by[1]["n_found"], by[1]["n_patched"], by[1]["status"], by[2]["status"]) == (2, 1, "partial", "no_data_trees") and by[1]["html"].count('class="python"') == 1
    again = PH.patch(done.select("k", "html"), types, "k")
    assert again.where("k = 1").first()["html"] == by[1]["html"]
    assert H.api_plain_text("<h4>A</h4><p>b</p><div class='code-snippet'>c</div>", "v") == "[API Reference: v]\n\nA\nb\n- c"
    rows = H.sections(spark.createDataFrame([(1, '<div class="page-heading"><section id="1"></section></div>' + by[1]["html"])], "k int, html string")).first()
    assert [e["title"] for e in rows["mixed"] if e["type"] == "api_content"] == ["API: Lib.T", "API: Lib.T (C#)"]


def test_discovery(spark):
    pages = spark.createDataFrame([(i, '<div class="code a"><p class="b">text of the page</p></div>' + ('<i class="rare">x</i>' if i == 3 else "")) for i in range(30)], "doc int, html string")
    nodes = H.html_nodes(pages)
    found, measured, ratio = P.adaptive_discovery(nodes, ratio=0.2)
    assert measured.first()["overall_coverage"] > 0.95 and ratio <= 0.45
    snap = P.snapshot(nodes, ratio=0.5)
    assert snap["classes"].first()["frequency"] == 30 and snap["depths"].count() == 3 and 0 < snap["sample"].count() < nodes.count()
    assert {r["class"]: r["top_tags"] for r in P.class_characteristics(nodes).collect()}["b"] == ["p"] and P.class_texts(nodes).count() == 3
    again = P.snapshot(nodes.repartition(5), ratio=0.5)["sample"]
    assert {tuple(r[:2]) for r in again.select("doc", "node").collect()} == {tuple(r[:2]) for r in snap["sample"].select("doc", "node").collect()}


def test_exports(spark, tmp_path):
    df = H.with_paths(H.with_parents(H.sections(spark.createDataFrame([("f", 0, PAGE)], "source_file string, doc_index int, html string")), "source_file"), "source_file")
    assert sinks.batch_summary(df).first()["total_sections"] == 1 and sinks.section_statistics(df).first()["total_sections"] == 1
    assert sinks.rag_rows(df, "source_file").first()["content"] == "text of some length here" and sinks.rag_rows_v1(df).first()["path"] == "T"
    parsed = {"source_file": "f", "document_index": 1, "sections": [{"id": "1", "title": "T", "level": 1, "mixed_content": [{"type": "text", "content": "hello", "order": 1}, {"type": "code", "content": " x ", "language": "python", "title": "Code", "order": 2}], "tables": []}]}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a_parsed.json").write_text(json.dumps(parsed))
    row = files.read_parsed(spark, str(tmp_path / "p")).first()
    assert row["content"] == "hello [Code]" and row["code_blocks"][0]["content"] == "x"
    sinks.write_json(df, str(tmp_path / "out"), "source_file")
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert files.file_index(spark, str(tmp_path / "p")).count() == 1


def test_top_k(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 1), (3, [0.0, 0.0], 1), (4, None, 1)], "vec_id int, embedding array<double>, label int")
    query = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vector array<double>")
    assert [r["vec_id"] for r in R.top_k(vectors, query, 2).orderBy("rank").collect()] == [1, 2] and R.top_k(vectors, query, 1, vectors["label"] == 1).first()["vec_id"] == 2


def test_top_k_equals_a_full_scan_in_blocks_too(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((300, 8)), 1)
    x[50] = x[20]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 8), (902, [1.0] * 5), (903, [1.0] * 7 + [None]), (None, [1.0] * 8), (904, [])]
    vectors = spark.createDataFrame(rows + odd, "vec_id int, embedding array<double>")
    query = spark.createDataFrame(rows[:120] + odd, "query_id int, vector array<double>")
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    similar = np.round(unit @ unit.T, 9)
    expected = sorted((q, i, n + 1) for q in range(120) for n, i in enumerate(np.lexsort([np.arange(300), -similar[q]])[:7].tolist()))
    for numbers, block, cells in ((R.BROADCAST_NUMBERS, R.BLOCK, 500), (10, 64, 10**6)):
        monkeypatch.setattr(R, "BROADCAST_NUMBERS", numbers)
        monkeypatch.setattr(R, "BLOCK", block)
        monkeypatch.setattr(R, "_CELLS", cells)
        assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in R.top_k(vectors, query, 7).collect()) == expected
    assert R.top_k(vectors, query.where("false"), 3).count() == 0 and R.top_k(vectors.where("false"), query, 3).count() == 0


def test_entry_without_the_llm_folder(spark, monkeypatch):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("corpus_pipeline", "docloom.llm") else real(name, *a))
    assert entry.queries() and not any(k.startswith("op") and "_" in k and k[2].isdigit() or k == "pipeline" for k in entry.queries()) and entry.oracle_sql()
    assert "docloom" in sys.modules
