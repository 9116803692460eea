import pathlib

import pytest

from docloom.operators import html as H
from docloom.operators import patterns as P
from docloom.sources import html as S

DUMP = pathlib.Path(__file__).parent / "fixtures" / "dump.html"


@pytest.fixture(scope="module")
def documents(spark):
    return S.split_documents(S.read_html(spark, str(DUMP)))


@pytest.fixture(scope="module")
def sections(documents):
    return {r["id"]: r for r in H.with_parents(H.sections(S.content_documents(documents)), "source_file", "doc_index").collect()}


def test_split_and_select(spark, documents):
    assert [r["doc_index"] for r in documents.orderBy("doc_index").collect()] == [0, 1]
    assert S.select_document(documents, 1).count() == 1 and S.content_documents(documents).count() == 1
    with pytest.raises(Exception, match="no document 2"):
        S.select_document(documents, 2).collect()
    plain = spark.createDataFrame([("x<!DOCTYPE html>A<!doctype html>B",), ("none",), (None,)], "html string")
    assert [(r["doc_index"], r["html"]) for r in S.split_documents(plain).orderBy("total_documents", "doc_index").collect()] == [(0, "none"), (0, "<!DOCTYPE html>A"), (1, "<!doctype html>B")]
    assert [r[0] for r in plain.select(S.count_documents(plain["html"])).collect()] == [2, 0, None]


def test_contents(documents):
    toc = H.table_of_contents(S.content_documents(documents)).collect()
    assert [(r["id"], r["title"], r["level"]) for r in toc] == [("1", "Start", 1), ("1.1", "Setup", 2), ("1.2", "Deep", 2), ("intro", "Intro", 1)]


def test_section_heads(sections):
    assert set(sections) == {"1", "1.1", "1.2", "2"}
    assert [(sections[i]["title"], sections[i]["level"], sections[i]["breadcrumb"], sections[i]["parent_id"]) for i in ("1", "1.1", "1.2", "2")] == [
        ("Start here", 1, "Docs / Start", None), ("Setup", 2, "Docs / Setup", "1"), ("Deep", 2, "Docs / Deep", "1"), ("Two", 1, "Docs / Two", None),
    ]


def test_mixed_content(sections):
    kinds = lambda i: [(e["type"], e["content"], e["order"]) for e in sections[i]["mixed"]]
    assert kinds("1") == [("text", "### Key ideas", 1), ("text", "Use run()(python) and x(code) to begin the work.", 2), ("code", "def f(self):\n    return 1", 2), ("text", "skipped code block", 2)]
    assert [(b["language"], b["content"]) for b in sections["1"]["code_blocks"]] == [("python", "def f(self):\n    return 1")]
    body = sections["1.1"]["mixed"]
    assert [(e["type"], e["title"]) for e in body] == [("text", None), ("text", "Error Message"), ("text", "Tutorial Step"), ("text", "Example Algorithms"), ("code", "Command Line Example"), ("table", "Data Table"), ("text", None)]
    assert body[1]["content"] == "⚠️ Error: Disk full" and body[2]["content"] == "First do this.\n\nThen that." and body[3]["content"] == "📚 Examples:\n  - Algo.py (Python)"
    assert "dropped" not in sections["1.1"]["content"] and "[Code Block]" in sections["1.1"]["content"] and "[Table]" in sections["1.1"]["content"]
    (table,) = sections["1.1"]["tables"]
    assert table["headers"] == ["name", "size"] and table["rows"] == [["a", "1"], ["b", "2", "3"]] and table["caption"] == "Sizes"
    deep = sections["1.2"]
    assert [(e["type"], e["title"], e["language"]) for e in deep["mixed"]] == [("table", "Data Table", None), ("api_content", "API: Lib.Type", "python"), ("api_content", "API: Lib.Type (C#)", "csharp")]
    assert deep["mixed"][1]["content"] == "## Type\nAbout it.\n`Type()`" and deep["tables"][0]["rows"] == [["v"]]


def test_headings_without_sections(spark):
    html = "<h1 id='a'>A</h1><p>one <code>c</code></p><h2>B two</h2><ul><li>x</li></ul><h1>Table of contents</h1><h1>C</h1><pre>using System; public class A { }</pre>"
    got = H.sections(spark.createDataFrame([(1, html), (2, None), (3, "")], "k int, html string")).collect()
    assert [(r["id"], r["title"], r["level"], r["content"]) for r in got] == [("a", "A", 1, "one c(code) x"), (H.slug_id("B two"), "B two", 2, "x"), (H.slug_id("C"), "C", 1, "")]
    assert got[2]["code_blocks"][0]["language"] == "csharp"


def test_hierarchy(spark):
    rows = [("d", x, x, x.count(".") + 1, i) for i, x in enumerate(["2", "1.10", "1.2", "1", "2.1.1", "1.1"])]
    df = spark.createDataFrame(rows, "doc string, id string, title string, level int, pos int")
    tree = H.with_parents(df, "doc")
    assert [r["id"] for r in tree.orderBy(H.id_order(tree["id"])).collect()] == ["1", "1.1", "1.2", "1.10", "2", "2.1.1"]
    assert {r["id"]: r["parent_id"] for r in tree.collect()} == {"1": None, "1.1": "1", "1.2": "1", "1.10": "1", "2": None, "2.1.1": None}
    assert {r["id"]: r["path"] for r in H.with_paths(tree, "doc").collect()}["1.10"] == "1 > 1.10"
    assert {(r["id"], r["sibling"]) for r in H.siblings(tree, "doc").collect()} >= {("1.1", "1.2"), ("1.2", "1.1")}
    stack = H.with_level_parents(df.withColumn("level", df["pos"] % 3 + 1), "doc")
    assert {r["pos"]: r["parent_id"] for r in stack.collect()} == {0: None, 1: "2", 2: "1.10", 3: None, 4: "1", 5: "2.1.1"}


def test_nodes_agree_with_regex(spark):
    pages = spark.createDataFrame([(1, '<div class="a b"><p>x<br><img src="y"></p></div><p data-x="1" id="sec12-abcdefab">z</p>')], "page_id int, html string")
    nodes = H.html_nodes(pages)
    assert all(r["by_tree"] == r["by_regex"] for r in P.cross_check(nodes, pages).collect())
    got = {r["node"]: r for r in nodes.collect()}
    assert (got[0]["depth"], got[0]["end"], got[0]["classes"]) == (0, 3, ["a", "b"]) and got[2]["parent"] == 1 and got[3]["depth"] == 2
    found = {r["pattern_id"] for r in P.pattern_rows(nodes, tags=True).collect()}
    assert found >= {"class_a", "class_b", "attr_data-x", "id_secN-HASH", "tag_img"}


def test_filters(spark, documents):
    df = H.with_parents(H.sections(S.content_documents(documents)), "source_file")
    assert H.find_section(df, "1.1").first()["title"] == "Setup" and H.sections_at_level(df, 2).count() == 2
    assert H.sections_with_code(df).count() == 2 and H.sections_with_code(df, "cli").count() == 1 and H.root_sections(df).count() == 2
    assert H.elements(df, "doc_index").count() == 15
