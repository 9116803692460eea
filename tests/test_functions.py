import os

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom import conf
from docloom.functions import evidence as E
from docloom.functions import text as T
from docloom.operators import patterns as P
from docloom.operators import review as V
from docloom.sources import files


def _one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


@pytest.mark.parametrize(("code", "language"), [("pip install x", "cli"), ("x -- y", "cli"), ("def f(self): return self.x", "python"), ("using System; public class A { }", "csharp"), ("hello", "text")])
def test_code_language(spark, code, language):
    from docloom.operators.html import code_language

    assert _one(spark, T.detect_code_language(F.col("c")), c=code) == language == code_language(code)


def test_scalars(spark):
    assert _one(spark, T.clean_text(F.col("t")), t="a  b\n c ") == "a b c"
    assert _one(spark, T.slug(F.col("t")), t="A b--C!").startswith("a-b-c-")
    assert [_one(spark, T.generalise_id(F.col("t")), t=t) for t in ("sec12-abcdefab", "deadbeef1")] == ["secN-HASH", "HASHN"]
    assert [_one(spark, T.size_score(F.col("n")), n=n) for n in (100, 200, 500, 1201, 2001)] == [0.5, 0.8, 1.0, 0.7, 0.3]
    assert _one(spark, T.config_for_title(F.col("t")), t="How to begin") == "tutorial" and _one(spark, T.config_for_file(F.col("t")), t="x-Lean-CLI.html") == "api_reference"
    assert _one(spark, T.readability(F.col("t")), t="") == 0.5


def test_table_markdown(spark):
    got = _one(spark, T.table_markdown(F.array(F.lit("a"), F.lit("b")), F.array(F.array(F.lit("1")), F.array(F.lit("1"), F.lit("2"), F.lit("3"))), F.lit(None).cast("string")))
    assert got == "| a | b |\n| --- | --- |\n| 1 |  |\n| 1 | 2 |"


def test_evidence(spark):
    assert abs(_one(spark, E.evidence_score(F.col("v"), F.col("f"), F.lit(""), F.lit(0.0)), v="code-snippet", f=100) - 0.23) < 1e-9
    note = lambda a, b: _one(spark, E.change_note(F.lit(a), F.lit(b), F.lit(0.1), F.lit(0.1)))
    assert note(10, 16) == "⚠️ CHANGED: freq 10→16" and note(10, 15) == ""
    assert _one(spark, E.scaled(F.lit(7), 0.3)) == 23


def test_coverage(spark):
    baseline = spark.createDataFrame([("class_code", 10), ("class_x", 3), ("class_y", 1)], "pattern_id string, frequency bigint")
    found = spark.createDataFrame([("class_code", 10)], "pattern_id string, frequency bigint")
    row = P.coverage(baseline, found).first()
    assert abs(row["overall_coverage"] - 10 / 14) < 1e-9 and (row["high_coverage"], row["medium_coverage"], row["low_coverage"]) == (1.0, 0.0, 0.0)
    assert [r[0] for r in P.missing_patterns(baseline, found).collect()] == ["class_x", "class_y"]
    assert {r["content_type"]: r["coverage"] for r in P.coverage_by_type(baseline, found).collect()} == {"code": 1.0}
    assert P.coverage(baseline.limit(0), found).first()["overall_coverage"] == 0.0


def test_rules(spark):
    rows = [("class_a", "class", "a", ""), ("class_b", "class", "b", "skip"), ("attr_data-x", "attr", "data-x", "api_reference"), ("id_N", "id_pattern", "N", "code_content")]
    rules = V.compile_rules(spark.createDataFrame(rows, "pattern_id string, selector_type string, selector_value string, human_decision string"))
    by = {r["content_type"]: [x["selector_value"] for x in r["rules"]] for r in V.rules_by_type(rules).collect()}
    assert by["skip_content"][:2] == ["a", "b"] and len(by["skip_content"]) == 27 and by["api_reference"] == ["data-x"] and set(by) == {"skip_content", "api_reference"}


@pytest.mark.parametrize(
    ("tag", "classes", "label"),
    [
        ("div", ["csharp"], "tutorial_content"), ("div", ["code-snippet"], "code_content"), ("table", ["qc-table"], "table_content"), ("div", ["toc-h4"], "navigation_content"), ("div", ["section-example-container"], "api_reference"),
        ("img", ["cover-icon"], "SKIP"), ("video", ["tutorial-video"], "SKIP"), ("div", ["cover-content"], "SKIP"), ("canvas", ["chart"], "SKIP"), ("div", ["unknown-class"], "documentation_text"), ("span", [], "documentation_text"), ("SCRIPT", [], "SKIP"),
    ],
)
def test_classification(spark, tag, classes, label):
    df = spark.createDataFrame([(tag, classes, {"href": ""})], "tag string, classes array<string>, attrs map<string,string>")
    assert V.classify(df, files.rules_frame(spark, files.default_rules())).first()["label"] == label
    assert V.classify(df, files.rules_frame(spark, {})).first()["label"] == conf.DEFAULT_TYPE


def test_many_rules(spark, monkeypatch):
    df = spark.createDataFrame([(1, "div", ["csharp", "x"], {"href": ""}), (2, "img", ["python"], {}), (3, "p", [], {})], "k int, tag string, classes array<string>, attrs map<string,string>")
    rules = files.rules_frame(spark, files.default_rules())
    few = {(r["k"], r["label"]) for r in V.classify(df, rules, "k").collect()}
    monkeypatch.setattr(V, "MAP_RULES", 5)
    assert {(r["k"], r["label"]) for r in V.classify(df, rules, "k").collect()} == few == {(1, "tutorial_content"), (2, "SKIP"), (3, "documentation_text")}


def test_default_rules_are_all_there():
    rules = files.default_rules()
    assert {k: len(v) for k, v in rules.items()} == {"skip_content": 69, "api_reference": 15, "navigation_content": 14, "table_content": 10, "code_content": 6, "tutorial_content": 8, "documentation_text": 8}


def test_merge_and_files(spark, tmp_path):
    from docloom.sources import sinks

    old = spark.createDataFrame([("class", "a", 10, 0.5, "t", "code_content", "n"), ("class", "b", 10, 0.5, "t", "skip", "")], "selector_type string, selector_value string, frequency bigint, evidence_score double, suggested_type string, human_decision string, notes string")
    new = spark.createDataFrame([("class_a", "class", "a", 16, 0.5, "s", "u"), ("class_b", "class", "b", 11, 0.5, 'say "x", y\nz', "u"), ("class_c", "class", "c", 1, 0.9, "s", "u")], "pattern_id string, selector_type string, selector_value string, frequency bigint, evidence_score double, sample_content string, suggested_type string")
    merged = V.merge_review(new, old)
    assert {r["selector_value"]: (r["priority"], r["human_decision"], r["suggested_type"]) for r in merged.collect()} == {"a": (2, "", "u"), "b": (3, "skip", "t"), "c": (1, "", "u")}
    assert [r["selector_value"] for r in V.review_order(merged).collect()] == ["c", "a", "b"]
    sinks.write_review(merged, str(tmp_path))
    path = sinks.write_review(merged, str(tmp_path))
    assert path.endswith("_v2.csv")
    back = files.read_decisions(spark, path)
    assert back.count() == 3 and {r["selector_value"]: r["sample_content"] for r in back.collect()}["b"] == 'say "x", y\nz' and {r["evidence_score"] for r in back.collect()} == {0.5, 0.9}
    assert files.latest_decisions(back.withColumn("version", F.lit(1)).unionByName(back.withColumn("version", F.lit(2)).withColumn("notes", F.lit("late")))).where("notes = 'late'").count() == 3
    text = sinks.rules_document(files.rules_frame(spark, {"b": [{"class": "x"}], "skip_content": [{"tag": "img"}]}))
    (tmp_path / "r.yaml").write_text(text)
    assert list(files.read_rules(str(tmp_path / "r.yaml")).items()) == [("skip_content", [{"tag": "img"}]), ("b", [{"class": "x"}])] and files.read_rules("/no/such") == {}
    for i, name in enumerate(("batch_20250601_180152", "batch_20250530_135034", "other")):
        (tmp_path / "b" / name).mkdir(parents=True)
        os.utime(tmp_path / "b" / name, (1_700_000_000 + i, 1_700_000_000 + i))
    assert files.latest_batch(spark, str(tmp_path / "b")).endswith("batch_20250530_135034") and files.latest_batch(spark, str(tmp_path / "none")) is None


def test_catalogue_equals_sql(spark):
    from docloom.plans import catalogue

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer part orders lineitem events documents embeddings pages".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    oracle = catalogue.oracle_sql()
    assert set(oracle) <= set(catalogue.queries())
    norm = lambda v: str(float(round(v, 5))) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    for name in ("tag_freq", "coverage_overall", "review_merge", "classify_elements", "section_paths", "text_chunks", "sentence_chunks_paired", "chunk_coherence", "content_type", "table_markdown", "patched_placeholders", "vector_topk"):
        df = catalogue.queries()[name](spark, sf)
        got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
        result = con.execute(oracle[name])
        columns = [d[0] for d in result.description]
        expected = sorted(tuple(norm(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in result.fetchall())
        assert got == expected, name


def test_quick_trees():
    """Plain markup has the tree that the standard tokenizer gives; whatever isn't plain is left to that."""
    import random

    from docloom.functions import markup as M

    same = lambda a, b: type(a) is type(b) and (a == b if isinstance(a, str) else (a.tag, list(a.attrs.items())) == (b.tag, list(b.attrs.items())) and len(a.children) == len(b.children) and all(map(same, a.children, b.children)))
    assert M._quick('<!DOCTYPE html><p class="a b" ID="x">a &amp; b<br>c</p><script>if (x) y();</script></div>') is not None
    assert all(M._quick(h) is None for h in ("<p id='q'>", "<title>a</title>", "<script>a < b</script>", "<script>open", "a < b", "end &am", "<!-- open"))
    bits = '<p>|</p>|<P >|<div class="a b">|</DIV>|<br>|<br/>|<p/>|<a HREF="x" href="y" disabled>|text|a & b|&amp;|&lt|<|> |<!DOCTYPE html>|<!-- c -->|<!-->|<style>|</style>|<script>|</script>|<script/>|x=1;|</ p>|<p\n id="1">|\0|<title>|<p id=z>|<p id="a&amp;b">| |<![CDATA[x]]>|<?pi?>|<!doctype>|<p a="1"b="2">'.split("|")
    draw = random.Random(1)
    texts = ["".join(draw.choices(bits, k=draw.randint(1, 8))) for _ in range(4000)]
    assert sum(M._quick(t) is not None for t in texts) > 500 and all(same(M.parse(t), M.parse_any(t)) for t in texts)


def test_heavy_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    """A table in one file is as many tasks as it has bytes for, beyond the size up to which spread() deals out."""
    from docloom.sources import tables

    path = str(tmp_path / "t.parquet")
    spark.range(100_000).selectExpr("id", "md5(cast(id as string)) text").coalesce(1).write.parquet(path)
    monkeypatch.setattr(tables, "TASK_BYTES", 100 << 10)
    size = sum(f.stat().st_size for f in (tmp_path / "t.parquet").glob("*.parquet"))
    made = tables.read_table(spark, path, heavy=True)
    assert size // (100 << 10) <= made.rdd.getNumPartitions() <= size // (100 << 10) + 2 and made.count() == 100_000


def test_words_are_sorted_without_comparing_expressions(spark):
    df = spark.createDataFrame([("bbbb aaaa bbbb Cccc cccc dddd eeee ffff gggg aaaa",), ("",), (None,)], "t string")
    made = df.select(T.top_words(F.col("t"), 4).alias("w"))
    assert "array_sort" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["word"], r["n"], r["i"]) for r in made.first()["w"]] == [("bbbb", -2, 0), ("aaaa", -2, 1), ("cccc", -2, 3), ("dddd", -1, 5)]
