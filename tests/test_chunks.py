import pytest
from pyspark.sql import functions as F

from docloom import conf
from docloom.conf import ChunkConfig
from docloom.operators import chunking as C
from docloom.operators import section_chunks as SC


def _spans(spark, text, config, kind="fixed_size"):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return [(r["start_char"], r["end_char"]) for r in C.chunk_documents(df, "text", kind, config).orderBy("chunk_index").collect()]


@pytest.mark.parametrize(("n", "expected"), [(500, [(0, 500), (300, 500)]), (2500, [(0, 1000), (800, 1800), (1600, 2500), (2300, 2500)]), (0, [])])
def test_fixed(spark, n, expected):
    assert _spans(spark, "x" * n, ChunkConfig(sentences=False)) == expected


def test_folds_agree_with_loops(spark):
    text = " ".join(f"Word{i} goes on{'. ' if i % 7 == 0 else ','} then" + ("!\n" if i % 31 == 0 else "") for i in range(400))
    for c in (ChunkConfig(max_size=300, min_size=50, overlap=60, header=False), ChunkConfig(max_size=300, overlap=0, header=False, paragraph="\n")):
        s = {"id": "1", "title": "t", "level": 1, "breadcrumb": "", "content": text, "code_blocks": [], "tables": []}
        for kind in ("fixed_size", "sentence_based", "paragraph_based"):
            df = spark.createDataFrame([(1, text)], "id int, text string")
            native = [(r["content"], r["start_char"], r["end_char"]) for r in C.chunk_documents(df, "text", kind, c).orderBy("chunk_index").collect()]
            assert native == [(x["content"], x["start_char"], x["end_char"]) for x in SC.text_chunks(s, c, kind)]


def test_text_chunks_cover_and_end(spark):
    text = ("A sentence of some length goes here. " * 40 + "x" * 1500 + " tail") * 2
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "id int, text string")
    rows = C.chunk_documents(df, "text", "text", ChunkConfig(header=False)).orderBy("chunk_index").collect()
    assert {r["id"] for r in rows} == {1}
    assert rows[0]["start_char"] == 0 and all(b["start_char"] <= a["end_char"] and b["end_char"] > a["end_char"] - 200 for a, b in zip(rows, rows[1:])) and all(r["char_count"] <= 1000 for r in rows)


def test_paired_sentences(spark):
    df = spark.createDataFrame([("A one. B two. C three.",), ("a. b. c. d.",), ("x",)], "t string")
    assert [r[0] for r in df.select(C.sentences(F.col("t"), ChunkConfig(), "paired")).collect()] == [["A oneB two", "C three."], ["ab", "cd."], ["x"]]
    assert df.select(C.sentences(F.col("t"), ChunkConfig())).first()[0] == ["A one.", "B two.", "C three."]


def test_paragraph_groups(spark):
    text = "\n\n".join("x" * n for n in (600, 300, 200))
    df = spark.createDataFrame([(text,)], "text string")
    assert [r["char_count"] for r in C.chunk_documents(df, "text", "paragraph_based", ChunkConfig(header=False)).collect()] == [902, 200]


def _section(i, content="", code=(), tables=(), level=1, parent=None):
    return {"id": i, "title": f"T{i}", "level": level, "breadcrumb": "", "content": content, "code_blocks": [{"language": a, "content": b} for a, b in code], "tables": list(tables), "parent_id": parent}


def test_section_chunks():
    table = {"headers": ["a"], "rows": [["1"]] * 7, "caption": "Cap"}
    one = SC.section_chunks(_section("1", "text", [("python", "x = 1")]), ChunkConfig())
    assert [x["chunk_type"] for x in one] == ["mixed"] and "```python\nx = 1\n```" in one[0]["content"]
    many = SC.section_chunks(_section("1", "Sentence one. " * 120, [("python", "x")], [table]), ChunkConfig())
    assert many[0]["chunk_type"] == "header" and [x["chunk_type"] for x in many[-2:]] == ["code", "table"] and many[-1]["content"].endswith("... and 2 more rows")


def test_code_units_and_splits():
    code = "import a\n\nclass A:\n    def m(self):\n        pass\n\n\ndef f(x):\n    return x\n\ny = 1"
    units = SC.python_units(code)
    assert [u[0] for u in units] == ["class A", "def f"] and code[units[0][1] : units[0][2]].strip().endswith("pass") and code[units[1][1] : units[1][2]].strip().endswith("return x")
    sharp = "namespace N.M\n{\n  public class A { void F() { } }\n  class B { }\n}"
    assert [(n, sharp[a:b].strip()[-1]) for n, a, b in SC.csharp_units(sharp)] == [("namespace N.M", "}"), ("class A", "}"), ("class B", "}")]
    big = {"language": "python", "content": "\n".join(f"a{i} = {i}" + ("\n# note" if i % 10 == 0 else "") for i in range(200))}
    parts = SC.split_code(big, 300)
    assert "".join(p for p, *_ in parts) == big["content"] and len(parts) > 3
    lines = SC.split_code({"language": "text", "content": "line\n" * 100}, 50)
    assert all(len(p) <= 50 for p, *_ in lines)
    units_split = SC.split_code({"language": "python", "content": code * 3}, 40, residue=True)
    assert any("import a" in p for p, *_ in units_split)


def test_code_aware():
    s = _section("1", "Intro text.\n```python\nx = 1\n```\nMore.", [("csharp", "var y = 2;")])
    (chunk,) = SC.code_chunks(s, ChunkConfig())
    assert chunk["chunk_type"] == "mixed" and chunk["language"] == "python" and "```csharp" in chunk["content"]


def test_hierarchical_plan():
    small = [_section(f"1.{k}", "x" * 100, level=2, parent="1") for k in range(1, 4)]
    large = _section("2", "\n\n".join(["para " * 100] * 6), level=1)
    parent = _section("1", "y" * 900)
    out = SC.hierarchical_chunks([parent, *small, large], ChunkConfig())
    assert out[0]["chunk_type"] == "header" and "Subsections (3)" in out[0]["content"] and "Path: T1 > T1.1" not in out[0]["content"]
    assert [x["section_id"] for x in out[:5]] == ["1", "1", "1.1", "1.2", "1.3"] and sum(x["section_id"] == "2" for x in out) > 2
    grouped = SC.hierarchical_chunks([_section("1.1", "a", level=2, parent="9"), _section("9", "z" * 900)], ChunkConfig())
    assert len(grouped) >= 2
    siblings = SC.hierarchical_chunks([_section("5", "p" * 2100), *[x | {"parent_id": "5", "id": f"5.{k}"} for k, x in enumerate(small)]], ChunkConfig())
    assert any(x["content"].startswith("[Grouped Sections: T1.1, T1.2, T1.3]") for x in siblings)


def test_analysis_and_hybrid(spark):
    code = _section("1", "few words", [("python", "x = 1\n" * 50)])
    assert SC.analyse(code)["strategy"] == "code_aware" and SC.analyse(_section("2"))["strategy"] == "fixed_size"
    assert SC.global_strategy([{"strategy": "a", "confidence": 0.9}, {"strategy": "b", "confidence": 0.5}, {"strategy": "b", "confidence": 0.5}]) == "b"
    out = SC.hybrid_section(_section("3", "This is a plain sentence about nothing. " * 30), conf.PRESETS["qa"])
    assert out and all(x["strategy"] == "hybrid" and 0 < x["quality_score"] <= 1 for x in out)
    rows = [("d", i, s["id"], s["title"], s["level"], "", s["content"], s["code_blocks"], [], s["parent_id"]) for i, s in enumerate([code, _section("2", "Some words. " * 100, level=2)])]
    df = spark.createDataFrame(rows, "doc string, pos int, id string, title string, level int, breadcrumb string, content string, code_blocks array<struct<language:string,content:string>>, tables array<struct<headers:array<string>,rows:array<array<string>>,caption:string>>, parent_id string")
    for name in (*SC.STRATEGIES, *SC.DOCUMENT_STRATEGIES):
        got = SC.chunk_sections(df, name, "doc").collect()
        assert got and all(r["chunk_index"] < r["total_chunks"] for r in got)
    with pytest.raises(ValueError, match="no strategy"):
        SC.chunk_sections(df, "semantic", "doc")


def test_documents_are_streamed(spark):
    sections = [_section(str(i + 1), "x" * (300 * i % 900), level=1) for i in range(7)] + [_section("1.1", "y", level=2, parent="1"), _section("1.2", "z" * 700, level=2, parent="1")]
    rows = [(d, pos, *[s[c] for c in ("id", "title", "level", "breadcrumb", "content", "code_blocks", "tables", "parent_id")]) for d in (None, "a", "b") for pos, s in enumerate(sections)]
    df = spark.createDataFrame(rows[::-1], "doc string, pos int, id string, title string, level int, breadcrumb string, content string, code_blocks array<struct<language:string,content:string>>, tables array<struct<headers:array<string>,rows:array<array<string>>,caption:string>>, parent_id string")
    made = SC.chunk_sections(df, "hierarchical", "doc")
    assert "collect_list" not in made._jdf.queryExecution().toString()  # a document is held by one task's worker, not by an aggregate of many
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a document's sections lie in several batches
    try:
        got = [(r["doc"], r["section_id"], r["chunk_index"], r["content"]) for r in made.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = [(x["section_id"], x["chunk_index"], x["content"]) for x in SC._with_places(SC.hierarchical_chunks(sections, ChunkConfig()))]
    for d in (None, "a", "b"):
        assert [r[1:] for r in got if r[0] == d] == expected


def test_config_round_trip(tmp_path):
    conf.save_config(conf.PRESETS["code"], str(tmp_path / "c.json"))
    assert conf.load_config(str(tmp_path / "c.json")) == conf.PRESETS["code"] and '"qa"' in conf.export_presets()


@pytest.mark.parametrize("strategy", ["section_based", "code_aware"])
def test_batches_handed_on_are_bounded(strategy):
    """What a worker holds doesn't grow with the batch that it is sent."""
    import pyarrow as pa
    from pyspark.sql.types import _parse_datatype_string

    from docloom import schemas

    sections = [_section(str(i), "A sentence here. " * 300, [("python", "x = 1\n" * 900)]) for i in range(1500)]
    made = list(SC._rows_to(_parse_datatype_string(f"doc int, {schemas.CHUNKS}"), lambda row: SC._with_places(SC.STRATEGIES[strategy](row["s"], ChunkConfig())))(iter([pa.RecordBatch.from_pylist([{"doc": i, "s": s} for i, s in enumerate(sections)])])))
    assert len(made) > 2 and all(b.num_rows <= SC.MOST_ROWS and b.nbytes < 2 * SC.MOST_CHARS for b in made)
    expected = [(i, x["chunk_index"], x["content"]) for i, s in enumerate(sections) for x in SC._with_places(SC.STRATEGIES[strategy](s, ChunkConfig()))]
    assert [(r["doc"], r["chunk_index"], r["content"]) for b in made for r in b.to_pylist()] == expected


@pytest.mark.parametrize("strategy", ["section_based", "code_aware"])
def test_long_rows_are_taken_few_at_a_time(spark, strategy):
    """Nor does it grow with as many long sections as lie in a batch, among short ones."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql.types import _parse_datatype_string

    from docloom import schemas

    text = "A sentence here. " * 60_000
    rows = [{"doc": i, "s": _section(str(i), text if i % 2 else "short", [("python", "x = 1")])} for i in range(64)]
    batch = pa.RecordBatch.from_pylist(rows)
    run = SC._rows_to(_parse_datatype_string(f"doc int, {schemas.CHUNKS}"), lambda row: [{"section_id": row["s"]["id"], "content": x["content"][:10]} for x in SC.STRATEGIES[strategy](row["s"], ChunkConfig(overlap=0))[:3]])
    tracemalloc.start()
    try:
        found = [r for b in run(iter([batch])) for r in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [r["doc"] for r in found] == sorted(r["doc"] for r in found) and {r["doc"] for r in found} == set(range(64))
    assert batch.nbytes > 30 * len(text) and peak < 20 * len(text)


def test_what_a_worker_holds_follows_neither_batch_nor_table(spark, monkeypatch):
    """The sections of code_aware_section_chunks in one batch, or in many: the same chunks, and never more than a fixed number of bytes."""
    import tracemalloc

    import pyarrow as pa

    from docloom import schemas
    from docloom.plans import documentation

    most = 2 << 20
    for name in ("MOST_BYTES", "MOST_CHARS"):
        monkeypatch.setattr(SC, name, 256 << 10)
    sections = documentation.code_sections(spark.range(1000).withColumnRenamed("id", "doc_id"))
    table = sections.select("doc_id", F.struct(*SC._wanted(sections)).alias("s")).toArrow().combine_chunks()
    schema = SC._beside(sections, ("doc_id",), schemas.CHUNKS)
    run = SC._rows_to(schema, lambda row: SC._with_places(SC.STRATEGIES["code_aware"](row["s"], ChunkConfig(header=False))))
    made, peaks = [], []
    for n in (100, table.num_rows):
        tracemalloc.start()
        try:
            made.append(pa.Table.from_batches(list(run(iter(table.to_batches(max_chunksize=n))))))
            peaks.append(tracemalloc.get_traced_memory()[1])
        finally:
            tracemalloc.stop()
    assert made[0].equals(made[1]) and made[0].num_rows == 5600
    assert table.nbytes > most > max(peaks), peaks
