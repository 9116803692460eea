import pytest

import corpus_pipeline as cp
from docloom.llm import decontaminate, mixing, token_output
from docloom.llm._bpe import DEFAULT_VOCABULARY, piece_encoder
from tests.llm.helpers import CLASHING, docs, prose
from tests.llm.test_decontaminate import brute as without_passages
from tests.llm.test_near_dedup import brute_groups


def test_stages_against_brute_force(spark, tmp_path):
    item = prose(700, 25)
    rows = [(i, f"{prose(i, 90)}. {item if i % 10 == 0 else prose(i + 900, 20)}. {prose(i + 99, 30)}", "en", f"s{i % 3}") for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " tail", "en", "s0") for i in range(20)] + [(2000 + i, " ".join(w + "%%%" for w in prose(i, 60).split()), "en", "s1") for i in range(9)] + [(3000, None), (5, rows[5][1], "en", "s2")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, df, str(tmp_path))
        if i < len(cp.STAGES) - 1:
            assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = df.collect()
    good = sorted(r["doc_id"] for r in seen["quality_rules"])
    assert good == sorted(r[0] for r in rows if r[0] < 2000)
    texts = {r["doc_id"]: r["text"] for r in seen["quality_rules"]}
    groups, _ = brute_groups(list(texts.items()))
    assert sorted(r["doc_id"] for r in seen["near_duplicates"]) == sorted(set(groups.values()))
    cut = {r["doc_id"]: r["text"] for r in seen["benchmark_passages"]}
    assert cut == {i: without_passages(t, [item]) for i, t in texts.items() if i in cut} and all(item not in t for t in cut.values())
    encoder = piece_encoder(DEFAULT_VOCABULARY).encoding
    n = {r["doc_id"]: len(encoder.encode_ordinary(r["text"])) for r in seen["benchmark_passages"]}
    held, taken = {}, {}
    for r in seen["benchmark_passages"]:
        held[r["source"]] = held.get(r["source"], 0) + n[r["doc_id"]]
    for r in seen["mixture"]:
        taken[r["source"]] = taken.get(r["source"], 0) + n[r["doc_id"]]
    aim = mixing.budgets(held, None, mixing.TEMPERATURE, None)
    assert all(aim[s] - 3 <= taken[s] <= aim[s] for s in aim)
    back = {r["doc_id"]: r["text"] for r in token_output.decode_tokens(df).collect()}
    assert back == {r["doc_id"]: r["text"] for r in seen["mixture"]}
    assert decontaminate.MAX_WORDS == 13
    assert cp.run(spark, str(tmp_path)).where("kind = 'document'").count() == len(back)


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stages_take_edge_cases(spark, tmp_path, name, stage):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names, and empty tables."""
    spark.createDataFrame([(1, prose(700, 25)), (None, None), (2, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, prose(i, 60), "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None) for i in range(80)]
    rows += [(5, rows[5][1], "en", "s2"), (5, rows[5][1], "en", "s2"), (100, rows[7][1]), (101, None), (102, ""), (103, " \n!"), (None, rows[9][1]), (None, None, None, None), (104, prose(1, 60_000, 20_000))]
    df = docs(spark, rows, CLASHING)
    out = stage(spark, df, str(tmp_path))
    got = out.collect()
    if name == "token_codes":
        assert len(got) == len(rows) + 1
    else:
        assert out.columns == df.columns
        ids = [r["doc_id"] for r in got]
        assert {"quality_rules": ids.count(5) == 3 and not {101, 102, 103} & set(ids), "near_duplicates": ids.count(5) == 1 and 100 not in ids and ids.count(None) == 2, "benchmark_passages": len(ids) == len(rows), "mixture": None not in ids and not {101, 102} & set(ids) and ids.count(5) in (0, 3)}[name]
        assert name == "mixture" or 104 in ids
    empty = stage(spark, df.limit(0), str(tmp_path))
    assert empty.count() == (1 if name == "token_codes" else 0)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    (row,) = cp.run(spark, str(tmp_path)).collect()
    assert row["kind"] == "vocabulary"
