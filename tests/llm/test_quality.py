import re

import duckdb
import pyarrow as pa
import pytest
import regex

from docloom.llm import quality as q
from tests.llm.helpers import CLASHING, docs, prose


def brute(text):
    if not text:
        return (0.0, 0.0, None, 0.0, 0.0)
    words = [w for w in re.split(r"[ \t\n\r]+", text) if w]
    lines = [x for x in text.split("\n") if x]
    letters = len(regex.findall(r"\p{L}", text))
    return (
        len(re.sub(r"[^#$%&*|~^<>{}=+!@]", "", text)) / len(text),
        len(regex.findall(r"\p{Lu}", text)) / letters if letters else 0.0,
        sum(map(len, words)) / len(words) if words else None,
        (len(lines) - len(set(lines))) / len(lines) if lines else 0.0,
        sum(a == b for a, b in zip(words, words[1:])) / len(words) if words else 0.0,
    )


def test_measures_equal_brute_force():
    texts = ["Été À ×÷ ÿ Þ!", "a a a\na a a\n\nb", "", None, "  \n ", "one", "日本 語 語", "x\ny\nx", "%%% $$$ ok", "A B", " A", "B\n", "\n\nq", "ПРИВЕТ мир", "ΑΒΓ δ \U00010400\U00010428"]
    got = q.measures(pa.array(texts))
    for i, t in enumerate(texts):
        for value, expected in zip((v[i] for v in got.values()), brute(t)):
            assert (expected is None and value != value) or abs(value - expected) < 1e-12, (t, value, expected)


def _rows():
    good = [(i, prose(i, 80) + ". " + prose(i + 5000, 40), "en" if i % 2 else "de", f"s{i % 3}") for i in range(900)]
    bad = [(2000 + i, " ".join(w + "%%%" for w in prose(i, 60).split()), "en", "s1") for i in range(20)]
    bad += [(3000 + i, prose(i, 60).upper().replace("W", "WORD"), "de", "s0") for i in range(10)]
    bad += [(4000, "The " * 300, "en", "s2"), (4001, "same line\n" * 50, "en", "s2")]
    return good, bad


def test_keeps_good_and_equals_sql(spark, tmp_path):
    good, bad = _rows()
    df = docs(spark, good + bad + [(5000, None), (5001, ""), (5002, " \n"), (5003, "lone text of a tiny group", None, None), (1, good[1][1], "en", "s1")], CLASHING)
    df.drop(*CLASHING).write.parquet(str(tmp_path / "documents"))
    kept = q.filter_quality(df)
    assert kept.columns == df.columns
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    assert set(range(900)) <= set(ids) and not set(ids) & {i for i, *_ in bad} and not set(ids) & {5000, 5001, 5002} and 5003 in ids and ids.count(1) == 2
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    assert ids == sorted(r[0] for r in con.execute(q.oracle("doc_id")).fetchall())


def test_sketches_merge_in_any_order(spark):
    good, bad = _rows()
    whole = {tuple(r) for r in q.sketches(q.with_measures(docs(spark, good + bad))).collect()}
    parts = q.sketches(q.with_measures(docs(spark, good))).unionByName(q.sketches(q.with_measures(docs(spark, bad))))
    assert whole == {tuple(r) for r in parts.groupBy("lang", "source", "rule", "bucket").sum("n").collect()}


def test_empty_table(spark):
    assert q.filter_quality(docs(spark, [])).count() == 0


def test_limits_follow_language_and_source_at_every_size(spark, tmp_path):
    """Groups of 5 to 500 texts, two languages of different word lengths and a source of long words, against SQL and the blend by hand."""
    rows, i = [], 0
    for lang, source, n, tail in (("en", "a", 500, ""), ("en", "b", 5, "xxxx"), ("fi", "a", 60, "yyyyyyyyyyyy"), ("fi", "b", 250, "yyyyyyyyyyyyyyyyyyyy"), (None, "a", 30, "")):
        for _ in range(n):
            rows.append((i, " ".join(w + tail for w in prose(i, 50).split()), lang, source))
            i += 1
    rows.append((i, "word " * 200_000 + "end", "en", "a"))  # a very long text that repeats itself
    df = docs(spark, rows)
    df.write.parquet(str(tmp_path / "documents"))
    found = {(r["lang"], r["source"]): (r["least"], r["most"]) for r in q.limits(q.with_measures(df)).where("rule = 2").collect()}
    assert min(found["fi", "b"][1], found["fi", "a"][1]) > found["en", "b"][1] > found["en", "a"][1]

    def fence(groups):
        x = sorted(brute(t)[2] for _, t, lang, source in rows if (lang, source) in groups)
        at = lambda share: x[-(-len(x) * share // 100) - 1]
        return at(75) + q.FENCE * (at(75) - at(25) + q.RULES["mean_word"]), len(x)

    (own, n), (lang, n_lang), (table, _) = fence({("en", "b")}), fence({("en", "a"), ("en", "b")}), fence(set(found))
    lang = (n_lang * lang + q.PRIOR * table) / (n_lang + q.PRIOR)
    assert found["en", "b"][1] == pytest.approx((n * own + q.PRIOR * lang) / (n + q.PRIOR), rel=0.05)  # the sketch's relative error
    ids = sorted(r[0] for r in q.filter_quality(df).select("doc_id").collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    assert ids == sorted(r[0] for r in con.execute(q.oracle("doc_id")).fetchall()) and i not in ids and len(ids) > 830


def test_too_short_words_are_rejected(spark):
    good, _ = _rows()
    letters = [(7000, " ".join("a1" if k % 2 else "b" for k in range(80)), "en", "s1")]
    long = [(i, " ".join(w + "word" for w in t.split()), lang, s) for i, t, lang, s in good]
    assert 7000 not in {r["doc_id"] for r in q.filter_quality(docs(spark, long + letters)).collect()}
