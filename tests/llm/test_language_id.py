import os
import random
from collections import Counter

import pytest
import zstandard

from docloom.llm import language_id as li
from tests.llm.helpers import CLASHING, docs

SYLLABLES = {"en": "th er on an re he in ed nd ha", "de": "en er ch de ei te ie un ge sch", "es": "os as cion que la el do ra mente es"}


def _text(lang, seed, n):
    rnd, parts = random.Random(f"{lang}{seed}"), SYLLABLES[lang].split()
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def _rows(seed, n):
    return [(i, _text(lang, seed + i, 20 + i % 90), lang) for i in range(n) for lang in [list(SYLLABLES)[i % 3]]]


def test_held_out_accuracy(spark):
    dictionaries = li.fit_dictionaries(docs(spark, _rows(0, 300)))[0]
    assert list(dictionaries) == ["de", "en", "es"] and all(len(d) <= li.DICTIONARY_BYTES for d in dictionaries.values())
    test = _rows(10**6, 300)
    got = {r["doc_id"]: r["language"] for r in li.identify_language(docs(spark, test), dictionaries).collect()}
    decided = [i for i, *_ in test if got[i]]
    assert len(decided) >= 0.95 * len(test)
    assert sum(got[i] == lang for i, _, lang in test if got[i]) >= 0.97 * len(decided)


def test_whole_texts_count(spark):
    """The head of a text doesn't decide."""
    dictionaries = li.fit_dictionaries(docs(spark, _rows(0, 300)))[0]
    mixed = [(1, _text("en", 1, 300) + " " + _text("es", 2, 9000))]
    assert li.identify_language(docs(spark, mixed), dictionaries).first()["language"] == "es"


def test_edges(spark):
    rows = [*_rows(0, 60), (900, None), (901, ""), (None, _text("en", 5, 50)), (902, "12"), (903, _text("de", 8, 40_000)), (5, "repeated", None), (5, "repeated", None)]
    got = li.identify_language(docs(spark, rows, CLASHING)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[900]["language"] is None and by[900]["margin"] is None and by[901]["language"] is None and by[901]["margin"] == 0.0
    assert by[None]["language"] == "en" and by[902]["language"] is None and by[903]["language"] == "de"
    assert li.identify_language(docs(spark, [])).count() == 0
    unlabelled = li.identify_language(docs(spark, [(1, "text", None)])).first()
    assert unlabelled["language"] is None
    alone = li.identify_language(docs(spark, [(i, _text("en", i, 50), "en") for i in range(5)])).first()
    assert alone["language"] == "en" and alone["margin"] is None


def brute(text, dictionaries):
    """Language, margin and bytes, from compressors made afresh for every block."""
    data, sizes = text.lower().encode(), []
    for lang, d in dictionaries.items():
        kind = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        new = lambda: zstandard.ZstdCompressor(level=li.LEVEL, dict_data=kind, write_content_size=False, write_checksum=False, write_dict_id=False)  # noqa: B023, E731
        sizes.append((sum(len(new().compress(data[at : at + li.BLOCK])) for at in range(0, len(data), li.BLOCK)), lang))
    (least, lang), (second, _) = sorted(sizes)[:2]
    margin = (second - least) / least
    return lang if margin >= li.MARGIN and margin > 0 else None, margin, least


@pytest.mark.parametrize("group", [li.GROUP, 2])
def test_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(li, "GROUP", group)
    rows = [*_rows(0, 90), (900, _text("de", 3, 9000), "de"), (901, "x", "en"), (902, "und the que", "es")]
    df = docs(spark, rows)
    by_fold = li.fit_dictionaries(df)
    folds = {r["doc_id"]: r["fold"] for r in df.select("doc_id", li._fold(df["text"]).alias("fold")).collect()}
    got = {r["doc_id"]: r for r in li.identify_language(df).collect()}
    for i, text, _ in rows:
        lang, margin, least = brute(text, by_fold[folds[i]])
        assert (got[i]["language"], got[i]["best_bytes"], got[i]["raw_bytes"]) == (lang, least, len(text.encode())) and abs(got[i]["margin"] - margin) < 1e-12
    assert len(set(folds.values())) == 2 and Counter(r["language"] for r in got.values())["en"] > 25


def test_dictionaries_hold_whole_samples_of_other_folds(spark):
    """Each text has words of its own: none of a fold's texts is in the fold's dictionaries, and pieces begin anywhere."""
    rows = [(i, " ".join(f"t{i}w{k}" for k in range(400)), "en") for i in range(60)] + [(100, "alone in its language and fold", "xx")]
    df = docs(spark, [*rows, (200, rows[0][1], "en")])
    folds = {r["doc_id"]: r["fold"] for r in df.select("doc_id", li._fold(df["text"]).alias("fold")).collect()}
    found = li.fit_dictionaries(df, dictionary_bytes=16 << 10)
    assert folds[0] == folds[200] and all(d["xx"] for d in found)
    for fold, d in enumerate(found):
        words = d["en"].decode().split()
        texts = {int(w[1:].partition("w")[0]) for w in words if w[0] == "t" and "w" in w[2:]}
        assert texts == {i for i, *_ in rows if i < 60 and folds[i] != fold}
        places = [int(w.partition("w")[2]) for w in words if w[0] == "t" and w.partition("w")[2].isdigit()]
        assert min(places) < 60 and max(places) > 340 and len(d["en"]) <= 16 << 10


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="needs the given tables")
def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.identify_language(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    decided = [r for r in got if r["language"]]
    assert len(decided) >= 0.9 * len(got) and sum(r["language"] == r["lang"] for r in decided) >= 0.97 * len(decided)
