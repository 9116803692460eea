import random
import re

import numpy as np
import pyarrow as pa

from docloom.llm import substring_dedup as sd
from docloom.llm._text import words_of
from tests.llm.helpers import CLASHING, docs, prose


def brute_covered(rows, least):
    """Of each document, the words that lie in a run of least words that a smaller doc_id has."""
    words = {i: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.lower()) for i, t in rows}
    first, out = {}, {}
    for i in sorted(words):
        w, covered = words[i], set()
        grams = [tuple(w[k : k + least]) for k in range(len(w) - least + 1)]
        for k, g in enumerate(grams):
            if g in first:
                covered |= set(range(k, k + least))
        for g in grams:
            first.setdefault(g, i)
        out[i] = covered
    return out


def _corpus(seed, n=50, least=12):
    rnd = random.Random(seed)
    shared = [prose(1000 + k, rnd.randint(least - 2, 4 * least), 5000) for k in range(6)]
    rows = []
    for i in range(n):
        parts = [prose(seed * 1000 + i, rnd.randint(0, 60), 5000)]
        for _ in range(rnd.randint(0, 3)):
            words = rnd.choice(shared).split()
            a = rnd.randrange(len(words))
            parts += [" ".join(words[a : a + rnd.randint(1, 60)]).title(), prose(seed * 77 + i, rnd.randint(0, 9), 5000)]
        rows.append((i, ". ".join(parts)))
    rows[7] = (7, rows[3][1])
    return rows


def test_spans_equal_brute_force(spark):
    for seed in (1, 2, 3):
        rows = _corpus(seed)
        expected = brute_covered(rows, 12)
        got = {i: set() for i, _ in rows}
        for r in sd.repeated_passages(docs(spark, rows), 12, 4, 5000 if seed == 1 else 3).collect():
            assert r["earlier"] < r["doc_id"]
            got[r["doc_id"]] |= set(range(r["start"], r["end"]))
        assert got == expected and sum(map(len, expected.values())) > 100


def test_text_and_edges(spark):
    passage = prose(3, 60, 5000)
    long = prose(4, 20_000, 50_000) + " " + passage + " " + prose(5, 20_000, 50_000)
    rows = [(1, f"Start. {passage}. End."), (2, f"Other. {passage.upper()}! Tail."), (2, f"Other. {passage.upper()}! Tail."), (3, None), (4, ""), (5, "short"), (None, passage), (6, long), (7, passage), (7, "Different " + passage)]
    got = sd.deduplicate_passages(docs(spark, rows, CLASHING)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["text"] == rows[0][1] and by[1][0]["passages"] == []
    assert [r["text"] for r in by[2]] == ["Other. ! Tail."] * 2 and by[2][0]["removed_words"] == 60 and by[2][0]["passages"][0]["earlier"] == 1
    assert by[3][0]["text"] is None and by[4][0]["text"] == "" and by[5][0]["text"] == "short" and by[None][0]["text"] == passage
    assert len(by[6][0]["text"]) == len(long) - len(passage) and sorted(r["text"] for r in by[7]) == ["", "Different "]
    assert sd.deduplicate_passages(docs(spark, [])).count() == 0


def test_a_passage_of_many_documents(spark):
    passage = prose(8, 80, 5000)
    rows = [(i, f"{prose(i + 50, 30, 5000)} {passage} {prose(i + 9999, 30, 5000)}") for i in range(800)]
    got = {r["doc_id"]: r["removed_words"] for r in sd.deduplicate_passages(docs(spark, rows)).collect()}
    assert got[0] == 0 and all(got[i] >= 80 for i in range(1, 800))


def test_a_hundred_thousand_documents_of_one_passage(spark):
    """Work in proportion: every document meets the first one's automaton, and windows of what is left."""
    passage = prose(8, 60, 5000)
    rows = spark.range(100_000).selectExpr(
        "id doc_id",
        f"concat_ws(' ', transform(sequence(1, 8), x -> concat('a', (id * 31 + x) % 99991)), '{passage}', if(id % 1000 = 999, 'one more tail of words', null), transform(sequence(1, 3), x -> concat('b', (id * 17 + x) % 99991))) text",
    )
    got = sd.deduplicate_passages(rows.repartition(4)).selectExpr("count(*) n", "count_if(removed_words >= 60) cut", "min_by(removed_words, doc_id) one").first()
    assert (got["n"], got["cut"], got["one"]) == (100_000, 99_999, 0)


def test_anchors_of_pieces_equal_those_of_the_whole():
    words, first = words_of(pa.array([prose(1, 500), "a " * 100, None, prose(2, 49), prose(3, 70), prose(4, 900)]))
    whole = sd.anchors(words, first, 50, 12)
    for piece in (1, 37, 100, 5000):
        assert all((x == y).all() for x, y in zip(whole, sd.anchors(words, first, 50, 12, piece)))


def test_every_window_has_an_anchor():
    words, first = words_of(pa.array([prose(1, 500), "a " * 100, prose(2, 49), prose(3, 50), None]))
    rows, places, _ = sd.anchors(words, first, 50, 12)
    for row, n in enumerate(np.diff(first)):
        own = np.sort(places[rows == row])
        for start in range(n - 50 + 1):
            assert ((own >= start) & (own + 12 <= start + 50)).any()
        assert n >= 50 or not len(own)
