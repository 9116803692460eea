import random
import re

from docloom.llm import decontaminate as dc
from docloom.llm._automaton import SuffixAutomaton
from tests.llm.helpers import CLASHING, docs, prose

_WORD = re.compile(r"[0-9a-zA-Z\u0080-\U0010ffff]+")


def brute(text, items, max_words=dc.MAX_WORDS, coverage=dc.COVERAGE, least=dc.LEAST_WORDS):
    """text without each run of words beyond a limit, found by comparing all runs with all items."""
    spots = list(_WORD.finditer(text))
    words = [m[0].lower() for m in spots]
    items = [x for x in ([w.lower() for w in _WORD.findall(t)] for t in items if t) if len(x) >= dc.LEAST_ITEM]
    gone = set()
    for i in range(len(words)):
        for item in items:
            for j in range(len(item)):
                n = 0
                while i + n < len(words) and j + n < len(item) and words[i + n] == item[j + n]:
                    n += 1
                if n >= max_words or (n >= coverage * len(item) and n >= min(least, len(item))):
                    gone.add((i, i + n))
    out, at = [], 0
    for s, e in sorted(gone):
        b = spots[s].start()
        if b > at:
            out.append(text[at:b])
        at = max(at, spots[e - 1].end())
    return "".join([*out, text[at:]])


def test_against_brute_force(spark):
    rnd = random.Random(2)
    items = [prose(100 + k, rnd.randint(8, 30), 30) for k in range(6)] + ["Été à la plage, avec des amis; un beau jour d'été.", *(prose(200 + k, k, 30) for k in range(1, 6))]
    rows = []
    for i in range(60):
        words = prose(i, 60, 30).split()
        for _ in range(rnd.randint(0, 3)):
            item = rnd.choice(items).split()
            a = rnd.randrange(len(item))
            part = item[a : a + rnd.randint(3, 25)]
            at = rnd.randrange(len(words))
            words[at:at] = [w.upper() + rnd.choice(["", ",", "."]) for w in part]
        rows.append((i, " ".join(words)))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    expected = {i: brute(t, items) for i, t in rows}
    for shard in (dc.SHARD_WORDS, 10):
        got = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs(spark, rows), bench, shard_words=shard).collect()}
        assert got == expected
    assert sum(expected[i] != t for i, t in rows) > 15


def test_edges(spark):
    item = prose(5, 20)
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "!!")], "item_id bigint, text string")
    long = prose(9, 40_000) + " " + item + " " + prose(10, 40_000)
    rows = [(1, None), (2, ""), (3, item), (3, item), (4, long), (None, f"Before. {item.upper()}! After."), (5, "clean words only here")]
    df = docs(spark, rows, CLASHING)
    got = dc.decontaminate(df, bench)
    assert got.columns == df.columns and got.count() == len(rows)
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["text"] is None and by[2][0]["text"] == "" and [r["text"] for r in by[3]] == ["", ""] and by[3][0]["n_chars"] == 0
    assert item not in by[4][0]["text"] and len(by[4][0]["text"]) == len(long) - len(item)
    assert by[None][0]["text"] == "Before. ! After." and by[5][0]["text"] == "clean words only here"
    assert dc.decontaminate(df, bench.limit(0)).where("doc_id = 3").first()["text"] == item
    assert dc.decontaminate(df.limit(0), bench).count() == 0


def test_automaton_matches_all_factors():
    rnd = random.Random(4)
    for _ in range(200):
        sequences = [[rnd.randrange(3) for _ in range(rnd.randint(1, 12))] for _ in range(3)]
        automaton = SuffixAutomaton()
        for k, s in enumerate(sequences):
            automaton.add(s, k)
        least = automaton.least_over_occurrences({k: len(s) for k, s in enumerate(sequences)}, list(enumerate(sequences)))
        text = [rnd.randrange(4) for _ in range(30)]
        holds = lambda s, x: any(s[i : i + len(x)] == x for i in range(len(s) - len(x) + 1))
        for at, (n, state) in enumerate(automaton.matches(text), 1):
            expected = max(k for k in range(at + 1) if k == 0 or any(holds(s, text[at - k : at]) for s in sequences))
            assert n == expected
            if n:
                with_it = [k for k, s in enumerate(sequences) if holds(s, text[at - n : at])]
                assert automaton.mark[state] == with_it[0] and least[state] == min(len(sequences[k]) for k in with_it)


def test_items_that_share_passages(spark):
    a = "one two three four five six seven eight"
    b = f"x {a} " + prose(3, 20)
    rows, rnd = [(0, f"Before x {a} after."), (1, f"Before {a} after.")], random.Random(8)
    items = [a, b, *(f"{prose(50 + k, 6, 20)} {a.rsplit(' ', k)[0]} {prose(60 + k, 15, 20)}" for k in range(3))]
    for i in range(2, 80):
        words = prose(i, 30, 20).split()
        for item in rnd.choices(items, k=2):
            item = item.split()
            s, at = rnd.randrange(len(item)), rnd.randrange(len(words))
            words[at:at] = item[s : s + rnd.randint(4, 12)]
        rows.append((i, " ".join(words)))

    def whole(text):
        """Every run of words against every item and every length."""
        words, gone = re.findall(r"\w+", text), set()
        for i in range(len(words)):
            for item in (x.split() for x in items):
                for j in range(len(item)):
                    n = 0
                    while i + n < len(words) and j + n < len(item) and words[i + n].lower() == item[j + n]:
                        n += 1
                    if n >= dc.MAX_WORDS or (n >= dc.LEAST_WORDS and n >= dc.COVERAGE * len(item)):
                        gone |= set(range(i, i + n))
        return [w for k, w in enumerate(words) if k not in gone]

    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    for shard in (dc.SHARD_WORDS, 10):
        got = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs(spark, rows), bench, shard_words=shard).collect()}
        assert [i for i, t in rows if re.findall(r"\w+", got[i]) != whole(t)] == []
    assert a not in got[0] and sum(got[i] != t for i, t in rows) > 20


def test_short_items_count_whole(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "one two three"), (3, "the"), (4, "of course")], "item_id bigint, text string")
    rows = [(1, "x Alpha, beta gamma delta epsilon y"), (2, "x alpha beta gamma delta y"), (3, "x one two three y one two y"), (4, "the end of course")]
    got = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs(spark, rows), bench).collect()}
    assert got == {1: "x  y", 2: rows[1][1], 3: "x  y one two y", 4: rows[3][1]}


def test_added_items_remove_nothing_less(spark):
    b = prose(1, 10)
    a = f"{prose(2, 50)} odd {b.rsplit(' ', 2)[0]} {prose(3, 50)}"
    df = docs(spark, [(1, f"before odd {b.rsplit(' ', 2)[0]} after")])
    for items in ([b], [b, a]):
        assert dc.decontaminate(df, spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).first()["text"] == "before odd  after"
