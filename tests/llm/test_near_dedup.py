import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from docloom.llm import near_dedup as nd
from docloom.llm._text import words_of
from tests.llm.helpers import CLASHING, docs, prose


def _sets(text):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute_groups(rows, threshold=nd.THRESHOLD):
    sets = {i: _sets(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in sets}, pairs


def _corpus():
    rnd, rows, i = random.Random(5), [], 0
    for k in range(40):
        base = prose(k, rnd.randint(40, 200)).split()
        for c in range(rnd.choice([1, 1, 2, 3, 12])):
            words = base[:]
            for _ in range(int(len(words) * rnd.choice([0, 0.01, 0.03, 0.05, 0.1]))):
                words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
            rows.append((i, " ".join(words)))
            i += 1
    return rows


def test_groups_equal_brute_force_at_recall(spark):
    rows = _corpus()
    expected, pairs = brute_groups(rows)
    got = {r["doc_id"]: r["group_id"] for r in nd.near_duplicates(docs(spark, rows)).collect()}
    assert set(got) == set(expected)
    met = sum(got[a] == got[b] for a, b in pairs) / len(pairs)
    assert met >= 0.9
    for i, g in got.items():
        assert expected[i] == expected[g]  # never more than brute force joins


def test_candidate_recall_of_tensored_keys():
    """Of pairs at the threshold, at least 0.9 meet in a table."""
    rnd = np.random.default_rng(3)
    n, met = 300, 0
    for _ in range(n):
        both = rnd.integers(0, 2**63, 600).astype(np.uint64)
        a, b = (np.concatenate([both, rnd.integers(0, 2**63, 200).astype(np.uint64)]) for _ in range(2))
        keys = [nd.half_keys(nd.minima(x, np.array([0, len(x)]), 2 * nd.WIDTH * nd.HALVES), nd.WIDTH, nd.HALVES)[0] for x in (a, b)]
        same = keys[0] == keys[1]
        met += bool(same[: nd.HALVES].any() and same[nd.HALVES :].any())
    assert met / n >= 0.9


def test_shingles():
    words, first = words_of(pa.array(["a b c d", None, "", "a b", "!!", "A, B c"]))
    shingles, cuts = nd.shingle_sets(words, first)
    assert np.diff(cuts).tolist() == [2, 0, 0, 1, 0, 1] and shingles[0] == shingles[-1]


def test_edge_cases(spark):
    long = prose(1, 30_000)
    rows = [(1, long), (2, long.upper()), (2, long), (3, None), (4, ""), (5, "!!!"), (6, "!!!"), (7, "one two"), (8, "One, two."), (9, "one"), (None, long), (None, None), (10, long), (10, prose(2, 50))]
    got = {r["doc_id"]: r for r in nd.near_duplicates(docs(spark, rows, CLASHING)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10}
    assert got[2]["group_id"] == 1 and got[2]["n_rows"] == 2 and got[8]["group_id"] == 7
    assert all(not got[i]["duplicate"] for i in (1, 3, 4, 5, 6, 7, 9))


def test_keep_one(spark):
    long = prose(1, 300)
    rows = [(1, long), (1, long), (2, long), (3, None), (3, None), (4, ""), (None, long), (None, long), (5, prose(3, 40))]
    df = docs(spark, rows, CLASHING)
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "None", "None"]
    assert nd.keep_one(df.limit(0)).count() == 0


def test_a_large_group_is_whole(spark):
    base = prose(9, 120).split()
    rows = [(i, " ".join([*base, f"tail{i}"])) for i in range(1500)] + [(5000, prose(77, 90))]
    got = {r["doc_id"]: r["group_id"] for r in nd.near_duplicates(docs(spark, rows)).collect()}
    assert got.pop(5000) == 5000 and set(got.values()) == {0}


def test_shared_boilerplate_joins_nothing_and_chains_join(spark):
    """Half of each text is the same everywhere, so that unlike texts meet in tables; chains of near copies join through their middle."""
    rnd, frame, rows = random.Random(6), prose(500, 60), []
    for k in range(60):
        rows.append((k, f"{frame} {prose(600 + k, 60)}"))
    words = prose(700, 120).split()
    for k in range(8):  # each a near copy of the one before alone
        rows.append((100 + k, " ".join(words)))
        for at in range(14 * k, 14 * k + 14):
            words[at] = f"x{at}"
    rows.append((99, rows[5][1]))  # ties: the smallest id stands for its group
    rnd.shuffle(rows)
    expected, pairs = brute_groups(rows)
    got = {r["doc_id"]: r["group_id"] for r in nd.near_duplicates(docs(spark, rows)).collect()}
    assert all(expected[i] == expected[g] for i, g in got.items()) and got[99] == 5
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs) and len({got[k] for k in range(60)}) == 60
    sizes = {r["doc_id"]: r["size"] for r in nd.signatures(docs(spark, rows)).collect()}
    assert all(sizes[i] == len(_sets(t)) for i, t in rows)
