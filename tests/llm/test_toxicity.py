import random
from collections import Counter
from math import log, sqrt

import numpy as np
import pytest

from docloom.llm import toxicity as tx
from tests.llm.helpers import CLASHING, docs, prose

BAD = "idiot moron scum trash clown".split()


def _rows(n, seed=0):
    rnd, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = prose(seed * 10**6 + i, 60).split()
        toxic = int(rnd.random() < 0.2)
        for _ in range(rnd.randint(2, 5) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def _labels(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_neighbours_equal_a_full_scan():
    rng = np.random.default_rng(1)
    vectors = rng.random((40, 500)) * (rng.random((40, 500)) < 0.1)
    vectors /= np.maximum(1e-12, np.sqrt((vectors**2).sum(0)))
    ids = rng.permutation(500).astype(np.int64)
    index = tx.BlockMaxIndex(ids, rng.integers(0, 2, 500), np.arange(40, dtype=np.uint64), np.ones(40), vectors, 16)
    for _ in range(100):
        at = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
        w = rng.random(len(at))
        w /= np.sqrt((w * w).sum())
        but = int(rng.integers(0, 500))
        (places, cosines), = index.nearest(np.zeros(len(at), np.int64), at, w, 10, [but])
        full = np.round(w @ vectors[at], 9)
        expected = sorted(((-c, i) for c, i in zip(full, ids) if c > 0 and i != but))[:10]
        assert [(-c, i) for c, i in zip(cosines, index.ids[places])] == expected


def brute(rows, labels, queries, k, shares):
    """Evidence and probability of each query (doc_id, text), by full scans in plain Python."""
    bags = {i: Counter(t.split()) for i, t in rows}
    y = {i: t for i, _, t in labels}
    df = Counter(w for bag in bags.values() for w in bag)

    def scan(known):
        """A function from a bag and a doc_id to pass over to the nearest examples, weighted by the labels of the known."""
        size = [sum(y[i] == c for i in known) for c in (0, 1)]
        have = [Counter(w for i in known if y[i] == c for w in bags[i]) for c in (0, 1)]
        weight = {}
        for w in df:
            seen = [have[c][w] + 0.5 for c in (0, 1)]
            other = [size[c] - have[c][w] + 0.5 for c in (0, 1)]
            ratio = log(seen[1] / other[1]) - log(seen[0] / other[0])
            variance = sum(1 / s + 1 / o for s, o in zip(seen, other))
            weight[w] = (log((1 + len(rows)) / (1 + df[w])) + 1) * (tx.LEAST_ASSOCIATION + abs(ratio) ** 3 / (ratio**2 + variance))

        def unit(bag):
            v = {w: (1 + log(n)) * weight[w] for w, n in bag.items() if w in weight}
            norm = sqrt(sum(x * x for x in v.values()))
            return {w: x / norm for w, x in v.items()}

        vectors = {i: unit(bag) for i, bag in bags.items()}

        def nearest(bag, but):
            own = unit(bag)
            found = ((-round(sum(x * v.get(w, 0) for w, x in own.items()), 9), i) for i, v in vectors.items() if i != but)
            return sorted(x for x in found if x[0] < 0)[:k]

        return nearest

    vote = lambda near: sum(-c * y[i] for c, i in near) / sum(-c for c, _ in near)
    ids, fold = sorted(bags), {}
    for c in (0, 1):
        for n, i in enumerate(i for i in ids if y[i] == c):
            fold[i] = n % tx.FOLDS
    points = []
    for f in range(tx.FOLDS):
        blind = scan([i for i in ids if fold[i] != f])
        points += [(vote(blind(bags[i], i)), y[i], shares[y[i]] / sum(y[j] == y[i] for j in ids)) for i in ids if fold[i] == f]
    knots = sorted({v for v, *_ in points})
    # the rising function nearest to the labels: at each knot the greatest, over what begins at or before it, of the least means
    mean = lambda a, b: sum(w * t for v, t, w in points if a <= v <= b) / sum(w for v, _, w in points if a <= v <= b)
    values = [max(min(mean(a, b) for b in knots[n:]) for a in knots[: n + 1]) for n in range(len(knots))]
    whole = scan(ids)
    for i, t in queries:
        near = whole(Counter(t.split()), i)
        yield i, near, float(np.interp(vote(near), knots, values)) if near else None


def test_scores_equal_brute_force_votes(spark):
    rows, labels = _rows(70)
    assert 5 <= sum(t for *_, t in labels) <= 35
    model = tx.ToxicityModel([i for i, _ in rows], [t for _, t in rows], [y for *_, y in labels], (0.8, 0.2), 5)
    queries = rows + [(100 + i, t) for i, t in _rows(40, 3)[0]] + [(300, "nothing known here"), (301, "idiot")]
    got = {r["doc_id"]: r for r in tx.score_toxicity(docs(spark, queries), _labels(spark, labels), model=model).collect()}
    for i, near, score in brute(rows, labels, queries, 5, (0.8, 0.2)):
        assert [(round(e["similarity"], 7), e["doc_id"]) for e in got[i]["evidence"]] == [(round(-c, 7), j) for c, j in near]
        assert got[i]["toxicity"] == (model.bare if score is None else pytest.approx(score, abs=1e-6)) and got[i]["toxic"] == (got[i]["toxicity"] >= 0.5)


def test_held_out_accuracy(spark):
    rows, labels = _rows(600)
    model = tx.fit(docs(spark, rows), _labels(spark, labels))
    other, truth = _rows(300, 1)
    other = [(i + 10**5, t) for i, t in other]
    got = {r["doc_id"]: r for r in tx.score_toxicity(docs(spark, other), _labels(spark, labels), model=model).collect()}
    right = sum(got[i + 10**5]["toxic"] == bool(y) for i, _, y in truth)
    assert right >= 0.97 * len(truth) and all(0 <= r["toxicity"] <= 1 for r in got.values())
    assert all(r["evidence"] for r in got.values() if r["toxic"])


def test_edges(spark):
    rows, labels = _rows(200)
    more = [(900, None), (901, ""), (None, "you idiot scum trash"), (902, prose(1, 40_000) + " idiot moron scum trash"), (3, rows[3][1])]
    got = tx.score_toxicity(docs(spark, rows + more, CLASHING), _labels(spark, [*labels, (5, 1, None), (7777, 1, 1), (None, 1, 1), (3, 1, 0)])).collect()
    assert len(got) == 205
    by = {r["doc_id"]: r for r in got}
    assert by[900]["toxicity"] is None and by[900]["evidence"] is None and by[901]["evidence"] == [] and by[None]["toxic"]
    assert all(e["doc_id"] != i for i, r in by.items() if i is not None for e in r["evidence"] or [])
    assert tx.score_toxicity(docs(spark, []), _labels(spark, labels)).count() == 0
    assert tx.score_toxicity(docs(spark, rows), _labels(spark, [])).where("toxicity is null").count() == 200


def test_words_of_a_small_language_count(spark):
    rows, labels = _rows(600)
    foreign = "connard salaud ordure".split()
    for i in range(1000, 1030):  # six toxic texts of another language, far fewer than those that set the label's words
        words = prose(i, 40).replace("w", "mot").split()
        toxic = int(i % 5 == 0)
        rows.append((i, " ".join(words + foreign * toxic)))
        labels.append((i, 1, toxic))
    model = tx.fit(docs(spark, rows), _labels(spark, labels))
    assert len(model.index.terms) == len({w for _, t in rows for w in t.split()})
    new = [(5000 + i, prose(5000 + i, 40).replace("w", "mot") + " connard salaud ordure" * (i % 2)) for i in range(40)]
    got = {r["doc_id"]: r["toxic"] for r in tx.score_toxicity(docs(spark, new), _labels(spark, labels), model=model).collect()}
    assert sum(got[5001 + i] for i in range(0, 40, 2)) >= 18 and sum(got[5000 + i] for i in range(0, 40, 2)) <= 1
