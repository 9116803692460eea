import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import mixing as mx
from tests.llm.helpers import CLASHING, docs, prose


def best_sum(lengths, counts, budget):
    reached = {0}
    for n, c in zip(lengths, counts):
        for _ in range(c):
            reached |= {x + n for x in reached if x + n <= budget}
    return max(reached)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 5)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 400))
def test_no_choice_comes_nearer(pairs, budget):
    lengths, counts = map(list, zip(*pairs))
    take = mx.fit_counts(np.array(lengths), np.array(counts), budget)
    assert (take >= 0).all() and (take <= counts).all()
    assert int(take @ lengths) == best_sum(lengths, counts, budget)


def test_large_budgets_are_met_exactly():
    rnd = random.Random(3)
    lengths = np.array(sorted(rnd.sample(range(20, 9000), 700)))
    counts = np.array([rnd.randint(1, 900) for _ in lengths])
    for share in (0.1, 0.37, 0.9):
        budget = int(share * (lengths @ counts))
        take = mx.fit_counts(lengths, counts, budget)
        assert int(take @ lengths) == budget and (take <= counts).all()
        assert np.abs(take / counts - share)[counts > 100].mean() < 0.05  # all lengths alike


def _sums(rows, spark):
    lengths = {(r["source"], r["doc_id"]): r["n"] for r in mx.token_lengths(rows).groupBy("source", "doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    return lengths


def test_sources_fill_their_budgets(spark):
    rows = [(i, prose(i, 5 + i % 37), "en", f"s{i % 4 if i % 5 else 0}") for i in range(400)]
    df = docs(spark, rows, CLASHING)
    chosen = mx.mix_sources(df, {"s0": 1, "s1": 2, "s2": 1}, budget=4000)
    assert chosen.columns == df.columns
    n = _sums(df, spark)
    by = {}
    for r in chosen.collect():
        by[r["source"]] = by.get(r["source"], 0) + n[r["source"], r["doc_id"]]
    assert by == {"s0": 1000, "s1": 2000, "s2": 1000}
    again = {r["doc_id"] for r in mx.mix_sources(df.repartition(7), {"s0": 1, "s1": 2, "s2": 1}, budget=4000).collect()}
    assert again == {r["doc_id"] for r in chosen.collect()}


def test_default_budget_takes_no_more_than_there_is(spark):
    rows = [(i, prose(i, 30), "en", "hot" if i < 300 else f"s{i % 3}") for i in range(400)]
    df = docs(spark, rows)
    n = _sums(df, spark)
    held, taken = {}, {}
    for (s, _), x in n.items():
        held[s] = held.get(s, 0) + x
    for r in mx.mix_sources(df).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + n[r["source"], r["doc_id"]]
    weights = {s: x**mx.TEMPERATURE for s, x in held.items()}
    aim = mx.budgets(held, None, mx.TEMPERATURE, None)
    assert any(aim[s] == held[s] for s in held) and taken["hot"] < held["hot"]
    for s in held:
        assert abs(aim[s] / sum(aim.values()) - weights[s] / sum(weights.values())) < 1e-3 and taken[s] <= aim[s]


def test_edges(spark):
    rows = [(1, "a b c", "en", None), (1, "a b c", "en", None), (2, None, "en", "s"), (3, "", "en", "s"), (None, "text", "en", "s"), (4, prose(1, 30_000), "en", "s"), (5, "one", "en", "s")]
    got = mx.mix_sources(docs(spark, rows, CLASHING), budget=10**9)
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 1, 4, 5]
    assert mx.mix_sources(docs(spark, [])).count() == 0
    assert mx.mix_sources(docs(spark, rows), {None: 1.0}, budget=100).count() == 2
    assert mx.mix_sources(docs(spark, rows), budget=0).count() == 0


def test_a_tiny_source_does_not_bound_the_others():
    big = {f"s{i}": 10**9 for i in range(20)}
    aim = mx.budgets(big | {"tiny": 1000, mx._NO_SOURCE: 10}, None, mx.TEMPERATURE, None)
    assert aim["tiny"] == 1000 and aim[mx._NO_SOURCE] == 10 and all(aim[s] >= 0.99 * n for s, n in big.items())
    skewed = {"hot": 19_000_000, "small": 10**6}
    aim = mx.budgets(skewed, None, mx.TEMPERATURE, None)
    assert abs(sum(aim.values()) - mx.LEAST_KEPT * sum(skewed.values())) <= len(aim) and all(aim[s] <= n for s, n in skewed.items())
    assert mx.budgets({"a": 10, "b": 1000, "c": 1000}, {"a": 1, "b": 1, "c": 2}, 1, 910) == {"a": 10, "b": 300, "c": 600}


def test_tiny_and_null_sources_leave_the_corpus_whole(spark):
    rows = [(i, prose(i, 60), "en", f"s{i % 4}") for i in range(400)] + [(1000, "a", "en", "tiny"), (1001, "b", "en", None)]
    kept = [r["doc_id"] for r in mx.mix_sources(docs(spark, rows)).collect()]
    assert len(kept) > 230 and {1000, 1001} <= set(kept)


def test_budgets_that_cannot_be_met_take_little_memory():
    import tracemalloc

    for lengths, counts, budget, best in (
        ([100], [10**9], 5 * 10**10 + 1, 5 * 10**10),
        ([100], [10**7], 25_000_001, 25_000_000),
        ([1000, 1001], [10**6, 1], 5 * 10**8 + 500, 5 * 10**8 + 1),
        ([6, 10, 15], [1, 10**8, 1], 5 * 10**8 + 3, 5 * 10**8 + 1),
        ([7, 500], [3, 10**7], 10**9 + 22, 10**9 + 21),
    ):
        tracemalloc.start()
        take = mx.fit_counts(np.array(lengths), np.array(counts), budget)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert int(take @ np.array(lengths)) == best and (take <= counts).all() and (take >= 0).all() and peak < 100 << 20


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 25), st.integers(1, 300)), min_size=1, max_size=4, unique_by=lambda x: x[0]), st.integers(0, 9000))
def test_the_last_programme_alone_is_best_too(pairs, budget):
    lengths, counts = map(list, zip(*pairs))
    first = mx._FIRST_STEP
    mx._FIRST_STEP = 10**9
    try:
        take = mx.fit_counts(np.array(lengths), np.array(counts), budget)
    finally:
        mx._FIRST_STEP = first
    reached = 1
    for n, c in zip(lengths, counts):
        for _ in range(c):
            reached |= reached << n
    assert int(take @ lengths) == max(k for k in range(budget + 1) if reached >> k & 1)


def test_a_common_length_takes_the_smallest_hashes(spark):
    df = docs(spark, [(i, f"word {i % 10}", "en", "s") for i in range(3000)] + [(1, "word 1", "en", "s"), (5000, "more words than those", "en", "s")])
    n = _sums(df, spark)
    by_hash = df.selectExpr("doc_id", f"xxhash64({mx.SEED}, doc_id) h").distinct().orderBy("h", "doc_id").collect()
    for budget in (1, 3, 1000, 4001):
        got = {r["doc_id"] for r in mx.mix_sources(df, budget=budget).collect()}
        taken = {}
        for i in got:
            taken.setdefault(n["s", i], set()).add(i)
        assert sum(n["s", i] for i in got) <= budget
        for length, ids in taken.items():
            assert ids == {r["doc_id"] for r in [r for r in by_hash if n["s", r["doc_id"]] == length][: len(ids)]}
