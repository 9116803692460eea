"""Sources mixed to target weights by fitting each source's token budget exactly.

Documents are counted by exact token length within each source. A source's budget is first filled in proportion
over its lengths; a bounded-knapsack dynamic programme over the counts left then makes up the rest, so that no
selection comes nearer to the budget from below (lengths are first divided by their common divisor; where the budget can't be met, what the
programme holds is bounded by the lengths, not by the budget). Of each length, the documents of smallest seeded hash are taken: hashes are counted
by bucket, and only the documents of the bucket at the limit are ranked, so that a common length is no task of its own.

Weights default to a temperature over what the sources hold: tokens ** temperature. A source that cannot fill its share gives all it
has, and the others share what it leaves, by weight. Without a budget, the total of the default weights is the largest at which such
sources lack at most SHORTFALL of the total together, so that sources of next to no weight don't bound the corpus; but no less than
LEAST_KEPT of all tokens, however uneven the sources. With weights given it is the largest at which no source has to give more than it has.

Rows of one doc_id and source stand or fall together, at the sum of their lengths (repeated rows). A null source
is a source of its own. Rows with a null doc_id, or without tokens (null or empty text), are not selected. A source
without a weight, where weights are given, gives nothing. An empty table gives an empty table. All columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.llm._bpe import DEFAULT_VOCABULARY, piece_encoder
from docloom.llm._shared import null_safe_columns, written
from docloom.llm._text import text_slices

TEMPERATURE = 0.7
SHORTFALL = 0.0005
LEAST_KEPT = 0.6
SEED = 17
_NO_SOURCE = "\0none"
_FIRST_STEP = 4096
#: Of the hash's bits, those that number its bucket.
_BUCKET_BITS = 16


def token_lengths(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """source (never null), doc_id and token count of each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(vocabulary)
        for batch in batches:
            for part in text_slices(batch):
                yield pa.record_batch([part.column(0), part.column(1), pa.array(encoder.count_tokens(part.column(2)))], ["source", "doc_id", "n_tokens"])

    rows = null_safe_columns(docs, {"source": "string", "doc_id": "bigint", "text": "string"}).where("doc_id is not null and length(text) > 0")
    return rows.withColumn("source", F.coalesce("source", F.lit(_NO_SOURCE))).mapInArrow(count, "source string, doc_id bigint, n_tokens bigint")


def _knapsack(lengths: np.ndarray, spare: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length bring the sum nearest to budget from below."""
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by, copies = np.zeros(budget + 1, np.int32), np.zeros(budget + 1, np.int32)
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        most = min(int(spare[i]), budget // length)
        before, k, left = reached.copy(), 1, most
        base = before
        while left > 0:  # 1, 2, 4, ... copies at a time
            step = min(k, left)
            shift = step * length
            new = np.zeros_like(base)
            new[shift:] = base[:-shift] if shift <= budget else False
            fresh = new & ~base
            at = np.flatnonzero(fresh)
            copies[at] = np.where(before[at - shift], 0, copies[at - shift]) + step
            by[at] = i
            base = base | new
            left -= step
            k *= 2
        reached = base
        if reached[budget]:
            break
    take, at = np.zeros(len(lengths), np.int64), int(np.flatnonzero(reached)[-1])
    while at:
        take[by[at]] += copies[at]
        at -= int(copies[at]) * int(lengths[by[at]])
    return take


def _greedy(lengths: np.ndarray, counts: np.ndarray, room: int) -> np.ndarray:
    """As many as fit of each length, the longest first; room is less than what all hold, so one length at most is left in part."""
    out = np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        out[i] = min(int(counts[i]), room // int(lengths[i]))
        room -= int(out[i]) * int(lengths[i])
        if out[i] < counts[i]:
            break
    return out


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each length; their tokens are as near to budget from below as any choice gets.

    Some best choice lies within 2 * longest + 1 documents of the greedy one, a vertex of the relaxed problem (Eisenbrand and Weismantel,
    2018: proximity under one constraint), so the last programme covers that neighbourhood and no more.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int(lengths @ counts)
    if total <= budget:
        return counts.copy()
    divisor = int(np.gcd.reduce(lengths))
    lengths, budget, total = lengths // divisor, budget // divisor, total // divisor
    near = 2 * int(lengths.max()) + 2
    least = np.maximum(_greedy(lengths, counts, budget) - near, 0)
    last = budget - int(lengths @ least)
    step = _FIRST_STEP
    while step < last:
        share = counts * (budget / total)
        take = np.floor(share).astype(np.int64)
        while lengths @ take > budget:  # rounding of very large shares
            i = int(np.argmax(take * lengths))
            take[i] -= 1
        room = budget - int(lengths @ take)
        for order, most in ((np.lexsort([-lengths, take - share]), 1), (np.argsort(-lengths, kind="stable"), None)):
            for i in order:
                k = min(int(counts[i] - take[i]), max(0, room - step) // int(lengths[i]))
                k = k if most is None else min(k, most)
                take[i] += k
                room -= k * int(lengths[i])
        take += _knapsack(lengths, counts - take, room)
        if int(lengths @ take) == budget:
            return take
        step *= 8
    return least + _knapsack(lengths, np.minimum(counts - least, 2 * near), last)


def _total(held: Mapping[str, int], share: Mapping[str, float]) -> float:
    """The largest total at which the sources lack SHORTFALL of it at most, or LEAST_KEPT of what they hold."""
    whole = sum(held[s] for s in share)
    bound, short, lacking = 0.0, 0.0, 0  # shares and tokens of the sources that give all they have
    for s in sorted(share, key=lambda s: held[s] / share[s]):
        if short > SHORTFALL and lacking / (short - SHORTFALL) <= held[s] / share[s]:
            break
        bound, short, lacking = held[s] / share[s], short + share[s], lacking + held[s]
    if short > SHORTFALL:
        bound = max(bound, lacking / (short - SHORTFALL))
    return min(whole, max(bound, LEAST_KEPT * whole))


def budgets(held: Mapping[str, int], weights: Mapping[str, float] | None, temperature: float, budget: int | None) -> dict[str, int]:
    """Tokens to take from each source."""
    weight = {s: (n**temperature if weights is None else float(weights.get(s, 0))) for s, n in held.items()}
    whole = sum(weight.values())
    if not whole:
        return dict.fromkeys(held, 0)
    share = {s: w / whole for s, w in weight.items() if w > 0}
    if budget is not None:
        total = budget
    else:
        total = _total(held, share) if weights is None else min(held[s] / w for s, w in share.items())
    out, left = dict.fromkeys(held, 0), 1.0  # left: shares of the sources that aren't filled
    for s in sorted(share, key=lambda s: (held[s] / share[s], s)):
        out[s] = min(held[s], int(total * min(1.0, share[s] / left) + 1e-6))
        if out[s] == held[s]:
            total -= held[s]
            left -= share[s]
        else:
            break
    else:
        return out
    return {s: n if n else min(held[s], int(total * min(1.0, share.get(s, 0) / left) + 1e-6)) for s, n in out.items()}


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: int | None = None, temperature: float = TEMPERATURE, seed: int = SEED, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The selected rows of docs; see the module."""
    spark = docs.sparkSession
    lengths = written(token_lengths(docs, vocabulary).groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n_tokens")), "token-lengths")
    counted = lengths.groupBy("source", "n_tokens").count()
    held = {r["source"]: int(r["n"]) for r in lengths.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # a row a source
    given = None if weights is None else {(_NO_SOURCE if s is None else s): w for s, w in weights.items()}
    aim = budgets(held, given, temperature, budget)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n_tokens")
        take = fit_counts(rows["n_tokens"].to_numpy(), rows["count"].to_numpy(), aim[rows["source"].iloc[0]])
        return rows.assign(take=take, held=rows["count"])[["source", "n_tokens", "take", "held"]]

    plan = written(counted.groupBy("source").applyInPandas(fit, "source string, n_tokens bigint, take bigint, held bigint").where("take > 0"), "mix-plan")
    hashed = lengths.withColumn("hash", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.shiftright("hash", 64 - _BUCKET_BITS))
    planned = hashed.hint("merge").join(plan, ["source", "n_tokens"])  # a merge join at every size: one plan
    group = ["source", "n_tokens"]
    upto = F.sum("n").over(W.partitionBy(*group).orderBy("bucket"))
    buckets = planned.where("take < held").groupBy(*group, "bucket").agg(F.count("*").alias("n"), F.first("take").alias("take")).withColumn("before", upto - F.col("n"))
    # the bucket at the limit, and how many of its documents are taken
    limit = written(buckets.where("before < take and before + n >= take").select(*group, F.col("bucket").alias("last"), (F.col("take") - F.col("before")).alias("of_last")), "mix-limits")
    parted = planned.join(limit.hint("merge"), group, "left")
    order = W.partitionBy(*group, "bucket").orderBy("hash", "doc_id")
    marginal = parted.where("bucket = last").withColumn("place", F.row_number().over(order)).where("place <= of_last").select("source", "doc_id")
    chosen = parted.where("last is null or bucket < last").select("source", "doc_id").unionByName(marginal)
    chosen = chosen.select(F.col("source").alias("__dl_source"), F.col("doc_id").alias("__dl_id"))
    source = docs["source"].cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.join(chosen, (docs["doc_id"].cast("bigint") == chosen["__dl_id"]) & (F.coalesce(source, F.lit(_NO_SOURCE)) == chosen["__dl_source"]), "left_semi")
