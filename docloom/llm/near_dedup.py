"""MinHash near-duplicate removal with tensored banding.

A table key joins one of HALVES keys of a first collection with one of HALVES of a second, each key made of WIDTH
minima. So HALVES ** 2 tables of 2 * WIDTH minima need 2 * HALVES * WIDTH minima in place of 2 * WIDTH * HALVES ** 2.
Candidates, pairs that meet in a table, are verified by the exact Jaccard index of their sets of SHINGLE-word shingles.

Documents of the same words collapse first. In each table entry every document is then paired with the smallest
id; pairs that verify are joined to components. Whatever meets in an entry but lies in different components is verified pair by pair
and joined as well: all candidates count, none is capped, and only pairs already connected are passed over.

Groups are the components over verified pairs; the smallest doc_id stands for its group. A document without words
(null or empty text, or punctuation alone) is a group of its own; one with fewer than SHINGLE words has all of them as its
one shingle. Rows of one doc_id are one document, that of its row with the smallest hash of words; further rows are repeats of it. Rows with a null doc_id are in no
group and are kept. An empty table gives an empty table. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.llm._shared import drop_written, null_safe_columns, written
from docloom.llm._text import mix, ngram_hashes, text_slices, words_of

SHINGLE = 3
WIDTH = 2
HALVES = 8
#: At 0.6, two documents meet with a chance of (1 - (1 - 0.6 ** WIDTH) ** HALVES) ** 2 = 0.94.
THRESHOLD = 0.6
_SIGNATURE = "doc_id bigint, same1 bigint, same2 bigint, size int, left array<bigint>, right array<bigint>"


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all rows, repeats included; the first of each row."""
    n = np.diff(first)
    grams = ngram_hashes(words, size)
    row = np.repeat(np.arange(len(n)), n)
    keep = np.flatnonzero(np.arange(len(grams)) + size <= first[1:][row[: len(grams)]]) if len(grams) else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < size))
    if not len(short):
        return grams[keep], np.concatenate([[0], np.cumsum(np.maximum(0, n - size + 1))])
    extra = np.array([ngram_hashes(words[first[i] : first[i + 1]], int(n[i]))[0] for i in short.tolist()], np.uint64)
    rows = np.concatenate([row[keep], short])
    order = np.argsort(rows, kind="stable")
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    return np.concatenate([grams[keep], extra])[order], np.concatenate([[0], np.cumsum(count)])


def minima(shingles: np.ndarray, first: np.ndarray, how_many: int) -> np.ndarray:
    """Minima (rows with shingles x how_many) under as many hash functions."""
    start = first[:-1][np.diff(first) > 0]
    out = np.empty((len(start), how_many), np.uint64)
    factors = mix(np.arange(1, how_many + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for k in range(how_many):
        out[:, k] = np.minimum.reduceat(shingles * factors[k] + factors[k - 1], start)
    return out


def half_keys(least: np.ndarray, width: int, halves: int) -> np.ndarray:
    """rows x (2 * halves) keys of width minima each."""
    out = np.zeros((len(least), 2 * halves), np.uint64)
    for j in range(2 * halves):
        key = np.full(len(least), j + 1, np.uint64)
        for k in range(width):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + least[:, j * width + k])
        out[:, j] = key
    return out


def _distinct(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Different shingles of each row, counted as verified() has them."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort([shingles >> np.uint64(24), row])
    row, sorted_ = row[order], (shingles >> np.uint64(24))[order]
    new = np.ones(len(order), bool)
    new[1:] = (row[1:] != row[:-1]) | (sorted_[1:] != sorted_[:-1])
    return np.bincount(row[new], minlength=len(first) - 1)


def signatures(docs: DataFrame, shingle: int = SHINGLE, width: int = WIDTH, halves: int = HALVES) -> DataFrame:
    """doc_id, two hashes of its words (null: none), its number of different shingles and the half keys of both collections, a row for each row of docs with a doc_id."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                words, first = words_of(part.column(1))
                some = np.diff(first) > 0
                same1, same2 = (np.zeros(len(some), np.uint64) for _ in range(2))
                keys, size = np.zeros((len(some), 2 * halves), np.uint64), np.zeros(len(some), np.int32)
                if some.any():
                    place = np.arange(len(words), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
                    begin = first[:-1][some]
                    same1[some] = np.add.reduceat(mix(words + place * np.uint64(0xA0761D6478BD642F)), begin)
                    same2[some] = np.add.reduceat(mix(words ^ mix(place + np.uint64(77))), begin)
                    shingles, cuts = shingle_sets(words, first, shingle)
                    keys[some] = half_keys(minima(shingles, cuts, 2 * halves * width), width, halves)
                    size[:] = _distinct(shingles, cuts)
                offsets = np.arange(0, (len(some) + 1) * halves, halves, dtype=np.int32)
                lists = [pa.ListArray.from_arrays(offsets, keys[:, s].reshape(-1).view(np.int64)) for s in (slice(0, halves), slice(halves, None))]
                yield pa.record_batch([part.column(0), *[pa.array(x.view(np.int64), mask=~some) for x in (same1, same2)], pa.array(size), *lists], ["doc_id", "same1", "same2", "size", "left", "right"])

    return null_safe_columns(docs, {"doc_id": "bigint", "text": "string"}).where("doc_id is not null").mapInArrow(sign, _SIGNATURE)


def verified(pairs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard index of threshold or more, with it."""
    members = pairs.select("a", "b").unionByName(pairs.select("a", F.col("a").alias("b")).distinct())
    own = null_safe_columns(docs, {"doc_id": "bigint", "text": "string"}).where("doc_id is not null")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                shingles, first = shingle_sets(*words_of(part.column(2)), shingle)
                cuts = zip(first[:-1].tolist(), first[1:].tolist())
                yield pa.record_batch([part.column(0), part.column(1), pa.array([np.unique(shingles[i:j] >> np.uint64(24)).astype("<u8").tobytes() for i, j in cuts], pa.binary())], ["a", "b", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, theirs = None, np.zeros(0, np.uint64)
        for batch in batches:
            a_out, b_out, j_out = [], [], []
            for a, b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = np.frombuffer(data.as_buffer(), "<u8")
                if a == b:
                    if a != centre:
                        centre, theirs = a, own.copy()
                    continue
                if not len(own) or not len(theirs):
                    continue
                at = np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)
                both = int((theirs[at] == own).sum())
                index = both / (len(own) + len(theirs) - both)
                if index >= threshold:
                    a_out.append(a)
                    b_out.append(b)
                    j_out.append(index)
            yield pa.record_batch([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64()), pa.array(j_out, pa.float64())], ["a", "b", "jaccard"])

    # a merge join at every size: one plan, whose shuffle follows the input
    texts = members.hint("merge").join(own, members["b"] == own["doc_id"]).select("a", "b", "text")
    by_centre = texts.mapInArrow(sets, "a bigint, b bigint, shingles binary").repartition("a").sortWithinPartitions("a", F.col("a") != F.col("b"), "b", "shingles")
    return by_centre.mapInArrow(compare, "a bigint, b bigint, jaccard double").groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, of each node of edges (a, b)."""
    both = written(edges.selectExpr("a as u", "b as v").unionByName(edges.selectExpr("b as u", "a as v")).distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("u", "w"), F.col("v") == F.col("w")).groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near, "u").select("u", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        up = labels.select(F.col("u").alias("t"), F.col("label").alias("jump"))
        new = written(lower.join(up, F.col("to") == F.col("t"), "left").select("u", F.least("to", F.coalesce("jump", "to")).alias("label"), "was"), "labels")
        moved = new.where("label != was").limit(1).count()
        drop_written(labels)
        labels = new
        if not moved:
            drop_written(both)
            return labels.select(F.col("u").alias("node"), "label")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, width: int = WIDTH, halves: int = HALVES) -> DataFrame:
    """doc_id, group_id (the group's smallest doc_id), duplicate (doc_id isn't it) and n_rows (rows of that doc_id)."""
    signed = signatures(docs, shingle, width, halves)
    fields = F.struct("same1", "same2", "size", "left", "right")
    own = signed.groupBy("doc_id").agg(F.min(fields).alias("s"), F.count("*").alias("n_rows")).select("doc_id", "n_rows", "s.*")
    own = written(own, "signatures")
    first = own.where("same1 is not null").groupBy("same1", "same2").agg(F.min(F.struct("doc_id", "size", "left", "right")).alias("s")).select("same1", "same2", F.col("s.doc_id").alias("rep"), "s.size", "s.left", "s.right")
    tables = F.flatten(F.transform("left", lambda x: F.transform("right", lambda y: F.xxhash64(x, y))))
    exploded = first.select("rep", F.col("size").alias("size"), F.explode(F.array_distinct(tables)).alias("key"))
    # partial minima and a join, which can be split where very many documents meet in one entry
    shared = exploded.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least != most").select("key", "least")
    met = written(exploded.join(shared.hint("merge"), "key"), "entries")

    stars = met.where("rep != least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    edges = written(verified(stars, docs, threshold, shingle), "pairs")
    labels = components(edges)
    mixed = met.join(labels.hint("merge"), met["rep"] == labels["node"], "left").select("key", "rep", "size", "least", F.coalesce("label", "rep").alias("label"))
    several = mixed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
    mixed = written(mixed.join(several.hint("merge"), "key"), "entries")
    x, y = (mixed.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "label", "least", "size")]) for s in "xy")
    near = F.least("size_x", "size_y") >= threshold * F.greatest("size_x", "size_y") - 1e-9  # sets of other sizes can't reach the threshold
    cross = x.join(y, "key").where("rep_x < rep_y and label_x != label_y and rep_x != least_x").where(near).select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).distinct()
    more = written(verified(cross, docs, threshold, shingle), "pairs")
    if more.limit(1).count():
        labels = components(edges.unionByName(more))
    for table in (mixed, met, edges, more):
        drop_written(table)

    # a join, not a window: copies of one text may be any number, and a join's skewed side can be split. No words: no partner
    groups = own.select("doc_id", "n_rows", "same1", "same2").join(first.select("same1", "same2", "rep"), ["same1", "same2"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    joined = groups.join(labels, groups["rep"] == labels["node"], "left").withColumn("group_id", F.coalesce("label", "rep"))
    return joined.select("doc_id", "group_id", (F.col("doc_id") != F.col("group_id")).alias("duplicate"), "n_rows")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without the duplicates of near_duplicates(); of rows with one doc_id, the one with the smallest hash of text stays."""
    groups = written(near_duplicates(docs, **options), "near-duplicates")
    lost = groups.where("duplicate").select(F.col("doc_id").alias("__dl_id"))
    own = docs["doc_id"].cast("bigint")
    kept = docs.join(lost.hint("merge"), own == lost["__dl_id"], "left_anti")  # as above
    again = groups.where("n_rows > 1").select(F.col("doc_id").alias("__dl_id"))
    if not again.limit(1).count():
        return kept
    own = kept["doc_id"].cast("bigint")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.col("text")))
    several = kept.join(again, own == again["__dl_id"], "left_semi").withColumn("__dl_place", place).where("__dl_place = 1").drop("__dl_place")
    return kept.join(again, own == again["__dl_id"], "left_anti").unionByName(several)
