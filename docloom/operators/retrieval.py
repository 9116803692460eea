"""Similarity search over embeddings: exact, by blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom import conf

#: Numbers of the queries' vectors that are broadcast at most (8 bytes each), and rows of a block on either side beyond it.
BROADCAST_NUMBERS = 4_000_000
BLOCK = 8192
#: Cells of a product that a task holds at once.
_CELLS = 4_000_000
_SIMILAR = "query_id bigint, vec_id bigint, similarity double"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit(ids: pa.Array, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors, all of one length; vectors without direction are left out."""
    if isinstance(lists, pa.ChunkedArray):
        ids, lists = ids.combine_chunks(), lists.combine_chunks()
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros((0, 0))
    matrix = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)  # null numbers are nan
    norm = np.sqrt((matrix * matrix).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return ids.to_numpy()[good], matrix[good] / norm[good, None]


def _best(rows: np.ndarray, keys: np.ndarray, similar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row (a query's place), the k pairs of highest similarity; ties: the smaller key."""
    order = np.lexsort([keys, -similar, rows])
    rows, keys, similar = rows[order], keys[order], similar[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    return rows[keep], keys[keep], similar[keep]


def _nearest(keys: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    if not len(keys) or not len(queries) or vectors.shape[1] != queries.shape[1]:
        return best
    step = max(1, _CELLS // len(queries))
    for at in range(0, len(keys), step):
        similar = np.round(queries @ vectors[at : at + step].T, 9)
        width = similar.shape[1]
        least = np.partition(similar, width - k, axis=1)[:, width - k] if width > k else np.full(len(queries), -2.0)
        row, column = np.nonzero(similar >= least[:, None])
        found = (row, keys[at + column], similar[row, column])
        best = _best(*(np.concatenate([a, b]) for a, b in zip(best, found)), k)
    return best


def _table(ids: np.ndarray, best: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "vec_id", "similarity"])


def top_k(vectors: DataFrame, query: DataFrame, k: int = conf.TOP_K, where: Column | None = None, key: str = "vec_id") -> DataFrame:
    """The k nearest vectors to each query (query_id, vector), by exact cosine of nine digits; ties: the smaller key. where: a filter on metadata, applied first.

    Queries of BROADCAST_NUMBERS numbers at most meet the vectors as they are read, without a shuffle of those; more meet them as pairs of blocks of
    about BLOCK rows. Either way a task sends k rows a query to the ranking. Vectors that are null, without direction or of another length than the
    commonest of the queries have no similarity and are left out.
    """
    kept = vectors if where is None else vectors.where(where)
    rows = kept.select(F.col(key).cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    asked = query.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).where("query_id is not null and vector is not null")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.mode(F.size("vector"), deterministic=True), F.lit(0)).alias("length")).first()
    rows, asked = rows.where(F.size("embedding") == size["length"]), asked.where(F.size("vector") == size["length"])
    if size["n"] * size["length"] <= BROADCAST_NUMBERS:
        table = asked.toArrow()
        sent = vectors.sparkSession.sparkContext.broadcast(_unit(table["query_id"], table["vector"]))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, queries = sent.value
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for batch in batches:
                found = _nearest(*_unit(batch.column(0), batch.column(1)), queries, k)
                best = _best(*(np.concatenate([a, b]) for a, b in zip(best, found)), k)
            yield _table(ids, best)

        scored = rows.mapInArrow(search, _SIMILAR)
    else:
        n_asked, n_rows = (-(-n // BLOCK) for n in (max(1, size["n"]), max(1, rows.count())))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = rows.withColumn("v", part("vec_id", n_rows)).withColumn("q", every(n_asked))
        right = asked.withColumn("q", part("query_id", n_asked)).withColumn("v", every(n_rows))

        def pair(these: pa.Table, those: pa.Table) -> pa.Table:
            ids, queries = _unit(those["query_id"], those["vector"])
            return pa.Table.from_batches([_table(ids, _nearest(*_unit(these["vec_id"], these["embedding"]), queries, k))])

        scored = left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInArrow(pair, _SIMILAR)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).withColumnRenamed("vec_id", key)
