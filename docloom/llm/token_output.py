"""Token ids as frequency ranks in a byte-aligned code: control bytes apart from data bytes (Stream VByte).

Every text is tokenised once. Ids are then renumbered by falling corpus frequency (ties: the smaller id first),
so that the commonest 256 take one byte. A control byte holds the byte lengths, less one, of four ids, two bits
each from the lowest; data bytes are little-endian. Decoding looks lengths and byte places up in two tables.

Result: one row of kind ``vocabulary`` (doc_id null; its codes are the token ids in rank order) and one of kind
``document`` for each row of the input, repeated rows included. Null text: n_tokens, control and data null.
Empty text: 0 tokens, empty bytes. A null doc_id stays null. Empty table: the vocabulary row alone, with the ids
in their own order. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._bpe import DEFAULT_VOCABULARY, piece_encoder
from docloom.llm._shared import null_safe_columns, written
from docloom.llm._text import raw_bytes, text_slices

CODES = "kind string, doc_id bigint, n_tokens bigint, control binary, data binary"
_LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)])
_TOTAL = _LENGTHS.sum(1)
_PLACE = np.full((256, 16), -1)
for _c in range(256):
    _at = 0
    for _k in range(4):
        _PLACE[_c, 4 * _k : 4 * _k + _LENGTHS[_c, _k]] = np.arange(_at, _at + _LENGTHS[_c, _k])
        _at += _LENGTHS[_c, _k]


def encode_values(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of counts[i] values each: control bytes, their count by row, data bytes, their count by row."""
    values = values.astype("<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    quads = -(-counts // 4)
    begin = np.concatenate([[0], np.cumsum(quads)[:-1]]) * 4 if len(counts) else np.zeros(0, np.int64)
    row_first = np.cumsum(counts) - counts
    padded = np.zeros(4 * int(quads.sum()), np.uint8)
    padded[np.arange(len(values)) + np.repeat(begin - row_first, counts)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    upto = np.concatenate([[0], np.cumsum(code.astype(np.int64) + 1)])
    return control, quads, data, upto[row_first + counts] - upto[row_first]


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values, by table lookup."""
    c = np.frombuffer(control, np.uint8)
    if not len(c):
        return np.zeros(0, np.uint32)
    d = np.append(np.frombuffer(data, np.uint8), np.zeros(16, np.uint8))
    total = _TOTAL[c]
    total[-1] = 0  # the last quad may be short; nothing starts after it
    base = np.concatenate([[0], np.cumsum(total)[:-1]])
    place = _PLACE[c]
    out = np.where(place >= 0, d[np.minimum(base[:, None] + place, len(d) - 1)], 0).astype(np.uint8)
    return out.reshape(-1).view("<u4")[:n].copy()


def _binary(data: np.ndarray, counts: np.ndarray, valid: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    mask = pa.array(valid).buffers()[1] if len(valid) else None
    return pa.Array.from_buffers(pa.binary(), len(counts), [mask, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def token_ids(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and the ids as little-endian bytes (two to an id for vocabularies up to 65,536)."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(vocabulary)
        for batch in batches:
            for part in text_slices(batch):
                ids, counts = encoder.encode(part.column(1))
                valid = np.asarray(part.column(1).is_valid())
                yield pa.record_batch([part.column(0), pa.array(counts, pa.int64(), mask=~valid), _binary(ids.view(np.uint8), counts * ids.itemsize, valid)], ["doc_id", "n_tokens", "ids"])

    return null_safe_columns(docs, {"doc_id": "bigint", "text": "string"}).mapInArrow(tokenise, "doc_id bigint, n_tokens bigint, ids binary")


def encode_tokens(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """docs' texts as frequency-ranked ids; see the module."""
    spark = docs.sparkSession
    size = piece_encoder(vocabulary).size
    kind = np.uint16 if size <= 1 << 16 else np.uint32
    ids = written(token_ids(docs, vocabulary), "token-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(raw_bytes(batch.column(0))[0].view(kind), minlength=size)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found), pa.array(total[found])], ["token", "n"])

    # one row a token of the vocabulary at most, whatever the corpus
    counted = ids.select("ids").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(size, np.int64)
    frequency[counted["token"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    order = np.lexsort([np.arange(size), -frequency])
    rank = np.empty(size, np.uint32)
    rank[order] = np.arange(size, dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "ids", 1 << 21):
                counts = np.asarray(part.column(1).fill_null(0))
                valid = np.asarray(part.column(2).is_valid())
                control, quads, data, sizes = encode_values(ranks.value[raw_bytes(part.column(2))[0].view(kind)], counts)
                name = pa.array(["document"] * part.num_rows, pa.string())
                yield pa.record_batch([name, part.column(0), part.column(1), _binary(control, quads, valid), _binary(data, sizes, valid)], ["kind", "doc_id", "n_tokens", "control", "data"])

    control, _, data, _ = encode_values(order, np.array([size]))
    head = spark.createDataFrame([("vocabulary", None, size, bytearray(control.tobytes()), bytearray(data.tobytes()))], CODES)
    return head.unionByName(ids.mapInArrow(encode, CODES))


def decode_tokens(codes: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id and text of encode_tokens()'s document rows."""
    head = codes.where(F.col("kind") == "vocabulary").first()
    order = decode_values(head["control"], head["data"], head["n_tokens"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = piece_encoder(vocabulary).encoding
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)))
            texts = [None if n is None else encoding.decode(order[decode_values(c, d, n)].tolist()) for n, c, d in rows]
            yield pa.record_batch([batch.column(3), pa.array(texts, pa.string())], ["doc_id", "text"])

    return codes.where(F.col("kind") == "document").select("n_tokens", "control", "data", "doc_id").mapInArrow(decode, "doc_id bigint, text string")
