import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import token_output as to
from docloom.llm._bpe import DEFAULT_VOCABULARY, PieceEncoder, piece_encoder
from tests.llm.helpers import CLASHING, docs, prose


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet=" \n\t'stremlvd!9é́  😀", max_size=30), st.none()), max_size=8))
def test_ids_equal_the_tokenizers(texts):
    e = piece_encoder(DEFAULT_VOCABULARY)
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    ids, counts = e.encode(pa.array(texts, pa.string()))
    at = np.concatenate([[0], np.cumsum(counts)]).astype(int)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == e.encoding.encode_ordinary(t or "")
    assert (e.count_tokens(pa.array(texts, pa.string())) == counts).all()


def test_the_memory_of_pieces_can_be_emptied(monkeypatch):
    monkeypatch.setattr("docloom.llm._bpe.REMEMBERED_PIECES", 50)
    e = PieceEncoder(DEFAULT_VOCABULARY)
    for k in range(5):
        text = prose(k, 300, 10_000)
        assert e.encode(pa.array([text]))[0].tolist() == e.encoding.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=12), max_size=6))
def test_codes_round_trip(rows):
    counts = np.array([len(r) for r in rows], np.int64)
    control, quads, data, sizes = to.encode_values(np.array([x for r in rows for x in r], np.uint64), counts)
    c, d = np.concatenate([[0], np.cumsum(quads)]).astype(int), np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    for i, row in enumerate(rows):
        own = data[d[i] : d[i + 1]]
        assert to.decode_values(control[c[i] : c[i + 1]].tobytes(), own.tobytes(), len(row)).tolist() == row
        assert len(own) == sum(max(1, -(-x.bit_length() // 8)) for x in row)


def test_round_trip_of_a_table(spark):
    long = prose(1, 60_000)
    rows = [(1, "Hello  world\n\n it's"), (1, "Hello  world\n\n it's"), (2, None), (3, ""), (None, "no id"), (4, long), (5, "é😀 日本語")]
    codes = to.encode_tokens(docs(spark, rows, CLASHING))
    got = sorted(((r["doc_id"], r["text"]) for r in to.decode_tokens(codes).collect()), key=str)
    assert got == sorted(rows, key=str)
    by = {r["doc_id"]: r for r in codes.where("kind = 'document'").collect()}
    assert by[2]["control"] is None and by[2]["n_tokens"] is None and by[3]["n_tokens"] == 0 and bytes(by[3]["data"]) == b""


def test_frequent_ids_come_first(spark):
    codes = to.encode_tokens(docs(spark, [(1, "the the the of of a")]))
    head = codes.where("kind = 'vocabulary'").first()
    order = to.decode_values(head["control"], head["data"], head["n_tokens"])
    enc = piece_encoder(DEFAULT_VOCABULARY).encoding
    assert enc.decode(order[:2].tolist()) == " the of" and sorted(order.tolist()) == list(range(len(order)))
    assert to.encode_tokens(docs(spark, [])).count() == 1


def test_values_of_every_width():
    rnd = random.Random(0)
    values = np.array([rnd.randrange(2 ** rnd.choice([8, 16, 24, 32])) for _ in range(5001)], np.uint64)
    control, _, data, _ = to.encode_values(values, np.array([5001]))
    assert (to.decode_values(control.tobytes(), data.tobytes(), 5001) == values).all()
