import hashlib
import io
import zlib

from docloom.llm import warc
from docloom.llm._shared import new_path


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string")


def test_round_trip_with_edge_cases(spark):
    rows = [(1, "http://a/x", "é" * 1000, "z"), (1, "http://a/x", "é" * 1000, "z"), (None, None, None, None), (2, None, "", "z"), (3, "http://b/\nq", "a\r\n\r\nb" * 50_000, "z"), (-4, "u", "x" * 64, "z")]
    got = [r.asDict() for r in warc.warc_chunks(_pages(spark, rows), chunk_bytes=64).collect()]
    assert all(r["chunk_bytes"] == len(r["payload"]) <= 64 for r in got)
    for page_id, url, html, _ in rows[2:]:
        own = sorted((r for r in got if r["page_id"] == page_id), key=lambda r: r["chunk_no"])
        payload = (html or "").encode()
        assert b"".join(bytes(r["payload"]) for r in own) == payload
        assert [r["digest"] for r in own] == [hashlib.sha256(payload[: r["chunk_offset"] + r["chunk_bytes"]]).hexdigest() for r in own]
        assert [r["is_last"] for r in own] == [False] * (len(own) - 1) + [True] and own[-1]["digest_ok"] is True
        assert {r["url"] for r in own} == {None if url is None else " ".join(url.split())}
    assert sum(r["page_id"] == 1 for r in got) == 2 * -(-2000 // 64)


def test_empty_table(spark):
    assert warc.warc_chunks(_pages(spark, [])).count() == 0


def test_files_roll(spark, monkeypatch):
    files = warc.write_warc(_pages(spark, [(i, "u", "x" * 100, None) for i in range(20)]).coalesce(1), new_path(spark, "w"))
    assert sum(r["n_records"] for r in files.collect()) == 20


def test_plain_and_cut_files():
    payload = b"0123456789" * 5
    record = warc.record_head(9, "u", hashlib.sha256(payload).hexdigest(), len(payload)) + payload
    assert [r["chunk_bytes"] for r in warc.payload_chunks(io.BytesIO(record + b"\r\n\r\n"), 20)] == [20, 20, 10]
    cut = list(warc.payload_chunks(io.BytesIO(record[:-15]), 20))
    assert sum(r["chunk_bytes"] for r in cut) == 35 and cut[-1]["digest_ok"] is False and cut[-1]["is_last"]
    wrong = record.replace(b"0123456789", b"X123456789", 1)
    assert list(warc.payload_chunks(io.BytesIO(wrong), 20))[-1]["digest_ok"] is False
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    assert len(list(warc.payload_chunks(io.BytesIO((pack.compress(record) + pack.flush()) * 3), 20))) == 9


def test_reader_keeps_little_of_a_record():
    payload = b"x" * (32 << 20)
    record = warc.record_head(1, "u", hashlib.sha256(payload).hexdigest(), len(payload))
    most, reads = 0, []

    class Source(io.BytesIO):
        def read(self, n=-1):
            reads.append(n)
            return super().read(n)

    for row in warc.payload_chunks(Source(record + payload), 1 << 16):
        most = max(most, row["chunk_bytes"])
    assert most == 1 << 16 and max(reads) <= 256 << 10 and row["digest_ok"]


def test_other_records_are_read_too():
    text = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    (row,) = warc.payload_chunks(io.BytesIO(text))
    assert row["payload"] == b"abcd" and row["page_id"] is None and row["digest_ok"] is None


def test_record_and_chunk_number_are_a_key(spark):
    rows = [(i % 5 or None, f"http://a/{i}", f"body {i // 10} " * 40, None) for i in range(40)] + [(100 + i, "u", "x", None) for i in range(5)]
    for most in (warc._MOST_SENT, 1):
        own = warc._MOST_SENT
        warc._MOST_SENT = most
        try:
            got = [r.asDict() for r in warc.warc_chunks(_pages(spark, rows).repartition(3), chunk_bytes=100).collect()]
        finally:
            warc._MOST_SENT = own
        assert len({(r["record_id"], r["chunk_no"]) for r in got}) == len(got) and len({r["record_id"] for r in got}) == len(rows)
        assert {r["record_id"] for r in got if (r["page_id"] or 0) >= 100} == {f"urn:docloom:page:{100 + i}" for i in range(5)}
        bodies = {}
        for r in sorted(got, key=lambda r: r["chunk_no"]):
            bodies[r["record_id"], r["page_id"]] = bodies.get((r["record_id"], r["page_id"]), b"") + bytes(r["payload"])
        assert sorted((str(i), b.decode()) for (_, i), b in bodies.items()) == sorted((str(i), h) for i, _, h, _ in rows)


def test_malformed_heads_are_passed_over():
    payload = b"0123456789" * 5
    good = warc.record_head(9, "u", hashlib.sha256(payload).hexdigest(), len(payload)) + payload + b"\r\n\r\n"
    for bad in (b"12 bytes", b"-5", b"", b"0x10", "١٢".encode()):
        broken = b"WARC/1.1\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: " + bad + b"\r\n\r\nlost\r\n\r\n"
        rows = list(warc.payload_chunks(io.BytesIO(b"noise\r\n" + broken + good), 100))
        assert [(r["record_id"], r["chunk_bytes"], r["digest_ok"], r["is_last"]) for r in rows] == [("urn:x", 0, False, True), ("urn:docloom:page:9", 50, True, True)]


def test_a_very_long_url_is_read_again(spark):
    url = "http://a/" + "x" * (2 << 20)
    (row,) = warc.warc_chunks(_pages(spark, [(1, url, "body", None)])).collect()
    assert row["url"] == url and bytes(row["payload"]) == b"body"


def test_a_head_without_end_is_passed_over(monkeypatch):
    monkeypatch.setattr(warc, "MOST_HEAD", 1 << 19)
    good = warc.record_head(9, "u", hashlib.sha256(b"ab").hexdigest(), 2) + b"ab"
    rows = list(warc.payload_chunks(io.BytesIO(b"WARC/1.1\r\nX: " + b"y" * (1 << 20) + b"\r\n" + good)))
    assert [bytes(r["payload"]) for r in rows] == [b"ab"]
