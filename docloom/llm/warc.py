"""WARC files as a table of payload chunks.

write_warc() streams pages into gzip-member WARC/1.1 response records; read_warc() streams files back as rows of
(record_id, chunk_no): each holds at most chunk_bytes of a payload, its place, and the SHA-256 of the payload up to
and including it. Neither side holds more of a record than one chunk and one block of input; a batch of rows is sent on after BATCH_BYTES.
Files are the unit of parallel work; write_warc() starts a new one at FILE_BYTES.

(record_id, chunk_no) is a key: a page_id that one row alone has names its record, and those of several rows, null among them, are
numbered by task and row. An empty payload (null or empty html) has one chunk, number 0, of no bytes. A null page_id or url is left out of
the record's head and null in the table. Repeated rows are records of their own. An empty table gives no file
rows. Other columns are left out. digest_ok of a record's last chunk tells whether the digest agrees with the head's (null if
the head has none, or the chunk isn't the last); a record cut short by the end of its file has digest_ok false, as has one whose head gives no
length that can be read, which has one chunk of no bytes. Reading goes on at the next line that begins a record; a head of over MOST_HEAD bytes is passed over.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.llm._shared import new_path, null_safe_columns, written

CHUNK_BYTES = 64 << 10
BATCH_BYTES = 4 << 20
FILE_BYTES = 64 << 20
_BLOCK = 256 << 10
MOST_HEAD = 64 << 20
#: Repeated page_ids that are sent to all tasks; more of them are joined.
_MOST_SENT = 100_000
_DATE = "2000-01-01T00:00:00Z"
CHUNKS = "record_id string, page_id bigint, url string, chunk_no bigint, chunk_offset bigint, chunk_bytes bigint, payload binary, digest string, is_last boolean, digest_ok boolean"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_head(page_id: int | None, url: str | None, digest: str, payload_bytes: int, number: str = "") -> bytes:
    """number: what tells records of one page_id apart."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    name = "none" if page_id is None else str(page_id)
    lines = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:docloom:page:{name}{':' * bool(number)}{number}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {' '.join(url.split())}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + payload_bytes}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_warc(pages: DataFrame, path: str, level: int = 6) -> DataFrame:
    """pages (page_id, url, html) as WARC files under path; result: path and n_records of each file written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, folder = _filesystem(path)
        system.create_dir(folder, recursive=True)
        raw, number, records, at, row = None, 0, 0, "", 0
        for batch in batches:
            for page_id, url, html, again in zip(*(batch.column(i) for i in range(4))):
                row += 1
                if raw is None:
                    # another attempt at the task writes other files; only those of the one that ended are named
                    at = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    raw, records = system.open_output_stream(at, compression=None), 0
                payload = b"" if not html.is_valid else memoryview(html.as_buffer())
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw.write(pack.compress(record_head(page_id.as_py(), url.as_py(), hashlib.sha256(payload).hexdigest(), len(payload), f"{task.partitionId()}-{row}" if again.as_py() else "")))
                for i in range(0, len(payload), _BLOCK):
                    raw.write(pack.compress(payload[i : i + _BLOCK]))
                raw.write(pack.compress(b"\r\n\r\n") + pack.flush())
                records += 1
                if raw.tell() >= FILE_BYTES:
                    raw.close()
                    yield pa.record_batch([[at], [records]], ["path", "n_records"])
                    raw, number = None, number + 1
        if raw is not None:
            raw.close()
            yield pa.record_batch([[at], [records]], ["path", "n_records"])

    rows = null_safe_columns(pages, {"page_id": "bigint", "url": "string", "html": "string"})
    repeated = written(rows.groupBy("page_id").count().where("count > 1").select(F.col("page_id").alias("__dl_id"), F.lit(True).alias("__dl_again")), "repeated-pages")
    n = repeated.count()
    if n:
        repeated = F.broadcast(repeated) if n <= _MOST_SENT else repeated
        rows = rows.join(repeated, F.col("page_id").eqNullSafe(F.col("__dl_id")), "left").select("page_id", "url", "html", F.coalesce("__dl_again", F.lit(False)).alias("again"))
    else:
        rows = rows.withColumn("again", F.lit(False))
    # the manifest is written at once: reading it again must not write the files again
    return written(rows.mapInArrow(write, "path string, n_records bigint"), "warc-manifest")


class _Reader:
    """Bytes of a plain or multi-member gzip stream, a block at a time."""

    def __init__(self, file) -> None:
        self.file, self.left, self.unpack = file, b"", None
        self.packed = file.read(_BLOCK)
        self.gzip = self.packed[:2] == b"\x1f\x8b"

    def _more(self) -> bool:
        while True:
            if not self.packed:
                self.packed = self.file.read(_BLOCK)
                if not self.packed:
                    return False
            if not self.gzip:
                self.left, self.packed = self.left + self.packed, b""
                return True
            if self.unpack is None:
                self.unpack = zlib.decompressobj(31)
            got = self.unpack.decompress(self.packed, _BLOCK)
            self.packed = self.unpack.unconsumed_tail or self.unpack.unused_data
            if self.unpack.eof:
                self.unpack = None
            if got:
                self.left += got
                return True

    def upto(self, n: int) -> bytes:
        while len(self.left) < n and self._more():
            pass
        got, self.left = self.left[:n], self.left[n:]
        return got

    def head(self) -> bytes | None:
        """From the next line that begins a record up to an empty line; None at the end."""
        while True:
            at = 0 if self.left[:5] == b"WARC/" else self.left.find(b"\nWARC/") + 1
            if at or self.left[:5] == b"WARC/":
                self.left = self.left[at:]
                break
            self.left = self.left[-5:]
            if not self._more():
                return None
        begin = 0
        while (at := self.left.find(b"\r\n\r\n", begin)) < 0 and len(self.left) <= MOST_HEAD:
            begin = max(0, len(self.left) - 3)
            if not self._more():
                return None
        if at < 0:
            self.left = self.left[5:]  # no head that ends: on to the next
            return self.head()
        got, self.left = self.left[:at], self.left[at + 4 :]
        return got


def _length(value: str | None) -> int | None:
    return int(value) if value and value.isascii() and value.isdigit() else None


def payload_chunks(file, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """The chunk rows of an open WARC file, in its order."""
    reader = _Reader(file)
    while (head := reader.head()) is not None:
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
        length = _length(fields.get("content-length"))
        left = length or 0
        if fields.get("content-type", "").startswith("application/http") and left:
            http = b""
            while b"\r\n\r\n" not in http and len(http) < left and len(http) < MOST_HEAD and (got := reader.upto(min(512, left - len(http)))):
                http += got
            left -= len(http)
            reader.left = http.partition(b"\r\n\r\n")[2] + reader.left
            left += len(http.partition(b"\r\n\r\n")[2])
        record = fields.get("warc-record-id", "").strip("<>") or None
        number = (record or "").rpartition("urn:docloom:page:")[2].partition(":")[0]
        own = {"record_id": record, "page_id": int(number) if number.lstrip("-").isdigit() else None, "url": fields.get("warc-target-uri")}
        claimed = fields.get("warc-payload-digest", "").partition("sha256:")[2] or None
        digest, chunk_no, offset = hashlib.sha256(), 0, 0
        while True:
            chunk = reader.upto(min(chunk_bytes, left))
            digest.update(chunk)
            left -= len(chunk)
            short = length is None or (left > 0 and not chunk)
            last = left == 0 or short
            yield own | {"chunk_no": chunk_no, "chunk_offset": offset, "chunk_bytes": len(chunk), "payload": chunk, "digest": digest.hexdigest(), "is_last": last, "digest_ok": False if short else (digest.hexdigest() == claimed if last and claimed else None)}
            if last:
                break
            chunk_no, offset = chunk_no + 1, offset + len(chunk)


def read_warc(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunks of all records of the WARC files in files' column path."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def rows_of(path: str) -> Iterator[dict]:
        system, at = _filesystem(path)
        with system.open_input_stream(at, compression=None) as file:
            yield from payload_chunks(file, chunk_bytes)

    def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
        schema = pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, CHUNKS.split(", "))])
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows_of(path):
                    rows.append(row)
                    size += row["chunk_bytes"] + 256
                    if size >= BATCH_BYTES:
                        yield batch_of(rows, schema)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows, schema)

    # a task a file; numbering them is one task's work, over a row a file
    paths = files.where("path is not null").select("path", (F.row_number().over(W.orderBy("path")) - 1).alias("number"))
    return paths.repartitionById(max(1, files.where("path is not null").count()), "number").select("path").mapInArrow(read, CHUNKS)


def warc_chunks(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """pages through WARC files in the shared folder, as chunk rows."""
    return read_warc(write_warc(pages, new_path(pages.sparkSession, "warc")), chunk_bytes)
