"""HTML extraction by differencing a page with the page of the nearest URL on its host.

Pages are put in order of (host, path, page_id); consecutive pages of the very same lines are a run, and empty pages are passed over.
All pages of a run have the same two neighbours: the host's last page before the run and its first after it. The one whose path
shares more leading segments, then more leading characters, with a page's own is taken (ties: the one before). Both pages' lines of visible
text are aligned by a longest common subsequence, and the lines in it, which the site's frame has put there, are deleted. Without a page
of other lines on its host a page stays whole.

The order is cut into ranges of about RANGE_PAGES pages, whatever the hosts' sizes, from a sample of URLs; every range also gets the
two pages of different lines before its first and after its last, found in a pass over keys and hashes of lines, so the result doesn't
depend on the cuts. Texts are shuffled once. There are MOST_RANGES ranges at most, larger ones beyond (a range is sorted, with spilling, and read once),
so that what the driver and the executors hold, a few keys a range, doesn't grow with the corpus.

Visible text is found in one pass over the tags. A head ends at its end tag or, as that is optional, at the first tag or text that a head can't hold.

Null or empty html gives empty text and has no neighbour. A null or unreadable url has no host and stays whole, as does a host's only page. Rows with a null page_id and repeated rows are pages like others (repeated rows
are a run). An empty table gives an empty table. Result: page_id, url, neighbour_id, text, n_lines and n_shared of every
row; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._shared import null_safe_columns

RANGE_PAGES = 4000
MOST_RANGES = 20_000
_SAMPLE = 50
PAGES = "page_id bigint, url string, neighbour_id bigint, text string, n_lines int, n_shared int"
_BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav"
    " ol option p pre section summary table tbody td tfoot th thead title tr ul !doctype".split()
)
_IN_HEAD = frozenset("base basefont bgsound link meta title script style template noscript".split())
_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z!?][^\s/>]*)[^>]*>)")
_END_OF = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in ("script", "style", "template", "noscript", "title")}
_URL = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)([^?#]*)(\?[^#]*)?")


def visible_text(html: str) -> str:
    """Text outside of tags, comments, scripts, styles, templates and the head; line breaks at blocks. Entities stay."""
    out: list[str] = []
    at, in_head = 0, False
    open_ended: set[str] = set()  # names that no end tag follows any more
    end = html.rfind(">") + 1  # no tag goes beyond it, so that no search for an end is in vain
    while (tag := _TAG.search(html, at, end)) is not None:
        text = html[at : tag.start()]
        if in_head and text.strip():
            in_head = False
        if not in_head:
            out.append(text)
        at, name = tag.end(), (tag[2] or "").lower()
        if not name:  # a comment; one without end hides what follows
            close = html.find("-->", tag.start() + 2)
            at = len(html) if close < 0 else close + 3
            out.append(" ")
            continue
        if name == "head":
            in_head = not tag[1]
        elif in_head and name not in _IN_HEAD and name[0] not in "!?":
            in_head = False
        if not tag[1] and name in _END_OF and (name != "title" or in_head):
            close = None if name in open_ended else _END_OF[name].search(html, at)
            if close is None:
                open_ended.add(name)
            if close is not None:
                at = close.start()
            elif name != "title":  # never closed
                at = len(html)
            out.append(" ")
        elif name in _BLOCKS:
            out.append("\n")
    text = html[at:].partition("<!--")[0]
    if not in_head or text.strip():
        out.append(text)
    return "".join(out)


def text_lines(html: str | None) -> list[str]:
    """The lines of visible text."""
    if not html:
        return []
    return [line for line in (" ".join(x.split()) for x in _html.unescape(visible_text(html)).split("\n")) if line]


def url_key(url: str | None) -> tuple[str, str]:
    """Host (empty if there is none) and path with query."""
    found = _URL.match(url) if url else None
    if not found:
        return "", url or ""
    return found[1].lower(), (found[2] or "/") + (found[3] or "")


def nearness(a: str, b: str) -> tuple[int, int]:
    """Leading segments, then leading characters, that two paths share."""
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return sum(1 for x, y in zip(_same_segments(a), _same_segments(b)) if x == y), n


def _same_segments(path: str) -> list[str]:
    parts = path.partition("?")[0].split("/")
    return ["/".join(parts[: i + 1]) for i in range(len(parts))]


def common_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of a are in a longest common subsequence of a and b; bit-parallel, in len(a) big integers."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [True] * head + [False] * (len(a) - head - tail) + [True] * tail
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if not x or not y:
        return out
    where: dict[str, int] = {}
    for j, line in enumerate(y):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(y)) - 1
    v, rows = full, []
    for line in x:
        m = where.get(line, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # a zero bit j in row i: the LCS of x[:i+1] and y[:j+1] is longer than that of x[:i+1] and y[:j]
    length = lambda i, j: 0 if i < 0 or j < 0 else j + 1 - (rows[i] & ((2 << j) - 1)).bit_count()
    i, j = len(x) - 1, len(y) - 1
    here = length(i, j)
    while here:
        if length(i - 1, j) == here:
            i -= 1
        elif length(i, j - 1) == here:
            j -= 1
        else:
            out[head + i] = True
            i, j, here = i - 1, j - 1, here - 1
    return out


def _key(url: str | None, page_id: int | None) -> tuple[str, str, int]:
    return (*url_key(url), -(2**63) if page_id is None else page_id)


def _packed(key: tuple[str, str, int]) -> str:
    """As text in the same order (by code point)."""
    return f"{key[0]}\0{key[1]}\0{key[2] + 2**63:020d}"


def _hash(lines: str) -> str:
    return hashlib.blake2b(lines.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() if lines else ""


def _outer(pages: list[tuple[str, str]], last: bool) -> list[tuple[str, str]]:
    """Of (key, hash) the last (or first) and the one nearest to it with another hash."""
    edge = max if last else min
    if not pages:
        return []
    one = edge(pages)
    others = [x for x in pages if x[1] != one[1]]
    return [one, edge(others)] if others else [one]


def extract_by_difference(pages: DataFrame, range_pages: int = RANGE_PAGES) -> DataFrame:
    """See the module."""
    own = null_safe_columns(pages, {"page_id": "bigint", "url": "string", "html": "string"})

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([_packed(_key(u, i)) for i, u in zip(*(batch.column(k).to_pylist() for k in range(2)))], pa.string())], ["key"])

    urls = own.select("page_id", "url").mapInArrow(keys, "key string")
    n_pages = own.count()
    ranges = max(1, min(MOST_RANGES, -(-n_pages // range_pages)))
    cuts: list[str] = []
    if ranges > 1:  # a sample of about _SAMPLE keys a range; it decides how even the ranges are, and nothing else
        sample = urls.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n_pages // (ranges * _SAMPLE)))) == 0)
        sample = sorted(r[0] for r in sample.toLocalIterator())
        cuts = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []
    sent_cuts = own.sparkSession.sparkContext.broadcast(cuts)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(_packed(_key(u, i)), _hash("\n".join(text_lines(h)))) for i, u, h in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            rows = [(bisect_right(sent_cuts.value, key), key, h) for key, h in rows if h]
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.string()))], ["p", "key", "hash"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[str, str]]] = {}
        for batch in batches:
            for p, key, h in zip(*(batch.column(k).to_pylist() for k in range(3))):
                mine = held.setdefault(p, [])
                mine.append((key, h))
                if len(mine) > 64:
                    held[p] = [*_outer(mine, True), *_outer(mine, False)]
        rows = [(p, *x) for p, mine in held.items() for x in sorted({*_outer(mine, True), *_outer(mine, False)})]
        yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.string()))], ["p", "key", "hash"])

    # four values a range
    kind = "p int, key string, hash string"
    edges: dict[int, list[tuple[str, str]]] = {}
    if cuts:
        for r in own.mapInArrow(hashed, kind).mapInArrow(ends, kind).repartition("p").mapInArrow(ends, kind).collect():
            edges.setdefault(r["p"], []).append((r["key"], r["hash"]))
    also: dict[tuple[str, str], list[int]] = {}
    for last, order in ((True, range(len(cuts) + 1)), (False, range(len(cuts), -1, -1))):
        carried: list[tuple[str, str]] = []
        for p in order:
            for page in carried:
                also.setdefault(page, []).append(p)
            carried = _outer([*carried, *edges.get(p, ())], last)
    sent = own.sparkSession.sparkContext.broadcast(also)

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                key = _packed(_key(url, page_id))
                lines = "\n".join(text_lines(html))
                row = {"key": key, "hash": _hash(lines), "page_id": page_id, "url": url, "lines": lines}
                rows.append(row | {"p": bisect_right(sent_cuts.value, key), "own": True})
                rows += [row | {"p": p, "own": False} for p in sent.value.get((key, row["hash"]), ())]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("p", pa.int32()), ("key", pa.string()), ("hash", pa.string()), ("own", pa.bool_()), ("page_id", pa.int64()), ("url", pa.string()), ("lines", pa.string())]))

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("neighbour_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int32()), ("n_shared", pa.int32())])

        def one(before, page, after) -> dict:
            lines = page["lines"].split("\n") if page["lines"] else []
            host, path = page["key"].split("\0")[:2]
            found = []
            for place, other in enumerate((before, after)):
                if host and other is not None and page["lines"] and other["p"] == page["p"]:
                    their_host, their_path = other["key"].split("\0")[:2]
                    if their_host == host:
                        near = nearness(path, their_path)
                        found.append((-near[0], -near[1], place, other))
            row = {"page_id": page["page_id"], "url": page["url"], "neighbour_id": None, "text": "\n".join(lines), "n_lines": len(lines), "n_shared": 0}
            if found:
                other = min(found, key=lambda x: x[:3])[3]
                shared = common_lines(lines, other["lines"].split("\n") if other["lines"] else [])
                row |= {"neighbour_id": other["page_id"], "text": "\n".join(x for x, s in zip(lines, shared) if not s), "n_shared": sum(shared)}
            return row

        before, run = None, []  # the last page before the run, and the run
        for batch in batches:
            out = []
            for page in batch.to_pylist():
                if not page["lines"]:
                    if page["own"]:
                        out.append(one(None, page, None))
                    continue
                host = page["key"].partition("\0")[0]
                if run and (run[-1]["p"], run[-1]["key"].partition("\0")[0], run[-1]["lines"]) != (page["p"], host, page["lines"]):
                    out += [one(before, x, page) for x in run if x["own"]]
                    before, run = run[-1], []
                run.append(page | {"lines": run[0]["lines"]} if run else page)
            yield pa.RecordBatch.from_pylist(out, schema)
        yield pa.RecordBatch.from_pylist([one(before, x, None) for x in run if x["own"]], schema)

    laid = own.mapInArrow(lay_out, "p int, key string, hash string, own boolean, page_id bigint, url string, lines string")
    # a task a range: ranges that met in a task by their hash would make it several times as large
    return laid.repartitionById(len(cuts) + 1, "p").sortWithinPartitions("p", "key", "hash").mapInArrow(difference, PAGES)
