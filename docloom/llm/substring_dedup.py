"""Repeated passages across documents, removed by suffix automata of reference shards.

A passage of LEAST_WORDS words or more that a document of smaller doc_id has too is removed; its first document keeps it.

Scale decides how texts meet automata. Each document's winnowed anchors (the smallest ANCHOR-word hash of every
LEAST_WORDS-word window) go by hash: any two equal passages of LEAST_WORDS words choose the same anchors, so an anchor that one document alone has
can't lie in a repeated passage. An anchor's shard is the first document that has it. Every document sends
each such shard the stretches within LEAST_WORDS words of the shard's anchors, and no others. A shard's automaton starts with its
first document; the others are streamed past it in order of doc_id for matching statistics, and add to it what was new in them. So every
passage is held against all earlier ones that could equal it. What the automata hold grows with the corpus, so shards are
sent to the task that streams their documents (a shuffle) and not to all executors (a broadcast). A shard of more than SHARD_STRETCHES stretches
(a passage that very many documents share) is cut into parts by hash of document: each part's automaton holds the shard's first document alone, and
what no match with it covers in the others is held against the rest of the shard by hashes of its windows of LEAST_WORDS words, so that neither
memory nor a task nor the work for a document grows with such a passage, and the words found are the same.

Passages within one document don't count, nor between rows of one doc_id and text (repeated rows); different texts of one doc_id
are different documents. Rows with a null doc_id or text are kept as they are and are no reference. Texts of fewer
than LEAST_WORDS words don't change. An empty table gives an empty table. Result: doc_id, text, removed_words, passages (first word, end, doc_id
of the earlier document) of every row; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.llm._automaton import SuffixAutomaton
from docloom.llm._shared import drop_written, null_safe_columns, written
from docloom.llm._text import ngram_hashes, text_slices, words_of
from docloom.llm.decontaminate import without

LEAST_WORDS = 50
ANCHOR = 12
#: Stretches whose novelties one automaton holds at most.
SHARD_STRETCHES = 5000
#: Windows looked at together; their places take _PLACE_BITS bits.
PIECE = 1 << 22
_PLACE_BITS = np.uint64(24)
_FOUND = "doc_id bigint, text_hash bigint, start int, end int, earlier bigint, shard_id bigint, shard_hash bigint, window bigint"


def anchors(words: np.ndarray, first: np.ndarray, least: int, size: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and hash of each anchor. Texts of any length: piece windows at a time, whose words overlap by least - 1."""
    width, mask = least - size + 1, (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for begin in range(0, len(words) - least + 1, piece):
        grams = ngram_hashes(words[begin : begin + piece + least - 1], size)
        low = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        reach = 1
        while 2 * reach <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        rest = width - reach
        low = np.minimum(low[: len(low) - rest], low[rest:])
        start = np.arange(begin, begin + len(low))
        at = np.unique(low[start + least <= first[1:][row[start]]] & mask).astype(np.int64)
        places.append(at + begin)
        hashes.append(grams[at])
    at, once = np.unique(np.concatenate(places), return_index=True)
    rows = np.searchsorted(first, at, "right") - 1
    return rows, at - first[rows], np.concatenate(hashes)[once]


def _stretches(places: list[int], shards: list[tuple[int, int]], n: int, least: int, size: int) -> Iterator[tuple[tuple[int, int], int, int]]:
    """Each shard's merged stretches of a document of n words."""
    by: dict[tuple[int, int], list[list[int]]] = {}
    for place, shard in sorted(zip(places, shards)):
        begin, end = max(0, place - least), min(n, place + size + least)
        own = by.setdefault(shard, [])
        if own and begin <= own[-1][1]:
            own[-1][1] = end
        else:
            own.append([begin, end])
    for shard, spans in by.items():
        for begin, end in spans:
            if end - begin >= least:
                yield shard, begin, end


class _Shard:
    """A shard's automaton and what it has seen."""

    def __init__(self, least: int) -> None:
        self.least, self.automaton, self.seen = least, SuffixAutomaton(), {}

    def document(self, doc: tuple, stretches: list[tuple[int, bytes]], adds: bool = True) -> tuple[list[tuple[int, int, int]], list[tuple[int, list[int]]]]:
        """(first word, end, earlier doc_id) of the document's repeated passages, and first word and words of what was new; adds: takes that in."""
        out, new, own = [], [], set()
        for start, data in stretches:
            before = self.seen.get(data)
            n = len(data) // 4
            if before is not None:  # the very same stretch: all of it is there
                out.append((start, start + n, before[0]))
                continue
            tokens = np.frombuffer(data, "<u4").tolist()
            spans = [(s, e, self.automaton.mark[q]) for s, e, q in self.long_matches(tokens)]
            out += [(start + s, start + e, mark[0]) for s, e, mark in spans]
            own.add(data)
            at = 0
            for s, e in [*((s, e) for s, e, _ in spans), (n + 1, n)]:
                # windows of least words that lie in no match, the one before included where matches overlap by less
                begin, end = max(0, at - self.least + 1), min(n, s + self.least - 1)
                if end - begin >= self.least:
                    new.append((start + begin, tokens[begin:end]))
                at = max(at, e)
        if adds:
            for _, tokens in new:
                self.automaton.add(tokens, doc)
            for data in own:
                self.seen[data] = doc
        return out, new

    def long_matches(self, tokens: list[int]) -> list[tuple[int, int, int]]:
        """Maximal matches of least tokens or more: start, end, state."""
        nxt, link, longest, least = self.automaton.next, self.automaton.link, self.automaton.longest, self.least
        out, state, length = [], 0, 0
        for i, token in enumerate(tokens):
            to = nxt[state].get(token)
            if to is None:
                if length >= least:
                    out.append((i - length, i, state))
                while state and to is None:
                    state = link[state]
                    to = nxt[state].get(token)
                length = longest[state]
                if to is None:
                    length = 0
                    continue
            state = to
            length += 1
        if length >= least:
            out.append((len(tokens) - length, len(tokens), state))
        return out


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, anchor: int = ANCHOR, shard_stretches: int = SHARD_STRETCHES) -> DataFrame:
    """doc_id, text_hash, start, end (words) and earlier (doc_id) of each repeated passage; passages may overlap."""
    own = null_safe_columns(docs, {"doc_id": "bigint", "text": "string"}).where("doc_id is not null and text is not null").withColumn("text_hash", F.xxhash64("text"))
    anchor = min(anchor, least_words)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                rows, places, hashes = anchors(*words_of(part.column(1)), least_words, anchor)
                yield pa.record_batch([part.column(0).take(pa.array(rows)), part.column(2).take(pa.array(rows)), pa.array(places.astype(np.int32)), pa.array(hashes.view(np.int64))], ["doc_id", "text_hash", "place", "anchor"])

    marks = written(own.mapInArrow(mark, "doc_id bigint, text_hash bigint, place int, anchor bigint"), "anchors")
    doc = F.struct("doc_id", "text_hash")
    # partial sums and a join, which can be split where an anchor is in very many documents
    by_anchor = marks.groupBy("anchor").agg(F.min(doc).alias("shard"), F.max(doc).alias("last")).where("shard != last").select("anchor", "shard")
    shared = marks.join(by_anchor.hint("merge"), "anchor")
    lists = shared.groupBy("doc_id", "text_hash").agg(F.collect_list("place").alias("places"), F.collect_list("shard").alias("shards"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = ["shard_id", "shard_hash", "doc_id", "text_hash", "start", "words"]
        for batch in batches:
            for part in text_slices(batch):
                words, first = words_of(part.column(1))
                words = (words >> np.uint64(32)).astype("<u4")
                out: list[list] = [[] for _ in names]
                for i, (doc_id, text_hash, places, shards) in enumerate(zip(*(part.column(k).to_pylist() for k in (0, 2, 3, 4)))):
                    text = words[first[i] : first[i + 1]]
                    for shard, begin, end in _stretches(places, [tuple(s.values()) for s in shards], len(text), least_words, anchor):
                        for column, value in zip(out, (*shard, doc_id, text_hash, begin, text[begin:end].tobytes())):
                            column.append(value)
                yield pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds)], names)

    joined = own.join(lists, ["doc_id", "text_hash"]).select("doc_id", "text", "text_hash", "places", "shards")
    keys = ["shard_id", "shard_hash"]
    sent = written(joined.mapInArrow(send, "shard_id bigint, shard_hash bigint, doc_id bigint, text_hash bigint, start int, words binary"), "stretches")
    drop_written(marks)
    large = sent.groupBy(*keys).count().where(F.col("count") > shard_stretches).select(*keys, F.ceil(F.col("count") / shard_stretches).cast("int").alias("parts"))
    head = (F.col("doc_id") == F.col("shard_id")) & (F.col("text_hash") == F.col("shard_hash"))
    part = F.when(F.col("parts").isNull(), F.array(F.lit(-1))).when(head, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("parts")).cast("int")))
    parted = sent.join(large, keys, "left").withColumn("adds", F.col("parts").isNull() | head).withColumn("part", F.explode(part))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, doc, adds, stretches = None, None, True, []
        shard = _Shard(least_words)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in _FOUND.split(", ")]
        out: list[list] = [[] for _ in names]

        def put(*row) -> None:
            for column, value in zip(out, row):
                column.append(value)

        def finish() -> None:
            if doc is None:
                return
            spans, new = shard.document(doc, stretches, adds)
            for s, e, earlier in spans:
                put(*doc, s, e, earlier, None, None, None)
            if not adds:
                for start, tokens in new:
                    for i, window in enumerate(ngram_hashes(np.array(tokens, np.uint64), least_words).view(np.int64).tolist()):
                        put(*doc, start + i, start + i + least_words, None, *now[:2], window)

        def flushed() -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds)], names)

        for batch in batches:
            for shard_id, shard_hash, part, doc_id, text_hash, start, data, takes in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if (doc_id, text_hash) != doc or (shard_id, shard_hash, part) != now:
                    finish()
                    doc, adds, stretches = (doc_id, text_hash), takes, []
                    if (shard_id, shard_hash, part) != now:
                        now, shard = (shard_id, shard_hash, part), _Shard(least_words)
                if not stretches or stretches[-1][0] != start:  # else a repeated row
                    stretches.append((start, data))
            if len(out[0]) > 100_000:
                yield flushed()
                out = [[] for _ in names]
        finish()
        yield flushed()

    order = [*keys, "part", "doc_id", "text_hash", "start"]
    by_shard = parted.select(*order, "words", "adds").repartition(*keys, "part").sortWithinPartitions(*order)
    found = written(by_shard.mapInArrow(stream, _FOUND), "passages")
    drop_written(sent)

    # of very large shards: windows that aren't the first document's, against those of the others
    left, window = found.where("earlier is null"), [*keys, "window"]
    seen = left.groupBy(*window).agg(F.min(doc).alias("first"), F.max(doc).alias("last")).where("first != last").select(*window, "first")
    again = left.join(seen.hint("merge"), window).where(doc != F.col("first")).select("doc_id", "text_hash", "start", "end", F.col("first.doc_id").alias("earlier")).distinct()
    own = ["doc_id", "text_hash", "earlier"]
    again = again.withColumn("run", F.col("start") - F.row_number().over(W.partitionBy(*own).orderBy("start")))  # windows one after the other
    again = again.groupBy(*own, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")
    return found.where("earlier is not null").select(*again.columns).unionByName(again)


def deduplicate_passages(docs: DataFrame, least_words: int = LEAST_WORDS, anchor: int = ANCHOR, shard_stretches: int = SHARD_STRETCHES) -> DataFrame:
    """Every row's text without its repeated passages; see the module."""
    spans = repeated_passages(docs, least_words, anchor, shard_stretches)
    grouped = spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "end", "earlier"))).alias("passages"))
    own = null_safe_columns(docs, {"doc_id": "bigint", "text": "string"}).withColumn("text_hash", F.xxhash64("text"))
    joined = own.join(grouped, ["doc_id", "text_hash"], "left").select("doc_id", "text", F.coalesce("passages", F.array().cast("array<struct<start:int,end:int,earlier:bigint>>")).alias("passages"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2).to_pylist()
            texts, removed = batch.column(1), np.zeros(batch.num_rows, np.int64)
            if any(spans):
                texts = texts.to_pylist()
                for i, own in enumerate(spans):
                    if own:
                        pairs = [(s["start"], s["end"]) for s in own]
                        texts[i] = without(texts[i].encode(), pairs).decode()
                        at = 0
                        for s, e in pairs:
                            removed[i] += max(0, e - max(s, at))
                            at = max(at, e)
                texts = pa.array(texts, pa.string())
            yield pa.record_batch([batch.column(0), texts, pa.array(removed), batch.column(2)], ["doc_id", "text", "removed_words", "passages"])

    return joined.mapInArrow(cut, "doc_id bigint, text string, removed_words bigint, passages array<struct<start:int,end:int,earlier:bigint>>")
