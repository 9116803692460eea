"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

Words (lower case, without punctuation) of every document are streamed through the automaton, which tracks at each
word the longest passage ending there that some item holds. A passage is removed from the text, from its
first to its last word, if it has MAX_WORDS words or more, or if it covers at least COVERAGE of an item that holds it
and has LEAST_WORDS words or more, whether or not it lies within a longer passage that meets no limit. Of an item shorter than LEAST_WORDS
all words must be there, and an item of fewer than LEAST_ITEM words, which ordinary language holds everywhere, is passed over. Runs of
words that no item holds are passed over in whole arrays.

The automaton holds the items, not the corpus, and is broadcast; items of more than SHARD_WORDS words together are
split into shards, streamed past one after the other, ROUND of them in a pass over the documents, so that what the driver and the executors
hold at once is bounded whatever the benchmark's size. What is removed doesn't depend on the shards: a passage counts by each item that holds it.

Null text stays null and empty text empty. A null item or one without words is passed over; repeated items count once.
Without items, or documents, nothing changes. Rows are neither lost nor added, repeated rows are treated alike, and all
columns are kept, whatever their names; n_chars, where it is an integer column, follows a changed text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm._automaton import SuffixAutomaton
from docloom.llm._shared import written
from docloom.llm._text import text_slices, word_spans, words_of

MAX_WORDS = 13
COVERAGE = 0.5
LEAST_WORDS = 6
LEAST_ITEM = 3
SHARD_WORDS = 500_000
#: Shards in one pass over the documents; what they found is written before the next.
ROUND = 4


@lru_cache(2)
def _index(shard: tuple[tuple[int, ...], ...], coverage: float, least_words: int) -> tuple[np.ndarray, SuffixAutomaton, list, list, int]:
    """Sorted hashes of the shard's words, and its automaton over their places.

    Of each state, the words that some item which holds its factors wants of a passage, and the words of the longest of its and its suffix links'
    longest factors that has as many (0 if none has); the least that any item wants.
    """
    vocabulary = np.unique(np.array([w for item in shard for w in item], np.uint64))
    items = {i: np.searchsorted(vocabulary, np.array(item, np.uint64)).tolist() for i, item in enumerate(shard)}
    automaton = SuffixAutomaton()
    for i, item in items.items():
        automaton.add(item, i)
    wants = {i: max(ceil(coverage * len(x)), min(least_words, len(x))) for i, x in items.items()}
    want = automaton.least_over_occurrences(wants, items.items())
    best = [0] * len(automaton.link)
    for q in sorted(range(1, len(best)), key=automaton.longest.__getitem__):
        best[q] = automaton.longest[q] if automaton.longest[q] >= want[q] else best[automaton.link[q]]
    return vocabulary, automaton, want, best, min(wants.values())


def found_passages(words: np.ndarray, first: np.ndarray, shard: tuple, max_words: int, coverage: float, least_words: int) -> list[tuple[int, int, int]]:
    """(row, first word, word after the last) of each passage beyond a limit that no other such passage with the same end or start holds."""
    vocabulary, automaton, want, best, least = _index(shard, coverage, least_words)
    place = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    known = vocabulary[place] == words
    shortest = max(1, min(max_words, least))
    edges = np.zeros(len(words) + 2, bool)
    edges[1:-1] = known
    change = np.diff(edges.astype(np.int8))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    inner = first[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(words))])
    inner = inner[edges[inner] & edges[inner + 1]]
    starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    wide = ends - starts >= shortest
    starts, ends = starts[wide], ends[wide]
    rows = np.searchsorted(first, starts, "right") - 1
    out = []
    for row, s, e in zip(rows.tolist(), starts.tolist(), ends.tolist()):
        at, base = s, int(first[row])
        last = 0  # words of the passage that ends at the word before
        for length, state in [*automaton.matches(place[s:e].tolist()), (0, 0)]:
            # the longest passage beyond a limit that ends here: the match itself, or one of the longest factors of its suffix links
            if length >= max_words or (length and length >= want[state]):
                n = length
            else:
                n = best[automaton.link[state]] if length >= shortest else 0
            if last and n != last + 1:
                out.append((row, at - last - base, at - base))
            last = n
            at += 1
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of each span, from the first to the last."""
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts, ends, _ = word_spans(data, offsets)
    parts, at = [], 0
    for s, e in sorted(spans):
        b = int(starts[s])
        if b > at:
            parts.append(text[at:b])
        at = max(at, int(ends[e - 1]))
    return b"".join([*parts, text[at:]])


def benchmark_shards(benchmark: DataFrame, shard_words: int = SHARD_WORDS, least_item: int = LEAST_ITEM) -> Iterator[tuple]:
    """The distinct items' word hashes, in shards of about shard_words words, one after the other: the driver holds one shard at a time."""
    texts = (r[0] for r in benchmark.select(F.col("text").cast("string").alias("text")).where("text is not null").distinct().orderBy("text").toLocalIterator())
    now: dict[tuple[int, ...], None] = {}
    size = 0
    while some := list(islice(texts, 1000)):
        words, first = words_of(pa.array(some, pa.string()))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            item = tuple(words[a:b].tolist())
            if len(item) < max(1, least_item) or item in now:
                continue
            if now and size + len(item) > shard_words:
                yield tuple(now)
                now, size = {}, 0
            now[item] = None
            size += len(item)
    if now:
        yield tuple(now)


def _find_in(batch: pa.RecordBatch, spans: list[list[int]], shard: tuple, max_words: int, coverage: float, least_words: int) -> None:
    """Adds first word and end of each passage of shard to the rows' spans."""
    text_at, base = batch.schema.get_field_index("text"), 0
    for part in text_slices(batch):
        words, first = words_of(part.column(text_at))
        for row, s, e in found_passages(words, first, shard, max_words, coverage, least_words) if len(words) else []:
            spans[base + row] = [*spans[base + row], s, e]
        base += part.num_rows


def _spans_of(batch: pa.RecordBatch) -> list[list[int]]:
    column = batch.column(batch.schema.get_field_index("__dl_spans"))
    return column.to_pylist() if pc.sum(pc.list_value_length(column)).as_py() else [[]] * batch.num_rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS, coverage: float = COVERAGE, least_words: int = LEAST_WORDS, shard_words: int = SHARD_WORDS, flag: str | None = None) -> DataFrame:
    """docs with the passages cut out of text; flag: name of a column to add, the number of words removed."""
    limits = (max_words, coverage, least_words)
    found = docs.withColumn("text", F.col("text").cast("string")).withColumn("__dl_spans", F.array().cast("array<int>"))
    broadcast = docs.sparkSession.sparkContext.broadcast
    waiting, shard = [], ()
    for following in benchmark_shards(benchmark, shard_words):
        if shard:
            waiting.append(broadcast(shard))

            def find(batches: Iterator[pa.RecordBatch], sent=waiting[-1]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    at, spans = batch.schema.get_field_index("__dl_spans"), _spans_of(batch)
                    _find_in(batch, spans, sent.value, *limits)
                    yield batch.set_column(at, batch.schema.field(at), pa.array(spans, batch.schema.field(at).type))

            found = found.mapInArrow(find, found.schema)
            if len(waiting) == ROUND:
                found = written(found, "benchmark-spans")
                for sent in waiting:
                    sent.destroy()
                waiting = []
        shard = following
    count = isinstance(docs.schema["n_chars"].dataType, (T.LongType, T.IntegerType)) if "n_chars" in docs.columns else False
    schema = T.StructType([f for f in found.schema if f.name != "__dl_spans"] + ([T.StructField(flag, T.LongType())] if flag else []))
    last = broadcast(shard)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_at, spans_at = batch.schema.get_field_index("text"), batch.schema.get_field_index("__dl_spans")
            spans = _spans_of(batch)
            if last.value:
                _find_in(batch, spans, last.value, *limits)
            hit = [i for i, x in enumerate(spans) if x]
            out, removed = batch, np.zeros(batch.num_rows, np.int64)
            if hit:
                texts = batch.column(text_at).to_pylist()
                for i in hit:
                    pairs = list(zip(spans[i][::2], spans[i][1::2]))
                    removed[i] = len({w for s, e in pairs for w in range(s, e)})
                    texts[i] = without(texts[i].encode(), pairs).decode()
                new = pa.array(texts, batch.schema.field(text_at).type)
                out = out.set_column(text_at, batch.schema.field(text_at), new)
                if count:
                    at = out.schema.get_field_index("n_chars")
                    kept = pc.if_else(pa.array(removed > 0), pc.utf8_length(new).cast(out.schema.field(at).type), out.column(at))
                    out = out.set_column(at, out.schema.field(at), kept)
            out = out.remove_column(spans_at)
            yield out.append_column(flag, pa.array(removed)) if flag else out

    return found.mapInArrow(cut, schema)
