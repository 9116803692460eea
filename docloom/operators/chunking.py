"""Chunking of plain text by folds inside each row: no shuffle, no Python.

Every operator takes a DataFrame with a text column and adds ``chunks``, an array of structs, or explodes it.
Offsets count characters from 0 and ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.conf import ChunkConfig

SPANS = "array<struct<start:int,end:int>>"
_PIECES = "array<array<string>>"


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _spans(text: Column, config: ChunkConfig, end_of, most_rounds: Column, next_of=None) -> Column:
    """Folds (start, spans so far) until the text is used up. The next span starts overlap before an end, or at it if that would be no progress."""
    n = F.length(text)
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(most_rounds).cast("int") + 2))

    next_of = next_of or (lambda s, e, n: F.when((e < n) & (e - config.overlap > s), e - config.overlap).otherwise(e))
    start = F.struct(F.lit(0).alias("s"), F.array().cast(SPANS).alias("out"))

    def step(state, _):
        s = state["s"]
        more = lambda e: F.struct(next_of(s, e, n).alias("s"), F.concat(state["out"], F.array(F.struct(s.alias("start"), e.alias("end")))).alias("out"))
        return F.when(s >= n, state).otherwise(_let(end_of(s, n), more))

    return F.aggregate(rounds, start, step, lambda state: state["out"])


def fixed_spans(text: Column, config: ChunkConfig) -> Column:
    """Windows of max_size with overlap; with config.sentences a window ends after the last sentence end of its last 100 characters."""

    def end_of(s, n):
        e = F.least(s + config.max_size, n)
        if not config.sentences:
            return e

        def cut(end):
            begin = F.greatest(s + config.min_size, end - 100)
            tail = F.reverse(F.substring(text, begin + 1, F.greatest(F.lit(0), end - begin)))
            at = F.regexp_instr(tail, F.lit(r"[ \n][.!?]"))
            return F.when((end < n) & (at > 0), end - at).otherwise(end)

        return _let(e, cut)

    step = max(config.min_size, config.max_size - 100) - config.overlap if config.sentences else config.max_size - config.overlap

    def next_of(s, e, n):  # here the last window overlaps too: its tail is a span of its own
        return F.when(e - config.overlap > s, e - config.overlap).otherwise(e)

    return _spans(text, config, end_of, F.length(text) / max(1, step), next_of)


def text_spans(text: Column, config: ChunkConfig) -> Column:
    """Spans of normalised text that end at a sentence, else a word; too short ones are extended; overlap without end."""

    def cut(s, e, n):
        part = F.substring(text, s + 1, e - s)
        last = F.length(F.regexp_extract(part, r"(?s)^(.*(?:" + config.sentence_regex + r"))", 1))
        blank = F.locate(" ", F.reverse(part))
        final = F.substring(text, e, 1)
        word = F.when(e >= n, n).when(~final.rlike(r"(?U)\w") | (final == "_"), e).when(blank > 0, e - blank + 1).otherwise(e)
        return F.when(last > 0, s + last).otherwise(word) if config.sentences else word

    def end_of(s, n):
        def extend(e):
            return F.when((e - s < config.min_size) & (e < n), cut(s, F.least(s + config.min_size, n), n)).otherwise(e)

        return _let(F.when(s + config.max_size < n, cut(s, s + config.max_size, n)).otherwise(n), extend)

    # a sentence end closes two spans at most; the others end at words, near max_size
    ends = F.regexp_count(text, F.lit(config.sentence_regex)) if config.sentences else F.lit(0)
    return _spans(text, config, end_of, 2 * ends + 2 * F.length(text) / max(1, config.max_size // 2 - config.overlap))


def normalised(text: Column) -> Column:
    """Single blanks, and a full stop where no sentence ends; null where there is too little text."""
    one = F.regexp_replace(text, r"(?U)\s+", " ")
    ended = F.when(F.substring(one, -1, 1).isin(".", "!", "?"), one).otherwise(F.concat(one, F.lit(".")))
    return F.when(F.length(F.trim(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))) >= 50, F.trim(ended))


def grouped(pieces: Column, limit: int, extra: int, overlap: int = 0) -> Column:
    """Greedy groups of pieces; each piece counts its length and extra. overlap: keep the shortest suffix of that length."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("cur"), F.lit(0).alias("size"), F.array().cast(_PIECES).alias("out"))

    def suffix(cur):
        """The shortest suffix whose length is overlap or more (all, if none), and its length."""
        none = F.struct(empty.alias("cur"), F.lit(0).alias("size"))
        return F.aggregate(F.reverse(cur), none, lambda a, p: F.when(a["size"] >= overlap, a).otherwise(F.struct(F.concat(F.array(p), a["cur"]).alias("cur"), (a["size"] + F.length(p)).alias("size"))))

    def step(state, piece):
        full = (state["size"] + F.length(piece) > limit) & (F.size(state["cur"]) > 0)
        kept = suffix(state["cur"]) if overlap > 0 else F.struct(empty.alias("cur"), F.lit(0).alias("size"))
        add = lambda cur, size, out: F.struct(F.concat(cur, F.array(piece)).alias("cur"), (size + F.length(piece) + extra).alias("size"), out.alias("out"))
        return F.when(full, _let(kept, lambda k: add(k["cur"], k["size"], F.concat(state["out"], F.array(state["cur"]))))).otherwise(add(state["cur"], state["size"], state["out"]))

    return F.aggregate(pieces, start, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]))


def sentences(text: Column, config: ChunkConfig, mode: str = "clean") -> Column:
    """Sentences of text. paired: parts between sentence ends, two by two and without what ends them, as an older splitter has it."""
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    if mode == "clean":
        return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda x: x != "")

    def pairs(parts):
        some = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - F.size(parts) % 2 - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
        two = F.transform(some, lambda i: strip(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))))
        last = strip(F.element_at(parts, -1))
        return F.concat(two, F.when((F.size(parts) % 2 == 1) & (last != ""), F.array(last)).otherwise(F.array().cast("array<string>")))

    return _let(F.split(text, config.sentence_regex), pairs)


def paragraphs(text: Column, splitter: str) -> Column:
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    import re

    return F.filter(F.transform(F.split(text, re.escape(splitter)), strip), lambda p: p != "")


def joined_chunks(groups: Column, joiner: str, header: Column | None = None) -> Column:
    """Groups as structs of content, start and end; start runs over the chunks' lengths."""
    content = F.transform(groups, lambda g: F.concat(header, F.array_join(g, joiner)) if header is not None else F.array_join(g, joiner))

    def placed(contents):
        sizes = F.transform(contents, F.length)
        ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda out, n: F.concat(out, F.array(n + F.coalesce(F.get(out, F.size(out) - 1), F.lit(0)))))
        cut = lambda e: F.transform(contents, lambda c, i: F.struct(c.alias("content"), (F.get(e, i) - F.length(c)).alias("start"), F.get(e, i).alias("end")))
        return _let(ends, cut)

    return _let(content, placed)


def span_chunks(text: Column, spans: Column, header: Column | None = None) -> Column:
    cut = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    return F.transform(spans, lambda s: F.struct((F.concat(header, cut(s)) if header is not None else cut(s)).alias("content"), s["start"].alias("start"), s["end"].alias("end")))


def is_heading(paragraph: Column) -> Column:
    return paragraph.rlike(r"^#+\s+.+") | paragraph.rlike(r"^\d+\.[\d.]*\s+.+")


def heading_groups(pieces: Column, config: ChunkConfig) -> Column:
    """Groups of paragraphs; each counts its length and 2, and a group starts with the last paragraph of the one before (without the 2)."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("cur"), F.lit(0).alias("size"), F.array().cast(_PIECES).alias("out"))

    def step(state, p):
        full = (state["size"] + F.length(p) > config.max_size) & (F.size(state["cur"]) > 0)
        last = F.element_at(state["cur"], -1)
        seed, size = (F.array(last), F.length(last)) if config.overlap > 0 else (empty, F.lit(0))
        add = lambda cur, n, out: F.struct(F.concat(cur, F.array(p)).alias("cur"), (n + F.length(p) + 2).alias("size"), out.alias("out"))
        return F.when(full, add(seed, size, F.concat(state["out"], F.array(state["cur"])))).otherwise(add(state["cur"], state["size"], state["out"]))

    return F.aggregate(pieces, start, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]))


def section_header(section_id: Column, title: Column) -> Column:
    return F.concat(F.lit("[Section "), section_id, F.lit(": "), title, F.lit("]\n\n"))


_CHUNKS = "array<struct<content:string,start:int,end:int>>"


def _sentence_based(text: Column, config: ChunkConfig, header: Column | None, mode: str) -> Column:
    return joined_chunks(grouped(sentences(text, config, mode), config.max_size, 0, config.overlap), " ", header)


def _paragraph_based(text: Column, config: ChunkConfig, header: Column | None, mode: str) -> Column:
    return joined_chunks(grouped(paragraphs(text, config.paragraph), config.max_size, len(config.paragraph)), config.paragraph, header)


#: Strategies by name: (text, config, header, mode) -> array of structs of content, start and end; a user's own go here too.
STRATEGIES: dict[str, Callable[[Column, ChunkConfig, Column | None, str], Column]] = {
    "fixed_size": lambda text, config, header, mode: span_chunks(text, fixed_spans(text, config), header),
    "sentence_based": _sentence_based,
    "paragraph_based": _paragraph_based,
    "text": lambda text, config, header, mode: _let(normalised(text), lambda t: F.when(t.isNotNull(), span_chunks(t, text_spans(t, config), header))),
    "advanced_text": lambda text, config, header, mode: joined_chunks(heading_groups(paragraphs(text, "\n\n"), config), "\n\n", header),
}


def chunk_array(text: Column, kind: str, config: ChunkConfig, header: Column | None = None, mode: str = "clean") -> Column:
    """chunks of text by the named strategy; empty for null or empty text."""
    if kind not in STRATEGIES:
        raise ValueError(f"no strategy {kind!r}; there are {', '.join(STRATEGIES)} (for sections see docloom.operators.section_chunks)")
    none = F.array().cast(_CHUNKS)
    return F.when(F.length(text) > 0, F.coalesce(STRATEGIES[kind](text, config, header, mode), none)).otherwise(none)


def chunk_documents(df: DataFrame, text: str = "text", kind: str = "paragraph_based", config: ChunkConfig = ChunkConfig(), header: Column | None = None, mode: str = "clean") -> DataFrame:
    """df's other columns, chunk_index, total_chunks, content, start_char, end_char, char_count and word_count."""
    from docloom.functions.text import word_count

    rest = [c for c in df.columns if c != text]
    with_chunks = df.select(*rest, chunk_array(F.col(text), kind, config, header, mode).alias("__chunks"))
    exploded = with_chunks.select(*rest, F.size("__chunks").alias("total_chunks"), F.posexplode("__chunks").alias("chunk_index", "c"))
    return exploded.select(*rest, "chunk_index", "total_chunks", F.col("c.content").alias("content"), F.col("c.start").alias("start_char"), F.col("c.end").alias("end_char"), F.length("c.content").alias("char_count"), word_count(F.col("c.content")).alias("word_count"))


def chunk_id(source: Column, section: Column, index: Column, content: Column) -> Column:
    return F.md5(F.concat_ws("_", source, section, index, F.substring(content, 1, 50)).cast("binary"))


def context_string(source: Column, path: Column, language: Column) -> Column:
    return F.concat_ws(" | ", F.concat(F.lit("Source: "), source), F.concat(F.lit("Section: "), path), F.when(F.length(language) > 0, F.concat(F.lit("Language: "), language)))


def with_overlaps(chunks: DataFrame, *keys: str) -> DataFrame:
    """Characters that each chunk shares with the one before and the one after."""
    order = W.partitionBy(*keys).orderBy("chunk_index")
    before = F.greatest(F.lit(0), F.lag("end_char").over(order) - F.col("start_char"))
    after = F.greatest(F.lit(0), F.col("end_char") - F.lead("start_char").over(order))
    return chunks.withColumn("overlap_previous", F.coalesce(before, F.lit(0))).withColumn("overlap_next", F.coalesce(after, F.lit(0)))

