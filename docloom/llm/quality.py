"""Quality rules with thresholds that follow each language and source.

The measures of a text are computed by whole Arrow batches, once, and written beside the documents. They are summarised, for every (lang,
source), in quantile sketches with relative-error buckets: how often ceil(ln(1 + 1000 x) / ln gamma) takes each value. Sketches merge
by adding counts: partial sums are made before the shuffle, and the result is the same in any order. A rule's limits are Tukey fences,
Q3 + FENCE * (Q3 - Q1 + slack) and, for the rules of LOWER, Q1 - FENCE * (Q3 - Q1 + slack), in place of fixed cutoffs; the slack is the
rule's least spread, on which alone a fence rests where the quartiles agree (most texts have no symbols, say; a higher quantile
would lie among the rejects of a corpus that holds a tenth of them). A group's fence is blended with its language's, and that with the table's,
by the number of texts: n / (n + PRIOR) of the own one, so that a few texts can't set a limit, at every size alike.
The limits, one row a group, are joined to the measured documents.

A text that is null or has no words is rejected. A null lang or source is a group of its own. Repeated rows are kept
or rejected alike. An empty table gives an empty table. All columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, StructField, StructType

from docloom.llm._shared import written
from docloom.llm._text import raw_bytes, text_slices, word_hashes, word_spans

GAMMA = 1.02
FENCE = 3.0
PRIOR = 200
#: measure: least spread, in its own unit
RULES = {"symbol_share": 0.01, "upper_share": 0.1, "mean_word": 0.6, "repeated_lines": 0.12, "repeated_words": 0.04}
LOWER = ("mean_word",)
_NOT_SYMBOLS = r"[^#$%&*|~^<>{}=+!@]+"
_NOT_UPPER = r"[^\p{Lu}]+"
_NOT_LETTERS = r"[^\p{L}]+"
_BLANK = r"[ \t\n\r]+"


def _table(characters: str, inside: bool = True) -> np.ndarray:
    out = np.full(256, 0 if inside else 1, np.uint8)
    out[list(characters.encode())] = 1 if inside else 0
    return out


_SYMBOL, _CAPITAL = _table("#$%&*|~^<>{}=+!@"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _CAPITAL | _table("abcdefghijklmnopqrstuvwxyz")
_VISIBLE, _LINE = _table(" \t\n\r", False), _table("\n", False)
_INNER = np.zeros(256, np.uint8)
_INNER[0x80:0xC0] = 1  # bytes of a character after its first


@lru_cache(1)
def _letters() -> np.ndarray:
    """Of each code point: 2 for a capital, 1 for another letter."""
    kinds = [unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1)]
    return np.array([(k[0] == "L") + (k == "Lu") for k in kinds], np.uint8)


def _cased(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At the first byte of each character, whether it is a capital and whether it is a letter."""
    if not (data & 0x80).any():
        return _CAPITAL[data] != 0, _LETTER[data] != 0
    kind = np.zeros(len(data), np.uint8)
    kind[first] = _letters()[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
    return kind == 2, kind > 0


def measures(text: pa.Array) -> dict[str, np.ndarray]:
    """The measures of RULES, 0 where they have nothing to measure; mean_word is nan without words or text."""
    data, offsets = raw_bytes(text.cast(pa.large_string()))

    def total(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.where(whole > 0, part / np.maximum(whole, 1), 0.0)

    first = _INNER[data] == 0
    capital, letter = _cased(data, first)
    starts, ends, at = word_spans(data, offsets, _VISIBLE)
    n = np.diff(at)
    hashes = word_hashes(data, starts, ends)
    same = np.zeros(len(starts) + 1, np.int64)
    if len(starts):
        row = np.repeat(np.arange(len(n)), n)
        np.cumsum((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]), out=same[2:])
    begin, end, line_at = word_spans(data, offsets, _LINE)
    lines = np.diff(line_at)
    row = np.repeat(np.arange(len(lines)), lines)
    hashes = word_hashes(data, begin, end)
    order = np.lexsort([hashes, row])
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    distinct = np.bincount(row[order][new], minlength=len(lines))
    visible = total(first & (_VISIBLE[data] != 0))
    return {
        "symbol_share": share(total(_SYMBOL[data]), total(first)),
        "upper_share": share(total(capital), total(letter)),
        "mean_word": np.where(n > 0, visible / np.maximum(n, 1), np.nan),
        "repeated_lines": share(lines - distinct, lines),
        "repeated_words": share(same[at[1:]] - same[at[:-1]], n),
    }


def with_measures(docs: DataFrame) -> DataFrame:
    """docs and, for each rule, column __dl_<rule>; null where it can't be measured."""
    schema = StructType([*docs.schema.fields, *[StructField(f"__dl_{r}", DoubleType()) for r in RULES]])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                for rule, values in measures(part.column(part.schema.get_field_index("text"))).items():
                    part = part.append_column(f"__dl_{rule}", pa.array(values, mask=np.isnan(values)))
                yield part

    return docs.mapInArrow(measure, schema)


def bucket(x: Column) -> Column:
    return F.ceil(F.log(1 + 1000 * x) / F.log(F.lit(GAMMA))).cast("int")


def middle(b: Column) -> Column:
    """A bucket's value."""
    return F.when(b <= 0, F.lit(0.0)).otherwise((2 * F.pow(F.lit(GAMMA), b) / (1 + GAMMA) - 1) / 1000)


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: the sketches of all groups of with_measures()'s rows."""
    lang, source = (F.col(c).cast("string").alias(c) if c in measured.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source"))
    values = measured.where("__dl_mean_word is not null").select(lang, source, F.posexplode(F.array(*[f"__dl_{r}" for r in RULES])).alias("rule", "x"))
    return values.groupBy("lang", "source", "rule", bucket(F.col("x")).alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(merged: DataFrame, keys: list[str]) -> DataFrame:
    """Q1, Q3 and count of each rule and each group of keys, from sketches merged over the other columns."""
    sums = merged.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    by = W.partitionBy(*keys, "rule")
    upto = sums.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("whole", F.sum("n").over(by))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("whole") * q), F.col("bucket")))
    return upto.groupBy(*keys, "rule").agg(middle(at(0.25)).alias("q1"), middle(at(0.75)).alias("q3"), F.max("whole").alias("whole"))


def limits(measured: DataFrame) -> DataFrame:
    """lang, source, rule (its place in RULES), lower and upper limit, of every group."""
    own = written(sketches(measured), "quality-sketches")
    reach = FENCE * (F.col("q3") - F.col("q1") + F.element_at(F.array(*[F.lit(float(s)) for s in RULES.values()]), F.col("rule") + 1))
    fences = lambda keys: quartiles(own, keys).withColumns({"least": F.col("q1") - reach, "most": F.col("q3") + reach}).drop("q1", "q3")
    group, lang, table = (fences(keys) for keys in (["lang", "source"], ["lang"], []))
    lang = lang.select(F.col("lang").alias("l"), F.col("rule").alias("r"), *[F.col(c).alias(f"{c}_lang") for c in ("least", "most", "whole")])
    table = table.select(F.col("rule").alias("t"), *[F.col(c).alias(f"{c}_table") for c in ("least", "most")])
    both = group.join(lang, group["lang"].eqNullSafe(lang["l"]) & (group["rule"] == lang["r"])).join(table, F.col("rule") == F.col("t"))
    blend = lambda n, x, y: (n * x + PRIOR * y) / (n + PRIOR)
    out = [blend(F.col("whole"), F.col(c), blend(F.col("whole_lang"), F.col(f"{c}_lang"), F.col(f"{c}_table"))).alias(c) for c in ("least", "most")]
    return both.select("lang", "source", "rule", *out)


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that break no rule; see the module."""
    measured = written(with_measures(docs), "quality-measures")
    rows = limits(measured).groupBy("lang", "source").pivot("rule", list(range(len(RULES)))).agg(F.first("least").alias("least"), F.first("most").alias("most"))
    bounds = [F.col(f"{i}_{c}").alias(f"__dl_{c}_{r}") for i, r in enumerate(RULES) for c in ("least", "most")]
    rows = written(rows.select(F.col("lang").alias("__dl_lang"), F.col("source").alias("__dl_source"), *bounds), "quality-limits")
    within = reduce(and_, [F.col(f"__dl_{r}") <= F.col(f"__dl_most_{r}") for r in RULES] + [F.col(f"__dl_{r}") >= F.col(f"__dl_least_{r}") for r in LOWER])
    for name in ("lang", "source"):
        own = F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")
        within = within & own.eqNullSafe(F.col(f"__dl_{name}"))
    return measured.join(rows, within, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def _duck_measures() -> str:
    words = "list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> '')"
    lines = "list_filter(string_split(text, chr(10)), lambda w: w <> '')"
    left = lambda p: f"length(regexp_replace(text, '{p}', '', 'g'))"
    return f"""select *, coalesce({left(_NOT_SYMBOLS)} / nullif(length(text), 0), 0) symbol_share,
        coalesce({left(_NOT_UPPER)} / nullif({left(_NOT_LETTERS)}, 0), 0) upper_share,
        {left("[ \\t\\n\\r]+")} / nullif(len(words), 0) mean_word,
        coalesce((len(lines) - len(list_distinct(lines))) / nullif(len(lines), 0), 0) repeated_lines,
        coalesce(len(list_filter(list_zip(words, words[2:]), lambda p: p[1] = p[2])) / nullif(len(words), 0), 0) repeated_words
        from (select *, {words} words, {lines} lines from documents)"""


def oracle(columns: str = "*") -> str:
    """DuckDB SQL for filter_quality(documents)."""
    each = " union all ".join(f"select lang, source, {i} rule, {float(s)} slack, cast(ceil(ln(1 + 1000 * {r}) / ln({GAMMA})) as int) bucket from measured where mean_word is not null" for i, (r, s) in enumerate(RULES.items()))

    def level(keys: list[str]) -> str:
        k = "".join(f"{x}, " for x in keys)
        value = lambda q: f"min(case when upto >= ceil(whole * {q}) then bucket end)"
        middle_of = lambda b: f"case when {b} <= 0 then 0 else (2 * pow({GAMMA}, {b}) / {1 + GAMMA} - 1) / 1000 end"
        return f"""(select {k} rule, whole, q1 - {FENCE} * (q3 - q1 + slack) least_, q3 + {FENCE} * (q3 - q1 + slack) most_ from (select {k} rule, slack, max(whole) whole, {middle_of(value(0.25))} q1, {middle_of(value(0.75))} q3 from
            (select *, sum(n) over (partition by {k} rule order by bucket) upto, sum(n) over (partition by {k} rule) whole from
            (select {k} rule, slack, bucket, count(*) n from values_ group by all)) group by {k} rule, slack))"""

    mixed = lambda c: f"(g.whole * g.{c} + {PRIOR} * ((l.whole * l.{c} + {PRIOR} * t.{c}) / (l.whole + {PRIOR}))) / (g.whole + {PRIOR}) {c}"
    limit = lambda i, c: f"(select {c} from limits_ x where x.rule = {i} and x.lang is not distinct from m.lang and x.source is not distinct from m.source)"
    rules = " and ".join([f"{r} <= {limit(i, 'most_')}" for i, r in enumerate(RULES)] + [f"{r} >= {limit(i, 'least_')}" for i, r in enumerate(RULES) if r in LOWER])
    return f"""with measured as materialized ({_duck_measures()}), values_ as materialized ({each}),
        limits_ as materialized (select g.lang, g.source, g.rule, {mixed("least_")}, {mixed("most_")}
            from {level(["lang", "source"])} g join {level(["lang"])} l on g.lang is not distinct from l.lang and g.rule = l.rule join {level([])} t on g.rule = t.rule)
        select {columns} from measured m where mean_word is not null and {rules}"""
