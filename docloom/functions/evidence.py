"""Scores of markup patterns as Spark columns."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import conf
from docloom.functions.text import _flag, any_hit, hits


def type_score(value: Column) -> Column:
    low = F.lower(value)
    return F.greatest(*[F.least(F.lit(1.0), 0.2 * hits(low, words.split())) for words in conf.EVIDENCE_TYPES.values()])


def sample_score(sample: Column) -> Column:
    low = F.lower(sample)
    shapes = reduce(add, [_flag(low.rlike(p)) for p in conf.EVIDENCE_SHAPES])
    return F.coalesce(F.least(F.lit(1.0), 0.15 * hits(low, conf.EVIDENCE_WORDS) + 0.1 * hits(low, conf.EVIDENCE_SIGNS) + 0.2 * shapes), F.lit(0.0))


def structure_score(frequency: Column, mean_length: Column) -> Column:
    balance = F.when(frequency.between(10, 1000), 0.5).when(frequency.between(5, 2000), 0.3).otherwise(0.1)
    return balance + F.when(mean_length.between(50, 500), 0.3).when(mean_length > 20, 0.2).otherwise(0.0)


def evidence_score(value: Column, frequency: Column, sample: Column, mean_length: Column) -> Column:
    total = F.least(F.lit(0.3), 0.1 * (frequency / 100)) + 0.4 * type_score(value) + 0.2 * sample_score(sample) + 0.1 * structure_score(frequency, mean_length)
    return F.least(F.lit(1.0), total)


def suggested_type(value: Column, sample: Column, evidence: Column) -> Column:
    low, text, out = F.lower(value), F.lower(F.coalesce(sample, F.lit(""))), None
    for name, words in conf.SUGGEST_BY_VALUE:
        out = F.when(any_hit(low, words.split()), name) if out is None else out.when(any_hit(low, words.split()), name)
    code = any_hit(text, conf.SUGGEST_BY_SAMPLE) | F.startswith(text, F.lit("$ ")) | F.contains(text, F.lit("#!/bin/bash"))
    return out.when(code, "code_content").when(evidence > 0.7, "documentation_text").otherwise("unknown")


def high_value(pattern: Column, frequency: Column) -> Column:
    return (frequency >= 10) | any_hit(F.lower(pattern), conf.HIGH_VALUE.split()) | F.startswith(pattern, F.lit("attr_data-"))


def tier(pattern: Column, frequency: Column) -> Column:
    return F.when(high_value(pattern, frequency), "high").when(frequency >= 3, "medium").otherwise("low")


def change_note(old_frequency: Column, frequency: Column, old_evidence: Column, evidence: Column) -> Column:
    """What has changed much since the review; empty if nothing."""
    by = F.when((old_frequency > 0) & (F.abs(frequency - old_frequency) / old_frequency > conf.FREQUENCY_CHANGE), F.concat(F.lit("freq "), old_frequency, F.lit("→"), frequency))
    two = lambda x: F.format_string("%.2f", x)
    how = F.when(F.abs(evidence - old_evidence) > conf.EVIDENCE_CHANGE, F.concat(F.lit("evidence "), two(old_evidence), F.lit("→"), two(evidence)))
    both = F.concat_ws(", ", by, how)
    return F.when(both == "", "").otherwise(F.concat(F.lit("⚠️ CHANGED: "), both))


def scaled(count: Column, ratio: float) -> Column:
    return (count / ratio).cast("bigint") if ratio > 0 else count
