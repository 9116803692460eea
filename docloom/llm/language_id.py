"""Language identification by compression.

Each language has zstandard raw-content dictionaries cut from a bounded sample of labelled rows: SAMPLE_ROWS different texts of smallest hash, each of which
gives the same number of bytes, from a hashed place within it. A text, in lower case, is compressed under every dictionary, whole, in blocks
of BLOCK bytes (each block meets the dictionary afresh, so that a long text doesn't outgrow it), and the language of the smallest sum
is chosen, unless the runner-up is within MARGIN of it.

Texts fall into FOLDS folds by hash. Each fold has dictionaries of its own from the texts of the others, so that no text meets itself or a copy of
itself; a language that the others don't have is taken from the fold itself. Beyond GROUP languages, dictionaries are made and used a group at a time.

Result: doc_id, language (null if rejected), margin, best_bytes and raw_bytes of every row, repeated rows included. Null
text: all null but doc_id. Empty text: rejected, margin 0. Ties are rejected (margin 0). Null labels aren't fitted. With
one language alone the margin is null and that language is chosen; with no labelled row, every language is null. A null doc_id stays null. Other columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm._shared import null_safe_columns, written

#: Bounds of the fit: labelled rows, and dictionary bytes, of a language and fold.
SAMPLE_ROWS = 200
DICTIONARY_BYTES = 64 << 10
FOLDS = 2
#: Rows of the sample's keys that are sent to all tasks; more of them are joined.
MOST_SENT = 200_000
#: Languages whose dictionaries a worker holds at once.
GROUP = 200
BLOCK = 8 << 10
LEVEL = 9
MARGIN = 0.01


def _fold(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(31), text), F.lit(FOLDS)).cast("int")


def fit_dictionaries(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> list[dict[str, bytes]]:
    """For each fold, a dictionary for each value of lang from texts of the other folds."""
    rows = null_safe_columns(docs, {"lang": "string", "text": "string"}).where("lang is not null and length(text) > 0")
    rows = rows.withColumn("hash", F.xxhash64(F.lit(23), "text")).withColumn("fold", _fold(F.col("text")))
    group = W.partitionBy("lang", "fold")
    chosen = rows.select("lang", "fold", "hash").distinct().withColumn("place", F.row_number().over(group.orderBy("hash"))).where(F.col("place") <= sample_rows)
    chosen = chosen.withColumn("share", F.ceil(dictionary_bytes / F.count("*").over(group)).cast("int")).drop("place")
    chosen = written(chosen, "language-samples")
    # sample_rows a language and fold; only very many languages aren't sent to all tasks
    sent = F.broadcast(chosen) if chosen.count() <= MOST_SENT else chosen
    sample = rows.join(sent, ["lang", "fold", "hash"]).groupBy("lang", "fold", "hash", "share").agg(F.min("text").alias("text"))
    begin = F.pmod(F.xxhash64(F.lit(29), "text"), F.greatest(F.lit(1), F.length("text") - F.col("share") + 1)).cast("int") + 1
    # sample_rows pieces of dictionary_bytes together, a language and fold
    parts = sample.select("lang", "fold", "hash", "share", F.lower(F.substring("text", begin, F.col("share"))).alias("piece")).orderBy("lang", "fold", "hash").collect()
    own: dict[tuple[str, int], bytes] = {}
    for r in parts:
        piece = r["piece"].encode()[: r["share"]].decode(errors="ignore").encode()
        own[r["lang"], r["fold"]] = own.get((r["lang"], r["fold"]), b"") + piece + b"\n"
    out = []
    for fold in range(FOLDS):
        others = {lang: b"".join(own.get((lang, f), b"") for f in range(FOLDS) if f != fold) or own[lang, fold] for lang, _ in sorted(own)}
        out.append({lang: d[:dictionary_bytes] for lang, d in others.items()})
    return out


def compressed_sizes(text: bytes, compressors: list, block: int = BLOCK) -> np.ndarray:
    sizes = np.zeros(len(compressors), np.int64)
    for at in range(0, len(text), block):
        piece = text[at : at + block]
        sizes += [len(c.compress(piece)) for c in compressors]
    return sizes


def compressors_of(dictionaries: Mapping[str, bytes], level: int = LEVEL) -> list:
    import zstandard

    kinds = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in dictionaries.values()]
    for d in kinds:
        d.precompute_compress(level=level)
    return [zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in kinds]


def identify_language(docs: DataFrame, dictionaries: Mapping[str, bytes] | None = None, margin: float = MARGIN) -> DataFrame:
    """See the module; dictionaries: those of all texts, by default fit_dictionaries() of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_dictionaries(docs) if dictionaries is None else [dict(dictionaries)] * FOLDS)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int], list] = {}

        def compressors(fold: int, at: int) -> list:
            if (fold, at) not in made:
                if len(sent.value[fold]) > GROUP:
                    made.clear()
                made[fold, at] = compressors_of(dict(list(sent.value[fold].items())[at : at + GROUP]))
            return made[fold, at]

        for batch in batches:
            texts = batch.column(1)
            folds = batch.column(2).to_numpy(zero_copy_only=False)
            sizes = np.zeros((batch.num_rows, len(sent.value[0])), np.int64)
            raw = pc.binary_length(texts).to_pylist()
            for fold in range(FOLDS) if not dictionaries else range(1):
                mine = np.flatnonzero(np.asarray(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)) & ((folds == fold) | bool(dictionaries))).tolist()
                for at in range(0, sizes.shape[1], GROUP) if mine else ():
                    own = compressors(fold, at)
                    for i in mine:
                        sizes[i, at : at + GROUP] = compressed_sizes(texts[i].as_py().lower().encode(), own)
            languages, margins, best = [], [], []
            for i, n in enumerate(raw):
                if not n or not sizes.shape[1]:
                    languages.append(None)
                    margins.append(None if n is None else 0.0)
                    best.append(None if n is None else 0)
                    continue
                names, order = list(sent.value[0 if dictionaries else folds[i]]), np.argsort(sizes[i], kind="stable")
                gap = None if len(names) == 1 else float(sizes[i, order[1]] - sizes[i, order[0]]) / float(sizes[i, order[0]])
                languages.append(names[order[0]] if gap is None or (gap >= margin and gap > 0) else None)
                margins.append(gap)
                best.append(int(sizes[i, order[0]]))
            yield pa.record_batch([batch.column(0), pa.array(languages, pa.string()), pa.array(margins, pa.float64()), pa.array(best, pa.int64()), pa.array(raw, pa.int64())], ["doc_id", "language", "margin", "best_bytes", "raw_bytes"])

    rows = null_safe_columns(docs, {"doc_id": "bigint", "text": "string"}).withColumn("fold", F.coalesce(_fold(F.col("text")), F.lit(0)))
    return rows.mapInArrow(classify, "doc_id bigint, language string, margin double, best_bytes bigint, raw_bytes bigint")
