"""Words of Arrow text columns as 64-bit hashes, by whole batches.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD = np.zeros(256, np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _WORD[_c] = _c
for _c in range(128, 256):
    _WORD[_c] = _c
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
#: Bytes of text worked on at once; arrays of 8 bytes a character hang on it.
SLICE_BYTES = 400_000


def _powers(n: int, base: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(19, int(n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        filled = 1
        while filled < size:
            step = np.uint64(pow(base, filled, 1 << 64))
            have[filled : 2 * filled] = have[:filled] * step
            filled *= 2
        if size <= 1 << 21:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in slices of about limit bytes of text, one row at least."""
    n = batch.num_rows
    if n == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    at = 0
    for cut in [*cuts.tolist(), n]:
        yield batch.slice(at, cut - at)
        at = cut


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and row offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def word_spans(data: np.ndarray, offsets: np.ndarray, members: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the index of its first word (with the total at the end).

    members: for each byte, whether it is part of a word (not 0).
    """
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = members[data] != 0
    change = np.diff(flags)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    inner = inner[(flags[inner] != 0) & (flags[inner + 1] != 0)]  # a word that runs over a row's end
    if len(inner):
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * _powers(len(data), _BASE), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(len(data) + 1, _INVERSE)[starts]) if len(starts) else np.zeros(0, np.uint64)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the lower-cased column; first word of each row."""
    data, offsets = raw_bytes(lowered(column))
    starts, ends, first = word_spans(data, offsets)
    return word_hashes(data, starts, ends), first


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on (wrapping sums, so places near the end of the array are absent)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[k : k + m]
    return mix(out)
