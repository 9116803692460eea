"""Byte-pair token ids of whole Arrow text columns.

The pre-tokenizer's split is worked out on arrays of code points, and each distinct piece is encoded once;
the ids equal those of tiktoken's encode_ordinary.
"""

from __future__ import annotations

import base64
import os
import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from docloom.llm._text import _powers, mix, raw_bytes

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = os.environ.get("DOCLOOM_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Distinct pieces that a worker remembers; beyond it, the memory is emptied and filled anew.
REMEMBERED_PIECES = 300_000
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_BASE = 0xC2B2AE3D27D4EB4F | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point; whether its class may differ between Unicode versions."""
    category = [unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1)]
    first = np.array([ord(c[0]) for c in category], np.uint8)
    out = np.full(len(first), _OTHER, np.uint8)
    out[first == ord("L")] = _LETTER
    out[first == ord("N")] = _NUMBER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    unsure = np.array([c == "Cn" for c in category])
    return out, unsure


class PieceEncoder:
    """ranks_path: a file of base64 tokens and their ranks."""

    def __init__(self, ranks_path: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.start = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)
        self.n_ids = 0

    def _pieces(self, points: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
        """Start of each piece. row_starts: of the rows that aren't empty."""
        n = len(points)
        kind = _classes()[0][points]
        row_start = np.zeros(n + 1, bool)
        row_start[row_starts] = True
        row_start[n] = True
        start = row_start[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        # the last of some white space before a visible character is on its own or, if a blank, goes with what follows
        last_space = np.flatnonzero(space[:-1] & ~space[1:] & ~row_start[1:n])
        start[last_space] = True
        start[last_space[points[last_space] == 32] + 1] = False
        mark = np.flatnonzero(points == 39)
        if len(mark):
            mark = mark[start[mark] & (mark + 1 < n)]
            mark = mark[~row_start[mark + 1] & (kind[mark + 1] == _LETTER)]
            one = points[mark + 1]
            single = (one == 115) | (one == 116)
            then = np.minimum(mark + 2, n - 1)
            two = np.where((mark + 2 < n) & ~row_start[np.minimum(mark + 2, n)], points[then], 0)
            double = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            single |= (one == 109) | (one == 100)
            for found, width in ((mark[single], 2), (mark[double & ~single], 3)):
                start[found + 1] = False
                after = found + width
                after = after[after < n]
                start[after] = True
        return np.flatnonzero(start)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids one after the other; count of each row."""
        return self._encode(column, True)

    def count_tokens(self, column: pa.Array) -> np.ndarray:
        return self._encode(column, False)[1]

    def _encode(self, column: pa.Array, want_ids: bool) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = raw_bytes(column.cast(pa.large_string()))
        text = data.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n_rows = len(offsets) - 1
        if not len(points):
            return np.zeros(0, self.ids.dtype), np.zeros(n_rows, np.int64)
        if len(points) != len(data):  # row offsets in characters
            offsets = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        unsure = _classes()[1][points]
        slow = np.zeros(n_rows, bool)
        if unsure.any():
            slow[np.searchsorted(offsets, np.flatnonzero(unsure), "right") - 1] = True
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        starts = self._pieces(points, offsets[:-1][full])
        ends = np.append(starts[1:], len(points))
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points + np.uint32(1)).astype(np.uint64) * _powers(len(points), _BASE), out=total[1:])
        key = mix((total[ends] - total[starts]) * _powers(len(points) + 1, _INVERSE)[starts] + (ends - starts).astype(np.uint64))
        distinct, at, which = np.unique(key, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED_PIECES:
            self._forget()
        rows = list(map(self.known.get, distinct.tolist()))
        new = [i for i, r in enumerate(rows) if r is None]
        if new:
            begin, end = starts[at[new]].tolist(), ends[at[new]].tolist()
            self._learn(distinct[new].tolist(), [text[i:j].encode() for i, j in zip(begin, end)])
            have = len(self.known) - len(new)
            for i, r in enumerate(new):
                rows[r] = have + i
        piece = np.array(rows)[which]
        counts = self.count[piece]
        first = np.searchsorted(starts, offsets)
        upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        per_row = upto[first[1:]] - upto[first[:-1]]
        ids = np.zeros(0, self.ids.dtype)
        if want_ids:
            where = np.arange(upto[-1]) + np.repeat(self.start[piece] - upto[:-1], counts)
            ids = self.ids[where]
        if slow.any():
            return self._mend(text, offsets, slow, ids, per_row, want_ids)
        return ids, per_row

    def _learn(self, keys: list[int], pieces: list[bytes]) -> None:
        lists = list(map(self.encoding._core_bpe.encode_single_piece, pieces))
        count = np.fromiter(map(len, lists), np.int32, len(lists))
        have, n = len(self.known), int(count.sum())
        while have + len(keys) > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        while self.n_ids + n > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.n_ids : self.n_ids + n] = np.fromiter(chain.from_iterable(lists), self.ids.dtype, n)
        self.count[have : have + len(keys)] = count
        self.start[have : have + len(keys)] = self.n_ids + np.cumsum(count) - count
        self.n_ids += n
        self.known.update(zip(keys, range(have, have + len(keys))))

    def _mend(self, text: str, offsets: np.ndarray, slow: np.ndarray, ids: np.ndarray, counts: np.ndarray, want_ids: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows with characters that not every Unicode version knows, by tiktoken itself."""
        upto, counts, parts = np.concatenate([[0], np.cumsum(counts)]), counts.copy(), []
        for i in range(len(counts)):
            own = ids[upto[i] : upto[i + 1]] if want_ids else ids
            if slow[i]:
                own = np.array(self.encoding.encode_ordinary(text[offsets[i] : offsets[i + 1]]), ids.dtype)
                counts[i] = len(own)
            parts.append(own)
        return (np.concatenate(parts) if want_ids else ids), counts


@lru_cache(2)
def piece_encoder(ranks_path: str) -> PieceEncoder:
    return PieceEncoder(ranks_path)
