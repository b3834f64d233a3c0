"""Words and word n-grams of whole texts, hashed in numpy over the bytes of an Arrow column.

A word is `[^\\x20\\x09-\\x0D]+`. Hashes are 64 bits: equal words always have equal hashes, different ones collide with a
chance of about 2**-64 a pair. Texts are taken in slices of whole documents, so memory follows the slice and the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


@dataclass
class Slice:
    """Some whole texts: row numbers first..last of the batch, their bytes, and the words as byte ranges."""

    first: int
    last: int
    data: np.ndarray
    text_at: np.ndarray  # byte offset of each text, and the end
    begin: np.ndarray  # of each word
    end: np.ndarray
    word_at: np.ndarray  # number of each text's first word, and the end
    hashes: np.ndarray  # of words
    sums: np.ndarray  # of bytes, for the hash of any byte range
    _run_sums: np.ndarray | None = None

    @property
    def rows(self) -> int:
        return self.last - self.first

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        unpower = _power_tables(len(self.sums))[1]
        size = (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix((self.sums[end] - self.sums[begin]) * unpower[begin] + size)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.word_at))

    def runs(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n words from each position; costs the same for any n. The caller sees to it that they are in one text."""
        power, unpower = _power_tables(len(self.hashes) + 1)
        if self._run_sums is None:
            self._run_sums = np.zeros(len(self.hashes) + 1, np.uint64)
            np.cumsum(self.hashes * power[: len(self.hashes)], out=self._run_sums[1:])
        return mix((self._run_sums[at + n] - self._run_sums[at]) * unpower[at] + np.uint64(n))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of each run of n words within one text."""
        count = len(self.hashes)
        if count < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        left = np.repeat(self.word_at[1:], np.diff(self.word_at)) - np.arange(count)
        at = np.flatnonzero(left[: count - n + 1] >= n)
        h = np.full(len(at), np.uint64(n))
        for j in range(n):
            h = h * _BASE + self.hashes[at + j]
        return at, mix(h)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    buffers = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[Slice]:
    """The column in slices of SLICE_BYTES or one text."""
    data, at = column_bytes(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1)
        yield _slice(first, last, data[at[first] : at[last]], at[first : last + 1] - at[first], lower)
        first = last


def _slice(first: int, last: int, data: np.ndarray, text_at: np.ndarray, lower: bool) -> Slice:
    if lower:
        data = _LOWER[data]
    n = len(data)
    blank = np.ones(n + 1, bool)
    blank[:n] = _SPACE[data]
    opens = ~blank
    opens[1:] &= blank[:-1]
    starts = text_at[:-1][text_at[:-1] < n]
    opens[starts] = ~blank[starts]
    begin = np.flatnonzero(opens)
    closes = ~blank[:n] & blank[1:]
    ends = text_at[1:][text_at[1:] > 0] - 1
    closes[ends] = ~blank[:n][ends]
    end = np.flatnonzero(closes) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_tables(n + 1)[0][:n], out=sums[1:])
    word_at = np.searchsorted(begin, text_at).astype(np.int64)
    part = Slice(first, last, data, text_at, begin, end, word_at, np.zeros(0, np.uint64), sums)
    part.hashes = part.spans(begin, end)
    return part


def shingles(part: Slice, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-word shingles: row and hash, ordered by both, and the first position of each row's (offsets).

    A text with fewer than n words has its whole sequence as one shingle; one without words has none.
    """
    at, h = part.grams(n)
    row = np.searchsorted(part.word_at, at, "right") - 1
    short = np.flatnonzero((np.diff(part.word_at) > 0) & (np.diff(part.word_at) < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        size = np.diff(part.word_at)[short]
        for j in range(n - 1):
            has = size > j
            word = part.hashes[np.minimum(part.word_at[short] + j, len(part.hashes) - 1)]
            whole = np.where(has, whole * _BASE + word, whole)
        row = np.concatenate([row, short])
        h = np.concatenate([h, mix(whole + size.astype(np.uint64))])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        row, h = row[new], h[new]
    return row, h, np.searchsorted(row, np.arange(part.rows + 1))
