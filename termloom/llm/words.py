"""Words of Arrow text columns as NumPy arrays: places, 64-bit hashes, n-gram hashes.

A word is a run of bytes other than space and 0x09-0x0D; text is read as UTF-8 bytes. All work is
done on whole batches. Blocks of rows are cut by bytes, so memory does not depend on the number of
documents; one document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes of text that are turned into 64-bit arrays at a time.
PIECE = 1 << 20
# Bytes of text handed to an operator at a time.
BLOCK = 8 << 20

SEPARATORS = np.array([0x20, *range(0x09, 0x0E)], dtype=np.uint8)
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[SEPARATORS] = False

_BASE = 0x9E3779B97F4A7C15
_GRAM = 0xD1342543DE82EF95
_MODULUS = 1 << 64


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others (in place)."""
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values


def _byte_codes(fold: bool) -> np.ndarray:
    """A random number per byte, 0 for separators; `fold` gives A-Z the numbers of a-z."""
    codes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if fold:
        codes[0x41:0x5B] = codes[0x61:0x7B]
    codes[SEPARATORS] = 0
    return codes


_CODES = {fold: _byte_codes(fold) for fold in (False, True)}
_powers: dict[int, np.ndarray] = {}


def powers(base: int, length: int) -> np.ndarray:
    """base^0 .. base^(length-1) modulo 2^64; the table grows as longer words or texts come."""
    table = _powers.get(base)
    if table is None or len(table) < length:
        size = 1 << max(PIECE.bit_length(), int(length).bit_length())
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        _powers[base] = table
    return table[:length]


def inverse(base: int) -> int:
    return pow(base, -1, _MODULUS)


@dataclass
class Words:
    """Words of a block: byte range of each in `data`, and the words of row i at offsets[i]:offsets[i+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self, fold: bool = False) -> np.ndarray:
        """One 64-bit hash a word; `fold` ignores the case of A-Z."""
        out = np.empty(len(self.start), dtype=np.uint64)
        codes, at = _CODES[fold], 0
        while at < len(self.start):
            base = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, base + PIECE, side="right")))
            span = codes[self.data[base : self.end[to - 1]]]
            span *= powers(_BASE, len(span))
            local = self.start[at:to] - base
            out[at:to] = np.add.reduceat(span, local) * powers(inverse(_BASE), int(local[-1]) + 1)[local]
            at = to
        return mixed(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    if len(column) == 0 or places is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(places, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array) -> Words:
    data, rows = buffers(column)
    inside = IS_WORD[data]
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = rows[1:] > rows[:-1]
    before[rows[:-1][filled]] = False
    after[rows[1:][filled] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, rows))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` hashes; the run that starts at i is at i."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = words[:count].copy()
    for step in range(1, size):
        out *= np.uint64(_GRAM)
        out += words[step : step + count]
    return mixed(out)


def row_blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts have `limit` bytes at most (or one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, rows = buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(rows, rows[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... length[0] numbers, then those of the next range."""
    total = int(length.sum())
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length) if len(length) else np.empty(0, dtype=np.int64)
    return shift + np.arange(total)
