"""A compressed full-text index over sequences of symbols: BWT in a wavelet matrix, common prefixes of neighbours.

Suffixes are ordered by their first DEPTH symbols, which is exact for patterns of up to that length. All
operations take arrays, so that one step serves all patterns at once.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64


class FMIndex:
    """Index of `symbols`, numbers from 0; 0 separates sequences and must not be searched for."""

    def __init__(self, symbols: np.ndarray):
        n = self.size = len(symbols)
        levels = max(1, int(symbols.max(initial=1)).bit_length())
        # Order by 1, 2, 4 ... symbols; each order is kept until the common prefixes are read from it.
        ranks = [symbols.astype(np.int32)]
        order = np.argsort(ranks[0], kind="stable")
        step = 1
        while step < DEPTH:
            rank = ranks[-1]
            key = rank.astype(np.int64) << 32
            key[:-step] |= (rank[step:] + 1).astype(np.int64)
            order = np.argsort(key)
            key = key[order]
            new = np.empty(n, dtype=np.int32)
            new[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1], dtype=np.int32))) if n else []
            ranks.append(new)
            step *= 2
        self.common = self._common_prefixes(order, ranks)
        self._tables = None
        last = symbols[order - 1]
        counts = np.bincount(symbols, minlength=1)
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))

        # Wavelet matrix: a row of bits per level, packed, with the number of ones before every word.
        self.levels, self.zeros, self.words, self.before = levels, [], [], []
        values = last.astype(np.int64)
        for level in range(levels - 1, -1, -1):
            bits = (values >> level) & 1 == 1
            padded = np.zeros((n // 64 + 1) * 64, dtype=bool)
            padded[:n] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(n - int(bits.sum()))
            values = np.concatenate([values[~bits], values[bits]])
        symbol = np.arange(len(counts))
        self.shift = first - self._down(symbol, np.zeros(len(counts), dtype=np.int64))

    @staticmethod
    def _common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """Symbols that the suffix at each place shares with the one before it; 0 at both ends."""
        n = len(order)
        shared = np.zeros(n + 1, dtype=np.uint8)
        if n > 1:
            a, b = order[:-1].copy(), order[1:].copy()
            length = np.zeros(n - 1, dtype=np.int64)
            for power in range(len(ranks) - 1, -1, -1):
                rank = ranks[power]
                inside = np.maximum(a, b) < n
                same = np.zeros(n - 1, dtype=bool)
                same[inside] = rank[a[inside]] == rank[b[inside]]
                step = same * (1 << power)
                length += step
                a += step
                b += step
            shared[1:n] = np.minimum(length, DEPTH)
        return shared

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where `place` ends up when followed through all levels along the bits of `symbol`."""
        place = place.copy()
        for number, level in enumerate(range(self.levels - 1, -1, -1)):
            word = place >> 6
            below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[number][word] + np.bitwise_count(self.words[number][word] & below)
            place = np.where((symbol >> level) & 1 == 1, self.zeros[number] + ones, place - ones)
        return place

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of symbol + pattern from those of the patterns."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.concatenate([self.shift[symbol]] * 2)
        return both[: len(symbol)], both[len(symbol) :]

    def _minima(self) -> list[np.ndarray]:
        if self._tables is None:
            self._tables, step = [self.common], 1
            while 2 * step <= len(self.common):
                table = self._tables[-1]
                self._tables.append(np.minimum(table[: len(table) - step], table[step:]))
                step *= 2
        return self._tables

    def shorten(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals and lengths of the longest shorter prefixes of the patterns that occur more often."""
        length = np.maximum(self.common[low], self.common[high]).astype(np.int64)
        low, high, last = low.copy(), high.copy(), len(self.common) - 1
        for power in range(len(self._minima()) - 1, -1, -1):
            table, step = self._tables[power], 1 << power
            # All of common[low-step+1 .. low] at least `length`: the interval reaches further down.
            start = low - step + 1
            wide = (start > 0) & (table[np.clip(start, 0, len(table) - 1)] >= length) & (length > 0)
            low = np.where(wide, low - step, low)
            wide = (high + step <= last) & (table[np.clip(high, 0, len(table) - 1)] >= length) & (length > 0)
            high = np.where(wide, high + step, high)
        return np.where(length > 0, low, 0), np.where(length > 0, high, self.size), length


def matching_statistics(index: FMIndex, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For every place of the sequences symbols[start:end], the longest run from there, up to its sequence's end, that
    the index holds at least twice. Sequences have DEPTH - 1 symbols at most."""
    found = np.zeros(len(symbols), dtype=np.int64)
    place = end - 1
    low, high = np.zeros(len(start), dtype=np.int64), np.full(len(start), index.size, dtype=np.int64)
    length = np.zeros(len(start), dtype=np.int64)
    lane = np.flatnonzero(place >= start)
    while len(lane):
        a, b = index.extend(symbols[place[lane]], low[lane], high[lane])
        fits = b - a >= 2
        go = lane[fits]
        low[go], high[go] = a[fits], b[fits]
        length[go] += 1
        found[place[go]] = length[go]
        stuck = lane[~fits]
        single = stuck[length[stuck] == 0]
        place[go] -= 1
        place[single] -= 1
        rest = stuck[length[stuck] > 0]
        if len(rest):
            low[rest], high[rest], length[rest] = index.shorten(low[rest], high[rest])
        lane = lane[place[lane] >= start[lane]]
    return found
