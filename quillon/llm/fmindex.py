"""A compressed FM-index over word sequences: suffix order, wavelet matrix of packed bits, range minimum of owners.

``matches`` streams many patterns at once, in lockstep: each goes backward from a right end, word by word, as long as what it has
matched also occurs in a sequence of a smaller owner; that length is the matching statistic of the right end.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def suffix_order(text: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes sorted by their first ``longest`` symbols, by prefix doubling; ranges of shorter patterns are contiguous."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    size = 1
    while size < longest and (not len(rank) or rank.max() < n - 1):
        after = np.zeros(n, np.int64)
        after[: n - size] = rank[size:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        step = np.zeros(n, np.int64)
        step[1:] = sorted_key[1:] != sorted_key[:-1]
        rank[order] = np.cumsum(step)
        size *= 2
    return order


class Bits:
    """A packed bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        self.ones = int(bits.sum())
        padded = np.zeros(len(bits) // 64 * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(U)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((U(1) << (i & 63).astype(U)) - U(1)))


class FMIndex:
    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray):
        """sequences of hashes of words; owners: the number of each one's document."""
        length = np.array([len(s) for s in sequences])
        symbols, coded = np.unique(np.concatenate(sequences), return_inverse=True)
        n = int(length.sum()) + len(sequences)
        text = np.zeros(n, np.int64)  # 0 ends every sequence
        self.start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
        inside = np.ones(n, bool)
        inside[self.start + length] = False
        text[inside] = coded + 1
        self.text, self.length, self.owners, self.n = text, length, owners, n
        order = suffix_order(text, int(length.max()))  # no pattern is longer
        last = text[order - 1]
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        self.depth = max(1, int(len(symbols)).bit_length())
        rest = last
        for b in range(self.depth - 1, -1, -1):
            bit = (rest >> b & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(n - self.levels[-1].ones)
            rest = np.concatenate([rest[~bit], rest[bit]])
        count = np.bincount(text, minlength=len(symbols) + 1)
        self.first = np.cumsum(count) - count
        self.base = self._descend(np.arange(len(symbols) + 1), np.zeros(len(symbols) + 1, np.int64))
        owner = np.repeat(owners, length + 1)[order]
        self.least = [owner]
        while 2 << (len(self.least) - 1) <= n:
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))
        self.table = np.full((len(self.least), n), np.iinfo(np.int64).max)
        for k, x in enumerate(self.least):
            self.table[k, : len(x)] = x
        del self.least

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, b in enumerate(range(self.depth - 1, -1, -1)):
            one = self.levels[k].rank(i)
            i = np.where(symbol >> b & 1, self.zeros[k] + one, i - one)
        return i

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that put a symbol before those in low:high."""
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.first[symbol] - self.base[symbol]
        return both[: len(symbol)] + shift, both[len(symbol) :] + shift

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        k = np.frexp(np.maximum(high - low, 1).astype(float))[1] - 1
        return np.minimum(self.table[k, low], self.table[k, high - (1 << k)])

    def matches(self, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, start, end) of maximal stretches of at least span words that also occur in a sequence of a smaller owner."""
        live = np.flatnonzero(self.length >= span)
        end = self.length[live].copy()
        at, low, high = end - 1, np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            lo, hi = self.extend(self.text[self.start[live] + at], low, high)
            good = self.least_owner(lo, hi) < self.owners[live]
            at = np.where(good, at - 1, at)
            low, high = np.where(good, lo, low), np.where(good, hi, high)
            over = ~good | (at < 0)
            if over.any():
                size = end - 1 - at  # matched words, those at at+1 .. end-1
                hit = over & (size >= span)
                if hit.any():
                    out.append((live[hit], at[hit] + 1, end[hit]))
                end = np.where(over, np.where(size >= span, end - size + span - 1, end - 1), end)
                at, low, high = np.where(over, end - 1, at), np.where(over, 0, low), np.where(over, self.n, high)
                going = end >= span
                if not going.all():
                    live, end, at, low, high = live[going], end[going], at[going], low[going], high[going]
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
