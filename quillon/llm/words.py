"""Vectorised word tables over Arrow text: word bounds and 64-bit hashes, without a Python loop over words.

Words are maximal runs of word bytes. Every separator class used here lies in ASCII, so splitting the
UTF-8 bytes gives the same words as splitting the code points. Work goes in slices of bounded bytes; one
slice holds at least one whole text, and a text takes some ten bytes of memory for each of its own, some sixty for each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Keeps the first n of eight bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
_LENGTH, _SEED, _PAIR = U(0x9E3779B97F4A7C15), U(0x2545F4914F6CDD1D), U(0xD6E8FEB86659FD93)
#: Longer words are hashed one at a time, so that a text without a blank costs no loop of numpy calls.
LONG = 512


def _class(word: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in word:
        table[a : b + 1] = True
    return table


#: [0-9], letters and everything beyond ASCII; upper case is folded before.
ALNUM = _class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
#: everything but space and \t..\r
NONSPACE = ~_class([(0x20, 0x20), (0x09, 0x0D)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair. Every eight bytes go through a finaliser that the next eight start from, so different contents
    have equal hashes by chance alone: no sum over bytes is left in which they could cancel. Up to eight bytes of one length never collide."""
    size = end - start
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))  # the eight bytes from each place
    h = mix(size.astype(U) * _LENGTH + _SEED)
    rest, done = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(rest):
        h[rest] = mix(h[rest] ^ (eight[start[rest] + done] & _FIRST[np.minimum(size[rest] - done, 8)]))
        done += 8
        rest = rest[size[rest] > done]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def sequences(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row, by doubling: two neighbours' hashes go through the finaliser together."""
    power, size, out, taken, rest = word_hash, 1, None, 0, k
    while True:
        if rest & 1:
            out = power if out is None else _joined(out, power, taken)
            taken += size
        rest >>= 1
        if not rest:
            break
        power, size = _joined(power, power, size), 2 * size
    return mix(out + U(k * int(_LENGTH) & (1 << 64) - 1))


def stretches(word_hash: np.ndarray, k: int, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hash of the words under count windows of k words in a row, each from its first on; count is at most k + 1, so the two outer windows hold them all."""
    h = sequences(word_hash, k)
    return mix(mix(h[first] * _PAIR + h[first + count - 1]) ^ (count.astype(U) * _LENGTH))


def _joined(a: np.ndarray, b: np.ndarray, apart: int) -> np.ndarray:
    n = max(0, min(len(a), len(b) - apart))
    return mix(a[:n] * _PAIR + b[apart : apart + n])


class Words:
    """The words of a slice of texts: text i has words offsets[i]:offsets[i+1]; word j is data[start[j]:end[j]]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, table: np.ndarray, lower: bool):
        if lower:
            data = _LOWER[data]
        self.data, self.n = data, len(bounds) - 1
        inside = table[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | cut[:-1]))
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.offsets = np.searchsorted(self.start, bounds)
        self.hash = hashes(data, self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def of_word(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), self.counts())

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.offsets[1:], self.counts()) - np.arange(len(self.start))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the k-grams that lie in one text, and their hashes."""
        at = np.flatnonzero(self.left() >= k)
        return at, sequences(self.hash, k)[at] if len(at) else np.zeros(0, U)

    def text(self, a: int, b: int) -> bytes:
        """Words a:b joined by one space."""
        data = self.data
        return b" ".join(data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and text bounds of a string array; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        bounds = np.frombuffer(texts.buffers()[1], np.int64)
    else:
        bounds = np.frombuffer(texts.buffers()[1], np.int32)
    bounds = bounds[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[bounds[0] : bounds[-1]] if whole is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    found = batch.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about so many bytes of text."""
    for batch in batches:
        _, bounds = raw(column(batch, text)) if len(batch) else (None, np.zeros(1, np.int64))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def tables(batches: Iterator[pa.RecordBatch], text: str, table: np.ndarray, lower: bool, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for part in slices(batches, text, size):
        yield part, Words(*raw(column(part, text)), table, lower)


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of values[i:i+w] for each i with a whole window, in log2(w) passes."""
    n, size, out = len(values) - w + 1, 1, values
    if n <= 0:
        return values[:0]
    while 2 * size <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:n], out[w - size : w - size + n])
