"""Benchmark decontamination by winnowing.

Of every run of W consecutive K-gram hashes the least is kept (the rightmost of equals), so a span of
W + K - 1 words keeps a fingerprint that depends on those words alone: with K = 5 and W = 6, every shared span
of ten words has a common fingerprint. Test fingerprints are joined to training fingerprints inside one narrow
pass over the documents; each hit is extended to the windows of ten words that hold it, words compared as bytes, and the
runs of what is found are the contaminated spans. Items of fewer than ten words are looked up whole. The work
grows with the texts and the hits, also where one word fills both a text and an item.

The benchmark goes to the executors in blocks of at most ``block_bytes`` of text (a single larger item is a block of its
own); with several blocks the pass is chained, still without a shuffle. Documents are never collected or moved.

Defined results: a null or empty text has no words and no hits; an item without words is ignored; items without an id
hit like others and count as one item, which item_ids leaves out; repeated rows are judged each on its own; texts of any
length are read whole, one at a time beyond a slice, in memory of some tens of bytes for each byte; an empty table gives an empty result.
Only the id, text and ``keep`` columns are read; an output name that is also in ``keep`` raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import words as W

K, SPAN = 5, 10
WINDOW = SPAN - K + 1
BLOCK_BYTES = 16 << 20


def winnow(w: W.Words, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of the kept k-grams, in every text of at least k + window - 1 words."""
    at, h = w.grams(k)
    if not len(at):
        return at, h
    # runs of window k-grams that lie in one text
    whole = np.flatnonzero(w.left()[at] >= k + window - 1)
    whole = whole[whole + window <= len(at)]
    if not len(whole):
        return at[:0], h[:0]
    least = W.window_min(h, window)[whole]
    pick = np.full(len(whole), -1)
    for j in range(window):  # the last match wins: the rightmost of equals
        pick = np.where(h[whole + j] == least, whole + j, pick)
    pick = np.unique(pick)
    return at[pick], h[pick]


class Index:
    """Fingerprints and windows of a block of benchmark items."""

    def __init__(self, ids: list[str | None], texts: list[str], span: int = SPAN, k: int = K):
        self.span, self.k, self.window, self.ids = span, k, span - k + 1, ids
        self.words = w = W.Words(*W.raw(pa.array(texts, pa.string())), W.ALNUM, True)
        self.prints = np.unique(winnow(w, k, self.window)[1])
        counts, item, left = w.counts(), w.of_word(), w.left()
        #: by length of window: its distinct hashes, a place of each, and where its items start in the list of items
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({min(int(c), span) for c in counts if c}):
            at = np.flatnonzero(left >= n) if n == span else w.offsets[:-1][counts == n]  # a shorter item is one window
            if not len(at):
                continue
            h = W.sequences(w.hash, n)[at]
            order = np.lexsort((item[at], h))
            h, at = h[order], at[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (item[at[1:]] != item[at[:-1]])  # a window that an item repeats counts once
            h, at = h[new], at[new]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            self.grams[n] = (h[first], at[first], np.append(first, len(h)), item[at])

    def _same(self, w: W.Words, p: int, q: int, n: int) -> bool:
        own = self.words
        return all(w.data[w.start[p + i] : w.end[p + i]].tobytes() == own.data[own.start[q + i] : own.end[q + i]].tobytes() for i in range(n))

    def _found(self, w: W.Words, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows of n words at these places: those that an item has, and the number of each among the item windows.

        Words are compared as bytes, once for each window and text.
        """
        known, places, _, _ = self.grams[n]
        if not len(at):
            return at, at
        got = W.sequences(w.hash, n)[at]
        to = np.minimum(np.searchsorted(known, got), len(known) - 1)
        at, to = at[known[to] == got], to[known[to] == got]
        doc = np.searchsorted(w.offsets, at, "right") - 1
        _, first, each = np.unique(doc * len(known) + to, return_index=True, return_inverse=True)
        equal = np.array([self._same(w, int(at[i]), int(places[to[i]]), n) for i in first], bool)
        return (at[equal[each]], to[equal[each]]) if len(at) else (at, to)

    def hits(self, w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of the slice under a hit, texts, items): texts and items are the distinct pairs with a common window.

        A common fingerprint is extended to all windows that hold it, so the work grows with the text, however often a word repeats.
        """
        hit = np.zeros(len(w.start) + 1, np.int64)
        pairs = []
        for n in self.grams:
            if n == self.span:
                pos, h = winnow(w, self.k, self.window)
                if not len(pos) or not len(self.prints):
                    continue
                pos = pos[self.prints[np.minimum(np.searchsorted(self.prints, h), len(self.prints) - 1)] == h]
                doc = np.searchsorted(w.offsets, pos, "right") - 1
                at = np.concatenate([pos - j for j in range(self.window)])
                inside = (at >= np.tile(w.offsets[doc], self.window)) & (at + n <= np.tile(w.offsets[doc + 1], self.window))
                at = np.unique(at[inside])
            else:
                at = np.flatnonzero(w.left() >= n)
            at, to = self._found(w, at, n)
            if not len(at):
                continue
            np.add.at(hit, at, 1)
            np.add.at(hit, at + n, -1)
            _, _, start, items = self.grams[n]
            doc = np.searchsorted(w.offsets, at, "right") - 1
            both = np.unique(np.stack([doc, to], axis=1), axis=0)  # each window once for a text, then its items
            size = start[both[:, 1] + 1] - start[both[:, 1]]
            which = np.repeat(start[both[:, 1]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            pairs.append(np.unique(np.stack([np.repeat(both[:, 0], size), items[which]], axis=1), axis=0))
        none = np.zeros((0, 2), np.int64)
        docs, items = np.unique(np.concatenate([none, *pairs]), axis=0).T
        return np.cumsum(hit)[:-1] > 0, docs, items


def _runs(w: W.Words, hit: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """By text its runs of hit words; places count within the text."""
    edge = np.zeros(len(hit) + 1, bool)
    edge[w.offsets] = True
    start = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
    end = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
    out: dict[int, list[tuple[int, int]]] = {}
    for d, s, e in zip((np.searchsorted(w.offsets, start, "right") - 1).tolist(), start.tolist(), end.tolist(), strict=True):
        a = int(w.offsets[d])
        out.setdefault(d, []).append((s - a, e - a))
    return out


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch], shipped, text: str, span: int, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    index = Index(*shipped.value, span, k)
    for part, w in W.tables(batches, text, W.ALNUM, True):
        hit, docs, whose = index.hits(w)
        runs, items, counts = (part.column(n).to_pylist() for n in ("hit_spans", "item_ids", "n_items"))
        for doc, found in _runs(w, hit).items():
            runs[doc] = [{"start": s, "end": e} for s, e in _merge([(x["start"], x["end"]) for x in runs[doc]] + found)]
            ids = {index.ids[i] for i in whose[np.searchsorted(docs, doc) : np.searchsorted(docs, doc, "right")]}
            nameless = None in ids or counts[doc] > len(items[doc])
            items[doc] = sorted({*items[doc], *ids} - {None})
            counts[doc] = len(items[doc]) + nameless
        own = {"n_words": pa.array(w.counts(), pa.int64()), "hit_spans": pa.array(runs, SPAN_TYPE), "item_ids": pa.array(items, pa.list_(pa.string())), "n_items": pa.array(counts, pa.int64())}
        yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else part.column(f.name) for f in schema], schema=schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """keep columns and text, with n_words, hit_spans (merged word ranges), item_ids (sorted as strings) and n_items."""
    own = ("n_words", "hit_spans", "item_ids", "n_items")
    if clash := {*keep, text} & {*own}:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    if not 1 <= k <= span:
        raise ValueError("k must lie in 1..span")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    columns = list(dict.fromkeys([*keep, text]))
    out = docs.select(*columns, F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("hit_spans"), F.expr("cast(array() as array<string>)").alias("item_ids"), F.lit(0).cast("long").alias("n_items"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    arrow = pa.schema([pa.field(f.name, SPAN_TYPE if f.name == "hit_spans" else f.type) for f in arrow])
    for b in range(blocks):  # each at most a bounded block on the driver and in a worker
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        shipped = spark.sparkContext.broadcast(([r["i"] for r in rows], [r["t"] for r in rows]))
        out = out.mapInArrow(partial(_scan, shipped=shipped, text=text, span=span, k=k, schema=arrow), schema)
    return out
