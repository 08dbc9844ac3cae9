"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A window is a word with its marks, ``<word>``; its vector is the mean of the embeddings of its byte n-grams (3 to 6) and of the
word itself, hashed into a fixed number of rows, so misspellings and unseen endings share the vectors of their n-grams. A softmax over
that mean tells toxic windows from others. ``pool`` says what a text is:

* ``word``, the default: a text is toxic if any of its windows is, so the labels of texts train the model through a noisy-or over the text's
  windows, and a text's score is the softmax of its most toxic window: long texts gain nothing by their length, and one toxic word in a long
  text is not averaged away.
* ``text``: a text is one window, the mean over the n-grams of all its words.

Learning takes at most ``sample`` labelled rows of each class (the first by a hash of the id; rows of one id count as one) and the words of their
whole texts; scoring reads every word of every text. At inference the linear layer folds into one number per n-gram row.

Defined results: a null or empty text, or one without a word, has no window and scores as near to 0 as can be (the logit -30); rows with a null id
are never learned from; without both classes among the labels every score is 0; repeated rows score alike; an id with several labels or texts is
learned with the greatest label and the first text in their order; a text of any length is scored whole; an empty table gives an empty result; a
``keep`` column named toxicity raises ValueError, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillon.llm import words as W

GRAMS = (3, 4, 5, 6)
BITS, DIM, EPOCHS, RATE, DECAY = 17, 4, 40, 0.15, 0.3
SAMPLE = 1500
BLOCK = 16_384
PRIOR = 6  # empty vectors that every mean takes in: words of few n-grams need more evidence


def subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of every word's subwords and, for each, the word: grouped by n, words in order within each."""
    size = end - start + 2
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    word = np.repeat(np.arange(len(size)), size)
    inner = np.arange(at[-1]) - at[word]
    source = np.clip(start[word] + inner - 1, 0, max(len(data) - 1, 0))
    marked = data[source].astype(np.uint64) if len(data) else np.zeros(0, np.uint64)
    marked[at[:-1]] = 60
    marked[at[1:] - 1] = 62
    left = size[word] - inner
    rows, owner = [], []
    h = np.zeros(len(marked), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(marked) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(1099511628211) + marked[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            pick = np.flatnonzero(left[:m] >= n)
            rows.append((W.mix(h[pick] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int32))
            owner.append(word[pick])
    rows.append((W.hashes(data, start, end) >> np.uint64(64 - bits)).astype(np.int32))
    owner.append(np.arange(len(size)))
    return np.concatenate(rows), np.concatenate(owner)


class Model:
    """n-gram embeddings and a two-way softmax; only the difference of its two outputs matters."""

    def __init__(self, bits: int = BITS, dim: int = DIM, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bits, self.pool = bits, "word"
        self.vectors = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
        self.linear = rng.normal(0, 1.0, (dim, 2)).astype(np.float32)
        self.bias = np.array([3.0, -3.0], np.float32)

    def folded(self) -> tuple[np.ndarray, float]:
        """One number per row, and the bias."""
        return (self.vectors @ (self.linear[:, 1] - self.linear[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])

    def fit(self, docs: list[list[bytes]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, pool: str = "word") -> Model:
        """Joint full-batch training by Adam of vectors, linear layer and bias: through the noisy-or, or on whole texts."""
        self.pool = pool
        types: dict[bytes, int] = {}
        pair_word = np.array([types.setdefault(w, len(types)) for d in docs for w in d], np.int64)
        pair_doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        names = list(types)
        size = np.array([len(w) for w in names], np.int64)
        data = np.frombuffer(b"".join(names), np.uint8)
        end = np.cumsum(size)
        counts = np.zeros(len(names), np.int64)
        # words go in blocks, so that memory holds the row numbers (four bytes each) and one block's vectors
        blocks: list[tuple[int, int, np.ndarray]] = []
        for a in range(0, len(names), BLOCK):
            b = min(a + BLOCK, len(names))
            low = int(end[a] - size[a])
            rows, owner = subwords(data[low : end[b - 1]], end[a:b] - size[a:b] - low, end[a:b] - low, self.bits)
            counts[a:b] = np.bincount(owner, minlength=b - a)
            blocks.append((a, b, rows[np.argsort(owner, kind="stable")]))
        parts = counts + PRIOR
        whole = np.bincount(pair_doc, counts[pair_word], len(docs)) + PRIOR
        seen = np.zeros(1 << self.bits, bool)
        for _, _, rows in blocks:
            seen[rows] = True
        used = np.flatnonzero(seen)
        place = np.cumsum(seen).astype(np.int32) - 1
        blocks = [(a, b, place[rows]) for a, b, rows in blocks]
        vectors, linear, bias = self.vectors[used].astype(np.float64), self.linear.astype(np.float64), self.bias.astype(np.float64)
        positive = labels.astype(bool)
        weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())) * len(docs)
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in (vectors, linear, bias)]
        for step in range(1, epochs + 1):
            mean = np.concatenate([np.add.reduceat(vectors[rows], np.cumsum(counts[a:b]) - counts[a:b], axis=0) for a, b, rows in blocks])
            if pool == "text":
                mean = np.stack([np.bincount(pair_doc, x[pair_word], len(docs)) for x in mean.T], axis=1) / whole[:, None]
            else:
                mean /= parts[:, None]
            z = mean @ (linear[:, 1] - linear[:, 0]) + bias[1] - bias[0]
            p = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)
            if pool == "text":
                dz = (p - positive) * weight / len(docs)
                pull = np.bincount(pair_word, (dz / whole)[pair_doc], len(names))
            else:
                none = np.bincount(pair_doc, np.log1p(-p)[pair_word], len(docs))  # log of the chance of no toxic window
                chance = np.clip(-np.expm1(none), 1e-9, 1)
                # d loss / d z of a window: p for a clean text, -p (1 - P) / P for a toxic one
                of_doc = np.where(positive, -(1 - chance) / chance, 1.0) * weight
                dz = np.bincount(pair_word, of_doc[pair_doc], len(names)) * p / len(docs)
                pull = dz / parts
            w = linear[:, 1] - linear[:, 0]
            d_w = mean.T @ dz
            d_vectors = sum(np.bincount(rows, np.repeat(pull[a:b], counts[a:b]), len(used)) for a, b, rows in blocks)[:, None] * w[None, :]
            grads = (d_vectors, np.stack([-d_w, d_w], axis=1), np.array([-dz.sum(), dz.sum()]))
            vectors *= 1 - rate * decay  # what no text still calls for fades
            for x, g, (m, v) in zip((vectors, linear, bias), grads, state, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.vectors[used] = vectors
        untouched = np.ones(len(self.vectors), bool)
        untouched[used] = False
        self.vectors[untouched] = 0
        self.linear, self.bias = linear.astype(np.float32), bias.astype(np.float32)
        return self


def text_scores(w: W.Words, folded: np.ndarray, bias: float, bits: int, pool: str = "word") -> np.ndarray:
    """For each text the score of its most toxic window, or of its one window."""
    best = np.full(w.n, -30.0)
    if len(w.start):
        rows, owner = subwords(w.data, w.start, w.end, bits)
        total = np.bincount(owner, folded[rows], len(w.start))
        parts = np.bincount(owner, minlength=len(w.start))
        filled = np.flatnonzero(w.counts())
        first = w.offsets[:-1][filled]
        if pool == "text":
            best[filled] = np.add.reduceat(total, first) / (np.add.reduceat(parts, first) + PRIOR) + bias
        else:
            best[filled] = np.maximum.reduceat(total / (parts + PRIOR) + bias, first)
    return 1 / (1 + np.exp(-np.clip(best, -30, 30)))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, w in W.tables(batches, "text", W.ALNUM, True):
        seen = []
        for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True):
            _, first = np.unique(w.hash[a:b], return_index=True)
            seen.append(b" ".join([w.data[w.start[a + i] : w.end[a + i]].tobytes() for i in first]))
        yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(seen, pa.binary())], names=["label", "words"])


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, **training) -> Model | None:
    """A model of at most sample ids of each class, the first by a hash of the id; None without both classes."""
    one = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    chosen = None
    for value in (0, 1):
        part = one.where(F.col("label") == value).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = F.broadcast(chosen)  # at most 2 * sample rows of two numbers
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(ids, "_id").groupBy("_id", "label").agg(F.min("text").alias("text"))  # one row for each id
    rows = found.select("label", "text").mapInArrow(_words, "label int, words binary").collect()
    rows = sorted(((r["label"], bytes(r["words"]).split()) for r in rows), key=lambda r: (r[0], r[1]))
    y = np.array([r[0] for r in rows])
    if not (y == 1).any() or not (y == 0).any():
        return None
    return Model().fit([r[1] for r in rows], y, **training)


def _score(batches: Iterator[pa.RecordBatch], shipped, text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    folded, bias, bits, pool = shipped.value
    for part, w in W.tables(batches, text, W.ALNUM, True, W.SLICE_BYTES // 4):  # some 300 bytes of work for each byte
        score = text_scores(w, folded, bias, bits, pool) if folded is not None else np.zeros(len(part))
        yield pa.RecordBatch.from_arrays([pa.array(score, pa.float64()) if f.name == "toxicity" else part.column(f.name) for f in schema], schema=schema)


def score_toxicity(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and toxicity, 0 to 1."""
    if "toxicity" in keep:
        raise ValueError("a column is named toxicity")
    taken = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in taken.schema if f.name in keep), T.StructField("toxicity", T.DoubleType())])
    folded, bias = model.folded() if model else (None, 0.0)
    shipped = docs.sparkSession.sparkContext.broadcast((folded, bias, model.bits if model else BITS, model.pool if model else "word"))  # 2**BITS numbers
    return taken.mapInArrow(partial(_score, shipped=shipped, text=text, schema=to_arrow_schema(schema)), schema)
