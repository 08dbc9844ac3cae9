"""Language identification by error-correcting output codes.

Every language has a codeword, a row of a Hadamard matrix, so that codewords differ in half of their bits. For each bit a binary classifier
over hashed byte n-grams (logistic, trained in numpy) tells the languages with that bit from those without. A text's margins are decoded by loss: for each
language the exponential loss of its codeword, bits weighted by how well their classifier knew that language in training; the
least loss wins, and texts whose best two losses lie close are flagged as ambiguous.

Up to ``HADAMARD`` languages; beyond, codewords are drawn at random with ``HADAMARD`` - 1 bits, which differ in about half of them as well.

Learning takes at most ``per_language`` labelled ids of each language (the first by a hash of the id), fewer where many languages would make more
than ``TOTAL`` of them, but one at least, as fixed-size histograms of their whole texts; prediction reads every text whole.

Defined results: a null text, an empty one or one without a letter is ``und`` with score 0 (ambiguous); with no labelled rows everything is ``und``;
rows without an id or a language are not learned from; repeated rows get equal results and are learned once; of equal losses the first language in
the order of names wins; a text of any length is read whole; an empty table gives an empty result; output names in ``keep`` raise ValueError, other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillon.llm import words as W

GRAMS = (1, 2, 3, 4)
ROWS = 4096
PER_LANGUAGE, TOTAL, HADAMARD = 600, 20_000, 512
AMBIGUOUS = 0.6
UNKNOWN = "und"
_HASHES = 1 << 40
#: Up to so many languages their thresholds are broadcast, a name and a number each.
BROADCAST_LANGUAGES = 100_000
_LETTER = W._class([(0x41, 0x5A), (0x61, 0x7A)])


def histograms(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows of square roots of n-gram counts, of length one."""
    n = len(bounds) - 1
    data = W._LOWER[data]
    doc = np.repeat(np.arange(n), np.diff(bounds))
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(data))
    out = np.zeros(n * ROWS, np.float64)
    h = np.zeros(len(data), np.uint32)
    for k in range(1, max(GRAMS) + 1):
        m = len(data) - k + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(16777619) + data[k - 1 :] + np.uint32(1)
        if k in GRAMS:
            row = ((h ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(20)
            ok = left[:m] >= k
            out += np.bincount((doc[:m] * ROWS + row)[ok], minlength=n * ROWS)
    out = np.sqrt(out.reshape(n, ROWS))
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1: rows of a Hadamard matrix without its constant column, or drawn at random."""
    if n > HADAMARD:
        return np.random.default_rng(n).choice(np.array([-1, 1]), (n, HADAMARD - 1))
    h = np.ones((1, 1), int)
    while len(h) < max(n, 8):
        h = np.block([[h, h], [h, -h]])
    return h[:n, 1:]


class Model:
    def __init__(self, languages: list[str], codes: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.codes, self.weights, self.bias, self.trust = languages, codes, weights, bias, trust

    @classmethod
    def fit(cls, x: np.ndarray, languages: list[str], epochs: int = 150, rate: float = 0.5, decay: float = 1e-5) -> Model:
        names = sorted(set(languages))
        place = {v: i for i, v in enumerate(names)}
        y = np.array([place[v] for v in languages])
        codes = codewords(len(names))
        target = codes[y] > 0
        share = (1.0 / np.bincount(y, minlength=len(names)))[y] / len(names)  # languages weigh alike
        weights, bias = np.zeros((x.shape[1], codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
        state = [[np.zeros_like(v), np.zeros_like(v)] for v in (weights, bias)]
        for step in range(1, epochs + 1):
            p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
            d = ((p - target) * share[:, None]).astype(np.float32)
            for v, g, (m, s) in zip((weights, bias), (x.T @ d + decay * weights, d.sum(axis=0)), state, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        right = ((x @ weights + bias > 0) == target).astype(float)
        trust = np.stack([right[y == c].mean(axis=0) for c in range(len(names))])
        return cls(names, codes, weights, bias, trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9))

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of each language's codeword; the margins are held to +-5."""
        margin = np.clip(x @ self.weights + self.bias, -5, 5)
        return np.stack([(self.trust[c] * np.exp(-self.codes[c] * margin)).sum(axis=1) for c in range(len(self.languages))], axis=1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        loss = self.losses(x)
        p = 1 / np.maximum(loss, 1e-9)
        return loss.argmin(axis=1), p.max(axis=1) / p.sum(axis=1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in W.slices(batches, "text"):
        x = histograms(*W.raw(W.column(part, "text"))).astype(np.float16)
        yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of at most per_language ids of each language; None without labelled rows."""
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    light = known.select(F.col(doc_id).alias("_id"), F.col(lang).alias("lang"), F.pmod(F.xxhash64(F.col(doc_id)), F.lit(_HASHES)).alias("_hash"))
    counts = light.groupBy("lang").agg(F.count("*").alias("_c"))
    languages = counts.count()
    if not languages:
        return None
    most = max(1, min(per_language, TOTAL // languages))
    # about twice the rows asked for, by hash, before any row is ranked: a language that most rows share is no hot key
    below = counts.select("lang", F.least(F.lit(_HASHES), F.floor(F.lit(2 * most) * F.lit(float(_HASHES)) / F.col("_c")) + 1).alias("_below"))
    below = F.broadcast(below) if languages <= BROADCAST_LANGUAGES else below  # else the join would deal all rows by language first
    order = Window.partitionBy("lang").orderBy("_hash", "_id")
    few = light.join(below, "lang").where("_hash < _below").select("_id", "lang", "_hash").distinct()
    chosen = few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("_id", "lang")
    ids = F.broadcast(chosen)  # at most TOTAL rows of an id and a language, or one for each language
    found = known.select(F.col(doc_id).alias("_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(ids, ["_id", "lang"]).groupBy("_id", "lang").agg(F.min("text").alias("text"))
    rows = found.select("lang", "text").mapInArrow(_features, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    return Model.fit(np.stack([np.frombuffer(r["x"], np.float16).astype(np.float32) for r in rows]), [r["lang"] for r in rows])


def _predict(batches: Iterator[pa.RecordBatch], shipped, text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    model: Model | None = shipped.value
    for part in W.slices(batches, text, W.SLICE_BYTES // 2):
        for at in range(0, len(part), 512):  # histograms of 512 texts at once
            rows = part.slice(at, 512)
            column = W.column(rows, text)
            data, bounds = W.raw(column)
            letters = np.zeros(len(data) + 1, np.int64)
            np.cumsum(_LETTER[data], out=letters[1:])
            some = letters[bounds[1:]] > letters[bounds[:-1]]
            for i in np.flatnonzero(~some & (bounds[1:] > bounds[:-1])).tolist():
                some[i] = any(map(str.isalpha, column[i].as_py()))
            lang, score = np.full(len(rows), UNKNOWN, object), np.zeros(len(rows))
            if model is not None and some.any():
                best, p = model.predict(histograms(data, bounds))
                lang[some] = np.array(model.languages, object)[best[some]]
                score[some] = p[some]
            own = {"lang_pred": pa.array(lang, pa.string()), "lang_score": pa.array(score, pa.float64()), "lang_ambiguous": pa.array(score < AMBIGUOUS)}
            yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else rows.column(f.name) for f in schema], schema=schema)


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, lang_pred, lang_score (0 to 1) and lang_ambiguous."""
    own = T._parse_datatype_string("lang_pred string, lang_score double, lang_ambiguous boolean")
    if clash := {*keep} & {*own.fieldNames()}:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    taken = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in taken.schema if f.name in keep), *own])
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return taken.mapInArrow(partial(_predict, shipped=shipped, text=text, schema=to_arrow_schema(schema)), schema)
