"""Best-fit packing of documents into training sequences under several capacities at once.

A sequence has capacities of tokens, documents and attention cost (the sum of squared piece lengths). Pieces go longest first; each
goes to the open sequence, feasible under every constraint, that its residual vector makes best, every capacity counted as 1 and weighted by
``weights``: the least norm of what is left after placing (``norm``) or the least dot product of the demand and what is left before (``dot``).
The defaults: ``MAX_DOCS`` documents; ``MAX_ATTENTION``, the least cost that lets in a piece of MAX_TOKENS, which pieces of as many tokens in all can't pass, so
that its residual steers the choice but never closes a sequence that has room for more tokens.

Pieces of one length are alike, so only the histogram of lengths, at most ``max_tokens`` rows whatever the corpus size, is packed on
the driver, whole classes of like sequences at a time. It gives runs (length, ranks, sequences, offset); every executor then places its
own pieces by their rank among those of their length. Ranks come from counts by input partition and length, not from a sort, so a length
that a third of all pieces share is no hot key. Token counts are written to the shared folder first: ranks must not change between
passes.

Defined results: a null or empty text is the end-of-document id alone; repeated rows are packed each on its own; null ids are kept;
an empty table gives an empty result; a text of any length is tokenised whole; output names in ``keep`` raise ValueError, other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_schema

from quillon.llm import words as W
from quillon.llm.store import Written

MAX_TOKENS, END_ID = 4096, 1
MAX_DOCS, MAX_ATTENTION = 1024, MAX_TOKENS**2
WEIGHTS = (1.0, 0.25, 0.25)  # of tokens, documents, attention cost
RUN_BLOCK = 500_000  # runs shipped at once: 20 MB


def _cut(batches: Iterator[pa.RecordBatch], text: str, path: str, most: int, end_id: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    from quillon.llm.tokens import encoder

    coder, part_id = encoder(path), TaskContext.get().partitionId()
    seen = np.zeros(most + 1, np.int64)
    end = np.array([end_id], "<u4").tobytes()
    for part in W.slices(batches, text):
        row, piece, start, length, crc, rank = [], [], [], [], [], []
        for i, ids in enumerate(coder.encode(W.column(part, text).to_pylist())):
            ids += end
            for k, a in enumerate(range(0, len(ids), 4 * most)):
                x = ids[a : a + 4 * most]
                n = len(x) // 4
                row.append(i)
                piece.append(k)
                start.append(a // 4)
                length.append(n)
                crc.append(zlib.crc32(x))
                rank.append(int(seen[n]))
                seen[n] += 1
        own = {"piece": piece, "start": start, "length": length, "ids_crc32": crc, "_part": [part_id] * len(row), "_rank": rank}
        at = pa.array(row, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own else part.column(f.name).take(at) for f in schema], schema=schema)


def plan(histogram: dict[int, int], max_tokens: int = MAX_TOKENS, max_docs: int | None = None, max_attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.0, 0.0)) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, count, first sequence, offset), sorted by length and rank, and the number of sequences."""
    total = sum(histogram.values())
    cap = np.array([max_tokens, max_docs or max(total, 1), max_attention or max_tokens**2], float)
    weight = np.array(weights) / cap
    if any(n > max_tokens or n * n > cap[2] for n in histogram):
        raise ValueError("a piece passes a capacity")
    room = np.zeros((0, 3))  # of each class of like sequences
    first = np.zeros(0, np.int64)
    count = np.zeros(0, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        need = np.array([length, 1, length * length], float)
        while left:
            fits = np.flatnonzero((room >= need).all(axis=1))
            if len(fits):
                if rule == "norm":
                    pick = fits[np.argmin((((room[fits] - need) * weight) ** 2).sum(axis=1))]
                else:
                    pick = fits[np.argmin((room[fits] * weight * need * weight).sum(axis=1))]
                r, f, c = room[pick].copy(), int(first[pick]), int(count[pick])
                room, first, count = np.delete(room, pick, 0), np.delete(first, pick), np.delete(count, pick)
            else:
                r, c = cap.copy(), left
                f = sequences
            each = int((r // need).min())  # of this length in one sequence: best fit fills it before it goes on
            new, new_first, new_count = [], [], []
            whole = min(c, left // each)
            parts = [(f, whole, each)]
            if whole < c and left % each:
                parts.append((f + whole, 1, left % each))
            took = 0
            for start, bins, n in parts:
                if not bins:
                    continue
                for k in range(n):
                    runs.append((length, rank, bins, start, int(cap[0] - r[0]) + k * length))
                    rank += bins
                left -= bins * n
                took += bins
                new.append(r - n * need)
                new_first.append(start)
                new_count.append(bins)
            if len(fits):
                if took < c:
                    new.append(r)
                    new_first.append(f + took)
                    new_count.append(c - took)
            else:
                sequences += took
            room = np.concatenate([room, np.array(new).reshape(-1, 3)])
            first, count = np.concatenate([first, np.array(new_first, np.int64)]), np.concatenate([count, np.array(new_count, np.int64)])
        alive = (room[:, 0] >= 1) & (room[:, 1] >= 1) & (room[:, 2] >= 1)
        room, first, count = room[alive], first[alive], count[alive]
    out = np.array(runs, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))], sequences


def _place(batches: Iterator[pa.RecordBatch], shipped, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    runs = shipped.value
    key = (runs[:, 0] << 44) + runs[:, 1]
    for batch in batches:
        length, rank = (batch.column(n).to_numpy() for n in ("length", "_rank"))
        at = np.searchsorted(key, (length << 44) + rank, "right") - 1
        inside = (at >= 0) & (runs[at, 0] == length) & (rank < runs[at, 1] + runs[at, 2])
        own = {"sequence_id": np.where(inside, runs[at, 3] + rank - runs[at, 1], batch.column("sequence_id").to_numpy()), "offset": np.where(inside, runs[at, 4], batch.column("offset").to_numpy())}
        yield pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own else batch.column(f.name) for f in schema], schema=schema)


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def pack(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), max_tokens: int = MAX_TOKENS, max_docs: int | None = MAX_DOCS, max_attention: int | None = None, end_id: int = END_ID, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """A row for each piece: keep columns, piece, start, length, ids_crc32, sequence_id and offset. max_docs None is no bound, max_attention None is max_tokens**2."""
    spark = docs.sparkSession
    own = T._parse_datatype_string(f"{PIECES}, _part bigint, _rank bigint")
    if clash := {*keep} & {*own.fieldNames(), "sequence_id", "offset"}:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    taken = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in taken.schema if f.name in keep), *own])
    pieces = Written(taken.mapInArrow(partial(_cut, text=text, path=tokenizer, most=max_tokens, end_id=end_id, schema=to_arrow_schema(schema)), schema), "pieces").read()
    counts = pieces.groupBy("length", "_part").agg(F.count("*").alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_tokens rows
    runs, _ = plan(histogram, max_tokens, max_docs, max_attention, rule, weights)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_base"))
    ranked = pieces.join(base, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    columns = [*keep, "piece", "start", "length", "ids_crc32"]
    out = ranked.select(*columns, "_rank", F.lit(-1).cast("long").alias("sequence_id"), F.lit(-1).cast("long").alias("offset"))
    arrow = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    for a in range(0, len(runs), RUN_BLOCK):
        shipped = spark.sparkContext.broadcast(runs[a : a + RUN_BLOCK])
        out = out.mapInArrow(partial(_place, shipped=shipped, schema=to_arrow_schema(arrow)), arrow)
    return out.select(*columns, "sequence_id", "offset")
