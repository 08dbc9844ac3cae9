"""Substring dedup: words covered by a long enough stretch that also occurs in a document with a smaller id.

A window is SPAN consecutive words. Of the K-gram hashes in a window the least (the rightmost of equals) is its anchor, which depends on
the window's words alone, so equal windows have equal anchors wherever they lie; neighbouring windows of one anchor make a segment.

1. Anchors that only one document has are dropped: (anchor, least id, greatest id) is an aggregate with map-side combining.
2. Equal segments of an anchor are aggregated to the first one of the least document, its owner; those of other documents are repeats
   as a whole, and all of the owner document get what steps 3 and 4 find in the first.
3. Segments of anchors that still have several different ones are dealt by anchor into shards. Every shard goes through in blocks of about
   BLOCK_WORDS words of whole anchors; for each block a compressed FM-index is built and the block's segments are streamed through it by
   backward search, which reports every stretch of at least SPAN words that a smaller document has.
4. An anchor of more than HOT different segments (the edge of a passage that a large share of all documents has) would be one
   task's work; its windows are settled by an aggregate over their hashes instead, least id by window, which is exact as well.

An anchor, a segment or a window that very many documents have is dealt over several tasks in every join on it: the aggregates that find
the keys count their rows too, so heavy keys are known before the join.

All steps judge the input, never what is left of it. Words are compared through 64-bit hashes of words and of sequences together.

Defined results: null, empty or shorter texts have no window; a null id counts as greater than all others; rows of one id never
remove each other's words; equal rows get equal results; an empty table gives an empty result.
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
from quillon.llm.fmindex import FMIndex
from quillon.llm.store import Written

SPAN, K = 50, 25
HOT, BLOCK_WORDS = 2000, 200_000
BROADCAST_ROWS = 400_000
#: A key of more than HEAVY rows is dealt in parts; as the bound rises with the rows, at most MANY keys have more.
HEAVY, MANY = 4096, 50_000
LAST = (1 << 63) - 1


def segments(w: W.Words, span: int, k: int) -> tuple[np.ndarray, ...]:
    """(first word, windows, anchor hash) of each run of windows with one anchor."""
    at, h = w.grams(k)
    window = span - k + 1
    empty = np.zeros(0, np.int64)
    if len(h) < window:
        return empty, empty, np.zeros(0, np.uint64)
    whole = np.flatnonzero(w.left()[at] >= span)
    if not len(whole):
        return empty, empty, np.zeros(0, np.uint64)
    least = W.window_min(h, window)[whole]
    pick = np.full(len(whole), -1)
    for j in range(window):
        pick = np.where(h[whole + j] == least, whole + j, pick)
    first = at[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (first[1:] != first[:-1] + 1)
    start = np.flatnonzero(new)
    return first[start], np.diff([*start, len(whole)]), h[pick[start]]


def _anchors(batches: Iterator[pa.RecordBatch], span: int, k: int, full: bool) -> Iterator[pa.RecordBatch]:
    for part, w in W.tables(batches, "text", W.NONSPACE, False):
        first, count, anchor = segments(w, span, k)
        doc = np.searchsorted(w.offsets, first, "right") - 1
        did = part.column("did").to_numpy()[doc]
        if full:
            rk = part.column("rk").to_numpy()[doc]
            same = W.stretches(w.hash, span, first, count) if len(first) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(same.view(np.int64)), pa.array(did), pa.array(rk), pa.array((first - w.offsets[doc]).astype(np.int32)), pa.array(count.astype(np.int32))], names=["anchor", "same", "did", "rk", "first", "windows"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(did)], names=["anchor", "did"])


def _cut(batches: Iterator[pa.RecordBatch], span: int, hot: int) -> Iterator[pa.RecordBatch]:
    """The words of the wanted segments as hashes; of hot anchors the hashes of their windows."""
    longs = pa.list_(pa.int64())
    for part, w in W.tables(batches, "text", W.NONSPACE, False):
        rows: list[list] = [[] for _ in range(6)]
        windows = None
        did = part.column("did").to_pylist()
        for i, wanted in enumerate(part.column("wanted").to_pylist()):
            for x in wanted:
                a = int(w.offsets[i]) + x["first"]
                if x["g"] > hot:
                    windows = W.sequences(w.hash, span) if windows is None else windows
                    values = windows[a : a + x["windows"]]
                else:
                    values = w.hash[a : a + x["windows"] + span - 1]
                for column, v in zip(rows, (x["anchor"], x["same"], did[i], x["first"], x["g"] > hot, values.view(np.int64)), strict=True):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (*[pa.int64()] * 3, pa.int32(), pa.bool_(), longs), strict=True)], names=["anchor", "same", "did", "first", "hot", "values"])


#: a and b count from the segment's first word.
INTERVALS = "anchor bigint, same bigint, a int, b int"


def _search(batches: Iterator[pa.RecordBatch], span: int, block_words: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; a block ends between two anchors."""
    ids: list[list[int]] = [[] for _ in range(3)]  # anchor, same, did
    words: list[np.ndarray] = []
    held, last = 0, None

    def block() -> pa.RecordBatch:
        anchor, same, did = (np.array(x, np.int64) for x in ids)
        which, a, b = FMIndex([x.view(np.uint64) for x in words], did).matches(span)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[which], same[which], a.astype(np.int32), b.astype(np.int32))], names=["anchor", "same", "a", "b"])

    for batch in batches:
        values = batch.column("values")
        flat, cut = values.flatten().to_numpy(), np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy())])
        for i, row in enumerate(zip(*(batch.column(n).to_pylist() for n in ("anchor", "same", "did")), strict=True)):
            if row[0] != last and held >= block_words:
                yield block()
                ids, words, held = [[] for _ in range(3)], [], 0
            last = row[0]
            for column, v in zip(ids, row, strict=True):
                column.append(v)
            words.append(flat[cut[i] : cut[i + 1]])
            held += len(words[-1])
    if words:
        yield block()


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if a count says that it is small; else the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _sum(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.sum(column), F.lit(0)).alias("n")).first()["n"]


def _dealt(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, total: int, heavy: int, how: str = "inner") -> DataFrame:
    """left joined to right on keys. right has one row for each key and counts its keys; n is the key's rows in left, total their sum. The
    rows of a heavy key are dealt by document and place, and its row in right is repeated for each part."""
    parts = F.ceil(F.col("n") / max(heavy, total // MANY)).cast("int")
    split = counts.select(*keys, parts.alias("parts")).where("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("did", "first"), F.col("parts")), F.lit(0)).cast("int")
    many = left.join(F.broadcast(split), keys, "left").withColumn("part", part).drop("parts")
    each = right.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return many.join(each, [*keys, "part"], how).drop("part")


def repeated(docs: DataFrame, span: int = SPAN, k: int = K, hot: int = HOT, block_words: int = BLOCK_WORDS, heavy: int = HEAVY) -> Written:
    """Intervals of repeated words (did, rk, spans) of the documents that have any. docs: did, rk, text."""
    tables = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        tables.append(Written(df, name))
        return tables[-1].read()

    light = docs.where(F.length("text") >= 2 * span - 1)
    shared = kept(light.select("did", "text").mapInArrow(partial(_anchors, span=span, k=k, full=False), "anchor bigint, did bigint").groupBy("anchor").agg(F.min("did").alias("x"), F.max("did").alias("y"), F.count("*").alias("n")).where("x < y").select("anchor", "n"), "shared")
    every = light.mapInArrow(partial(_anchors, span=span, k=k, full=True), "anchor bigint, same bigint, did bigint, rk bigint, first int, windows int")
    found = kept(_dealt(every, shared, ["anchor"], shared, _sum(shared, "n"), heavy, "left_semi"), "anchors")
    owners = kept(found.groupBy("anchor", "same").agg(F.min(F.struct("did", "rk", "first", "windows")).alias("o"), F.count("*").alias("n")).select("anchor", "same", "o.*", "n"), "owners")
    several = kept(owners.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "several")
    different = _sum(several, "n")
    wanted = _dealt(owners.drop("n"), several.withColumn("g", F.col("n")), ["anchor"], several, different, heavy).groupBy("did", "rk").agg(F.collect_list(F.struct("anchor", "same", "first", "windows", "g")).alias("wanted"))
    cut = kept(light.join(_small(wanted, different), ["did", "rk"]).dropDuplicates(["did", "rk"]).mapInArrow(partial(_cut, span=span, hot=hot), "anchor bigint, same bigint, did bigint, first int, hot boolean, values array<bigint>"), "segments")
    searched = cut.where("not hot").repartition("anchor").sortWithinPartitions("anchor", "did", "first").mapInArrow(partial(_search, span=span, block_words=block_words), INTERVALS)
    edges = cut.where("hot")
    windows = edges.select("anchor", "same", "did", "first", F.posexplode("values").alias("i", "window"))
    least = windows.groupBy("anchor", "window").agg(F.min("did").alias("least"), F.max("did").alias("most"), F.count("*").alias("n")).where("least < most").drop("most")
    settled = _dealt(windows, least, ["anchor", "window"], least, _sum(edges.select(F.size("values").alias("n")), "n"), heavy).where("did > least").select("anchor", "same", F.col("i").alias("a"), (F.col("i") + span).alias("b"))
    inner = searched.unionByName(settled).groupBy("anchor", "same").agg(F.collect_list(F.struct("a", "b")).alias("inner"))
    own = owners.select("anchor", "same", F.col("did").alias("owner"), "n").join(inner, ["anchor", "same"], "left")
    all_of_it = F.array(F.struct(F.lit(0).alias("a"), (F.col("windows") + span - 1).alias("b")))
    spans = _dealt(found, own, ["anchor", "same"], owners, _sum(owners, "n"), heavy).select("did", "rk", "first", F.explode(F.when(F.col("did") > F.col("owner"), all_of_it).otherwise(F.col("inner"))).alias("x"))
    out = Written(spans.groupBy("did", "rk").agg(F.collect_list(F.struct((F.col("first") + F.col("x.a")).alias("a"), (F.col("first") + F.col("x.b")).alias("b"))).alias("spans")), "repeats")
    for x in tables:
        x.drop()
    return out


def _merge(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _remove(batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for part in W.slices(batches, text):
        data, bounds = W.raw(W.column(part, text))
        whole = data.tobytes()
        total, removed, kept = [], [], []
        for i, spans in enumerate(part.column("spans").to_pylist()):
            words = whole[bounds[i] : bounds[i + 1]].split()  # bytes split at ASCII white space: the words of this operator
            total.append(len(words))
            gone = 0
            if spans:
                left, at = [], 0
                for a, b in _merge(spans):
                    left += words[at:a]
                    at = b
                    gone += b - a
                words = left + words[at:]
            removed.append(gone)
            kept.append(b" ".join(words))
        own = {"n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}
        yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else part.column(f.name) for f in schema], schema=schema)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), span: int = SPAN, k: int = K, hot: int = HOT, block_words: int = BLOCK_WORDS, heavy: int = HEAVY) -> DataFrame:
    """keep columns, n_words, n_removed and kept_text (the kept words joined by one space), a row for each row of docs."""
    own = T._parse_datatype_string("n_words bigint, n_removed bigint, kept_text string")
    if clash := {*keep} & {*own.fieldNames(), "did", "rk", "spans"}:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    whole = docs.select(*dict.fromkeys([*keep, text]), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(F.col(text)).alias("rk"))
    found = repeated(whole.select("did", "rk", F.col(text).alias("text")), span, k, hot, block_words, heavy).read()
    rows = found.agg(F.coalesce(F.sum(F.size("spans") + 1), F.lit(0)).alias("n")).first()["n"]
    joined = whole.join(_small(found, rows), ["did", "rk"], "left").drop("did", "rk")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in whole.schema if f.name in keep), *own])
    return joined.mapInArrow(partial(_remove, text=text, schema=to_arrow_schema(schema)), schema)
