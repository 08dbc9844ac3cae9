"""MinHash near-duplicates by tensored banding.

Two small collections of M half-keys each, a half-key being HALF minhash values, are combined pairwise into M * M tables, so 2 * M * HALF
minhash functions do the work of M * M * 2 * HALF. A pair of similarity s shares some table unless one of the collections shares no half-key:
with M = 12 and HALF = 3 that misses a pair of similarity 0.8 with probability 4e-4, one of 0.9 with 3e-7.

1. Documents with equal shingle sets become one node (pre-aggregated by a 128-bit set hash).
2. Half-keys that no other node has are dropped before the tables are formed.
3. The least node of a table bucket is its pivot; all nodes that share a bucket with a pivot make its group, so every pair that shares
   a bucket shares a group. A group's texts are dealt into blocks of about BLOCK shingles, the pivot's text to each.
4. A task turns a block's texts into full sets, keeps each as its difference to the shingles that most of the block has, and counts what
   two sets share through lists of who has a differing shingle: exact intersections, whose cost grows with what is really shared beyond the
   common part. Pairs that are in one component already are not tested, and a node gives at most one link to a component: no
   pair of texts that aren't linked ever becomes a row.
5. Groups of several blocks go through once more if they still hold several components: the nodes outside the group's largest component
   meet the group's every block, in blocks of their own. The first pass has linked most of them, so these rows are few.

Pairs within one component need no test, so no link between components is lost and no group is expanded into all its pairs.

Defined results: null, empty or wordless texts have no shingles and no links; a single word is one shingle; rows with a
null id get a null component and are kept; repeated ids are one document with several texts; equal rows get equal results; other columns than the
id and the text are not read, whatever their names; a text of any length is one set, in memory of some tens of bytes a byte; an empty
table gives an empty result. Shingles are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import words as W
from quillon.llm.components import component_table
from quillon.llm.store import Written

M, HALF = 12, 3
SHINGLE, THRESHOLD = 5, 80
BLOCK = 1 << 20  # shingles: 8 MB of sets
CHUNK = 1 << 21  # shared shingles counted at once
BROADCAST_ROWS = 300_000
_MULTIPLY = np.random.default_rng(11).integers(1, 1 << 63, 2 * M * HALF, dtype=np.uint64) | np.uint64(1)


def shingle_sets(w: W.Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    at, h = w.grams(k)
    cut = np.searchsorted(at, w.offsets)
    out = [np.unique(h[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    counts = w.counts()
    for n in range(1, k):
        few = np.flatnonzero(counts == n)
        if len(few):
            whole = W.sequences(w.hash, n)
            for i in few.tolist():
                out[i] = whole[w.offsets[i] : w.offsets[i] + 1]
    return out


def _signatures(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    for part, w in W.tables(batches, "text", W.NONSPACE, True):
        sets = shingle_sets(w, shingle)
        size = np.array([len(s) for s in sets], np.int64)
        filled = np.flatnonzero(size)
        keys = np.zeros((len(sets), 2 * M), np.uint64)
        s1, s2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
        if len(filled):
            flat = np.concatenate([sets[i] for i in filled])
            first = np.concatenate([[0], np.cumsum(size[filled])[:-1]])
            s1[filled], s2[filled] = np.add.reduceat(W.mix(flat), first), np.add.reduceat(W.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), first)
            for g in range(2 * M):
                key = np.full(len(filled), g, np.uint64)
                for j in range(g * HALF, (g + 1) * HALF):
                    least = np.minimum.reduceat(flat * _MULTIPLY[j], first)
                    key = W.mix(key * np.uint64(31) + least)
                keys[filled, g] = key
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(size), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * 2 * M), pa.array(keys.view(np.int64).ravel())).cast(longs)],
            names=["doc_id", "n", "s1", "s2", "keys"],
        )


class _Groups:
    """Components of the rows of one block, joined as links are found."""

    def __init__(self, names: np.ndarray):
        self.of = np.unique(names, return_inverse=True)[1]
        self.members = {int(c): np.flatnonzero(self.of == c).tolist() for c in np.unique(self.of)} if len(self.of) else {}

    def join(self, a: int, b: int) -> bool:
        x, y = int(self.of[a]), int(self.of[b])
        if x == y:
            return False
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        gone = self.members.pop(y)
        self.of[gone] = x
        self.members[x] += gone
        return True


def block_links(sets: list[np.ndarray], component: np.ndarray, asked: np.ndarray, threshold: int, first: int = -1) -> list[tuple[int, int]]:
    """Links (i, j) between rows of different components, enough of them to join all that are linked: i among the asked rows, j any row.

    first: a row that is tested before all others. Each set is kept as what it has beyond, and lacks of, the shingles that more than half of the
    rows have; with c common ones, |x & y| = c - |x lacks| - |y lacks| + |both lack| + |both have beyond|.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(n), size)
    shingles, code = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(code, minlength=len(shingles))
    usual = np.flatnonzero(often * 2 > n)
    place = np.full(len(shingles), -1)
    place[usual] = np.arange(len(usual))
    has = np.zeros((n, len(usual)), bool)  # at most twice as large as the sets are
    inside = place[code] >= 0
    has[row[inside], place[code[inside]]] = True
    lack_row, lack = np.nonzero(~has)
    lacks = np.bincount(lack_row, minlength=n)
    beyond = ~inside & (often[code] > 1)  # a shingle that no other row has is never shared
    rows, marks = np.concatenate([row[beyond], lack_row]), np.concatenate([code[beyond], usual[lack]])
    # lists both ways: the marks of each row, the rows of each mark; a shingle is a mark of having or of lacking, never of both
    by_row = np.argsort(rows, kind="stable")
    row_marks, row_at = marks[by_row], np.searchsorted(rows[by_row], np.arange(n + 1))
    by_mark = np.argsort(marks, kind="stable")
    mark_rows, mark_at = rows[by_mark], np.searchsorted(marks[by_mark], np.arange(len(shingles) + 1))
    groups = _Groups(component)
    out: list[tuple[int, int]] = []

    def shared(some: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of some rows with all rows."""
        count = row_at[some + 1] - row_at[some]
        who = np.repeat(np.arange(len(some)), count)
        mark = row_marks[np.repeat(row_at[some] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        length = mark_at[mark + 1] - mark_at[mark]
        other = mark_rows[np.repeat(mark_at[mark] - np.cumsum(length) + length, length) + np.arange(length.sum())]
        both = np.bincount(np.repeat(who, length) * n + other, minlength=len(some) * n).reshape(len(some), n)
        return len(usual) - lacks[some][:, None] - lacks[None, :] + both

    def test(some: np.ndarray) -> None:
        common = shared(some)
        x, y = np.nonzero((100 * common >= threshold * (size[some][:, None] + size[None, :] - common)) & (groups.of[some][:, None] != groups.of[None, :]))
        # one candidate for each row and component
        pick = np.unique(x * (n + 1) + groups.of[y], return_index=True)[1]
        for i, j in zip(some[x[pick]].tolist(), y[pick].tolist(), strict=True):
            if groups.join(i, j):
                out.append((i, j))

    if first >= 0:
        test(np.array([first]))
    weight = np.add.reduceat(np.append(mark_at[row_marks + 1] - mark_at[row_marks], 0), np.minimum(row_at[:-1], len(row_marks))) * (row_at[1:] > row_at[:-1]) + n
    todo = np.asarray(asked)
    if first >= 0:  # what the first row is linked to needs no test among itself: the others ask it
        todo = todo[groups.of[todo] != groups.of[first]]
    at, total = 0, np.cumsum(weight[todo])
    while at < len(todo):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, "right")))
        test(todo[at:to])
        at = to
    return out


def _verify(batches: Iterator[pa.RecordBatch], shingle: int, threshold: int) -> Iterator[pa.RecordBatch]:
    """Links of each block. Rows come sorted by block; the pivot has role 0, rows that are asked for all others role 1, the rest role 2."""
    now, rows, sets = None, [], []

    def links() -> tuple[list, list]:
        role = np.array([r[0] for r in rows])
        first = int(np.argmin(role)) if role.min() == 0 else -1
        found = block_links(sets, np.array([r[2] for r in rows]), np.flatnonzero(role <= 1), threshold, first)
        return [rows[i][1] for i, _ in found], [rows[j][1] for _, j in found]

    for part, w in W.tables(batches, "text", W.NONSPACE, True):
        a: list = []
        b: list = []
        columns = (part.column(n).to_pylist() for n in ("pivot", "block", "asked", "role", "doc", "component"))
        for i, (s, (pivot, block, asked, *row)) in enumerate(zip(shingle_sets(w, shingle), zip(*columns, strict=True), strict=True)):
            if (pivot, block, asked) != now:
                if len(rows) > 1:
                    for out, x in zip((a, b), links(), strict=True):
                        out += x
                now, rows, sets = (pivot, block, asked), [], []
            if len(s):
                rows.append(row)
                sets.append(s)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    if len(rows) > 1:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links()], names=["a", "b"])


def verified(docs: DataFrame, rows: DataFrame, n_rows: int, shingle: int, threshold: int) -> DataFrame:
    """Links (a, b) of every block. docs: doc_id, text. rows: doc, and the block's pivot, block, asked, role and component."""
    if n_rows <= BROADCAST_ROWS:  # checked: so many rows of six numbers; beyond, both sides are shuffled
        rows = F.broadcast(rows)
    found = docs.withColumnRenamed("doc_id", "doc").join(rows, "doc")
    return found.repartition("pivot", "block", "asked").sortWithinPartitions("pivot", "block", "asked", "role", "doc").mapInArrow(partial(_verify, shingle=shingle, threshold=threshold), "a bigint, b bigint")


def _again(members: DataFrame, parts: DataFrame, block: int) -> Written:
    """Rows for the second pass over the groups of several blocks. members: pivot, doc, block, n.

    In every block of a group with several components stand its own rows, and for each block of the nodes outside the group's largest component, dealt
    apart, these nodes as well: they ask all others.
    """
    placed = Written(members.join(parts.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc")), "placed")
    counts = placed.read().groupBy("pivot", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    largest = counts.groupBy("pivot").agg(F.max(F.struct("c", F.col("n").alias("inside"), "component")).alias("x"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    mixed = largest.select("pivot", F.col("x.component").alias("largest"), F.ceil(F.col("n") / block).alias("blocks"), F.ceil((F.col("n") - F.col("x.inside")) / block).alias("asks"))
    both = placed.read().join(mixed, "pivot")
    zero = F.lit(0).cast("long")
    outside = both.where("component <> largest")
    asks = outside.withColumn("asked", F.pmod(F.xxhash64("doc", F.lit(1)), "asks")).withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    rows = both.select("pivot", F.pmod(F.xxhash64("doc"), "blocks").alias("block"), "doc", "component", F.explode(F.sequence(zero, F.col("asks") - 1)).alias("asked")).withColumn("role", F.lit(2))
    out = Written(asks.select("pivot", "block", "asked", F.lit(1).alias("role"), "doc", "component").unionByName(rows.select("pivot", "block", "asked", "role", "doc", "component")), "again")
    placed.drop()
    return out


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs: links have 100 * shared >= threshold * total."""
    taken = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = Written(taken.mapInArrow(partial(_signatures, shingle=shingle), "doc_id bigint, n bigint, s1 bigint, s2 bigint, keys array<bigint>"), "sets")
    some = sets.read().where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    nodes = Written(some.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")), "nodes")
    halves = nodes.read().select("node", F.posexplode("keys").alias("pos", "half"))
    common = halves.groupBy("pos", "half").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    side = lambda first: F.filter(F.collect_list(F.struct("pos", "half")), lambda x: x["pos"] < M if first else x["pos"] >= M)
    kept = halves.join(common, ["pos", "half"], "left_semi").groupBy("node").agg(side(True).alias("a"), side(False).alias("b"))
    tables = Written(kept.where((F.size("a") > 0) & (F.size("b") > 0)).select("node", F.explode("a").alias("a"), "b").select("node", "a", F.explode("b").alias("b")).select("node", F.xxhash64("a.pos", "a.half", "b.pos", "b.half").alias("key")), "tables")
    buckets = tables.read().groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("c")).where("c > 1").drop("c")
    members = tables.read().join(buckets, "key").where("node != pivot").select("pivot", F.col("node").alias("doc")).distinct()
    sizes = nodes.read().groupBy(F.col("node").alias("doc")).agg(F.sum("n").alias("n"))
    pairs = Written(members.join(sizes, "doc"), "pairs")
    pivots = Written(pairs.read().groupBy("pivot").agg(F.ceil(F.sum("n") / block).alias("blocks")), "pivots")
    n_pairs, n_pivots, several = pairs.read().count(), *pivots.read().agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.max("blocks"), F.lit(0))).first()
    zero = F.lit(0).cast("long")
    dealt = pairs.read().join(pivots.read(), "pivot").select("pivot", "doc", F.pmod(F.xxhash64("doc"), "blocks").alias("block"))
    heads = pivots.read().select("pivot", F.col("pivot").alias("doc"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"))
    rows = dealt.select("*", F.lit(1).alias("role")).unionByName(heads.select("*", F.lit(0).alias("role"))).select("pivot", "block", zero.alias("asked"), "role", "doc", F.col("doc").alias("component"))
    links = Written(verified(taken, rows, n_pairs + n_pivots, shingle, threshold), "links")
    parts = component_table(links.read(), "a", "b")
    if several > 1:
        again = _again(dealt.join(pivots.read().where("blocks > 1"), "pivot", "left_semi").join(sizes, "doc"), parts.read(), block)
        if n_rows := again.read().count():
            more = Written(verified(taken, again.read(), n_rows, shingle, threshold).unionByName(links.read()), "links")
            after = component_table(more.read(), "a", "b")
            for x in (links, parts):
                x.drop()
            links, parts = more, after
        again.drop()
    placed = nodes.read().select("s1", "s2", "n", "node").join(parts.read(), "node", "left").select("s1", "s2", "n", F.coalesce("component", "node").alias("component_id"))
    found = sets.read().select("doc_id", "n", "s1", "s2").join(placed, ["s1", "s2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    out = Written(found, "components")
    for x in (sets, nodes, tables, pairs, pivots, links, parts):
        x.drop()
    return out.read()
