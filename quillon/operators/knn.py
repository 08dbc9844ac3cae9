"""Exact nearest neighbours within a partition key, and votes.

Ties go to the smaller reference id. Fewer than k references leave the missing votes with the legitimate side: the divisor stays k. Rows without a
key have no neighbours. Four strategies give equal results:

* ``blocks``, the default: up to ``block`` queries, by their count, are shipped to the references, which stay where they lie; more go as ``shuffle``.
* ``shuffle``: the references of a key are dealt by their vectors into blocks of about ``ref_block`` rows, so a hot key is many tasks; every query
  goes to each block of its key. A task holds one block of references and some thousand queries; nothing passes the driver.
* ``cells``: as ``shuffle``, with whole median-split cells (kdcells.py) in a block: a query skips every cell whose box lies beyond its k-th distance.
* ``join``: plain DataFrame operations, for small sets.

In the first two, equal vectors are one point with the ids that can be among the k nearest of any query (at most 2k, before any shuffle of
references too, so a vector that very many rows have is no task's load), points are cut into small cells by medians inside the task, and groups of
queries near each other visit the cells in the order of the distance between boxes, until no query of the group can gain. That is exact, ties included.

All keep k rows for each query and task before the last shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.config import DIMENSIONS, Q
from quillon.functions.quantize import squared_distance

QUERY_BLOCK, REF_BLOCK = 20_000, 200_000
ROWS, COLS = 1024, 4096  # of a matrix of distances
GROUP, LEAF, HELD = 128, 64, 50_000  # queries that search together, points of a cell, queries held before a search
NEIGHBOUR = "query_id bigint, ref_id bigint, dist bigint, fraud int"
NAMES = ["query_id", "ref_id", "dist", "fraud"]


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], axis=1)


def _needed(ids: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, start of each point in them): the rows that some query can have among its k nearest, those of equal vectors side by side, by id.

    Of equal vectors that are the first k rows of other ids than the query's: k rows of an id and 2k in all hold them. Vectors are sorted by a
    hash and compared in full, so a collision costs room, never a row.
    """
    weights = np.random.default_rng(14).integers(1, 1 << 62, points.shape[1])
    order = np.lexsort((ids, (points.astype(np.int64) * weights).sum(axis=1)))
    place = lambda new: np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    new = lambda rows: np.concatenate([[True], (points[rows[1:]] != points[rows[:-1]]).any(axis=1)])[: len(rows)]
    again = np.concatenate([[True], ids[order[1:]] != ids[order[:-1]]])[: len(order)]
    order = order[place(new(order) | again) < k]
    order = order[place(new(order)) < 2 * k]
    return order, np.flatnonzero(new(order))


def _leaves(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows halved at the median of their widest column until a run has most rows or all are equal."""
    order, starts, todo = np.arange(len(points)), [], [(0, len(points))]
    while todo:
        a, b = todo.pop()
        mine = points[order[a:b]]
        width = np.ptp(mine, axis=0) if b - a > most else np.zeros(1)
        if not width.any():
            starts.append(a)
            continue
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(mine[:, width.argmax()], half)]
        todo += [(a + half, b), (a, a + half)]
    return order, np.array(starts)


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start..start + count of every run, one after another."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


class References:
    """A block of references: ids, labels, points and the box of each run of points of one cell.

    With given cells a row is a point; else equal vectors are one, with count ids from first on, for searches of k at most.
    """

    def __init__(self, ids: np.ndarray, fraud: np.ndarray, points: np.ndarray, k: int, cells: np.ndarray | None = None):
        self.celled = cells is not None
        if self.celled:
            order = np.argsort(cells, kind="stable")
            ids, fraud, points, cells = ids[order], fraud[order], points[order], cells[order]
            self.start = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        else:
            order, first = _needed(ids, points, k)
            ids, fraud, points = ids[order], fraud[order], points[order[first]]
            order, self.start = _leaves(points, LEAF)
            self.count = np.diff([*first, len(ids)])[order]
            self.first, points = first[order], points[order]
            self.alone = ids[self.first] == ids[self.first + self.count - 1]  # ids are sorted: a point of one id
        self.low, self.high = np.minimum.reduceat(points, self.start), np.maximum.reduceat(points, self.start)
        self.size = np.diff([*self.start, len(points)])
        self.ids, self.fraud, self.points, self.norm = ids, fraud, points, (points * points).sum(axis=1)

    def distances(self, ids: np.ndarray, points: np.ndarray, a: int, b: int) -> np.ndarray:
        """Squared distances to the rows a:b; no row is its own neighbour. Sums below 2**53 are exact in doubles."""
        d = (points * points).sum(axis=1)[:, None] + self.norm[a:b] - 2.0 * (points @ self.points[a:b].T)
        d[ids[:, None] == self.ids[a:b]] = np.inf
        return d

    def found(self, rows: np.ndarray, d: np.ndarray, a: int, k: int, most: np.ndarray | None = None) -> tuple:
        """(query, distance, reference, label) of the k nearest in each row of distances, all that tie at the k-th place, none beyond most."""
        take = min(k, d.shape[1])
        edge = np.partition(d, take - 1, axis=1)[:, take - 1]
        x, y = np.nonzero((d <= (edge if most is None else np.minimum(edge, most))[:, None]) & np.isfinite(d))
        return rows[x], d[x, y].astype(np.int64), self.ids[a + y], self.fraud[a + y]

    def nearest(self, ids: np.ndarray, points: np.ndarray, k: int) -> tuple:
        """The k nearest of every query, as (place of the query, distance, reference, label), sorted."""
        if self.celled:
            groups = [np.arange(q, min(q + ROWS, len(ids))) for q in range(0, len(ids), ROWS)]
        else:
            order, starts = _leaves(points, GROUP)  # more than GROUP equal queries stay one run: cut by count
            groups = [order[q : min(q + ROWS, b)] for a, b in zip(starts, [*starts[1:], len(ids)], strict=True) for q in range(a, b, ROWS)]
        got = [(self._pruned if self.celled else self._visited)(rows, ids, points, k) for rows in groups]
        return _kept(got, k)

    def _visited(self, rows: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int) -> tuple:
        """The k nearest of a group of queries: cells by the distance of their box from the group's, up to the farthest k-th neighbour."""
        own, points = ids[rows], points[rows]
        norm = (points * points).sum(axis=1)
        gap = np.maximum(np.maximum(self.low - points.max(axis=0), points.min(axis=0) - self.high), 0)
        bound = (gap * gap).sum(axis=1)
        order = bound.argsort(kind="stable")
        bound, ends = bound[order], self.size[order].cumsum()
        most, best = np.full(len(rows), np.inf), _kept([], k)  # most: the k-th distance so far
        at, take = 0, 4 * LEAF
        while at < len(order):
            asks = np.flatnonzero(most >= bound[at])  # a box as far as the k-th neighbour may hold a tie
            if not len(asks):
                break
            last = min(np.searchsorted(bound, most.max(), "right"), np.searchsorted(ends, (ends[at - 1] if at else 0) + take) + 1)
            cells = order[at:last]
            at, take = last, min(2 * take, COLS)
            at_points = _runs(self.start[cells], self.size[cells])
            d = norm[asks][:, None] + self.norm[at_points] - 2.0 * (points[asks] @ self.points[at_points].T)
            edge = most[asks]
            if np.isinf(edge).any():
                far = np.where(self.alone[at_points] & (own[asks][:, None] == self.ids[self.first[at_points]]), np.inf, d)
                edge = np.minimum(edge, np.partition(far, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1])
            x, y = np.nonzero(d <= edge[:, None])
            if not len(x):
                continue
            point, asked = at_points[y], asks[x]
            row, n = _runs(self.first[point], self.count[point]), self.count[point]
            part = np.repeat(asked, n), np.repeat(d[x, y].astype(np.int64), n), self.ids[row], self.fraud[row]
            other = part[2] != own[part[0]]
            best = _kept([best, tuple(v[other] for v in part)], k)
            n = np.bincount(best[0], minlength=len(rows))
            full = np.flatnonzero(n >= k)
            most[full] = best[1][np.cumsum(n)[full] - 1]
        return rows[best[0]], *best[1:]

    def _pruned(self, rows: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int) -> tuple:
        bound = np.zeros((len(rows), len(self.start)))
        for j in range(points.shape[1]):
            x = points[rows, j][:, None]
            bound += np.maximum(np.maximum(self.low[:, j] - x, x - self.high[:, j]), 0) ** 2
        first = bound.argmin(axis=1)
        end = np.append(self.start[1:], len(self.ids))
        got = []
        for c in np.unique(first).tolist():
            mine = np.flatnonzero(first == c)
            got.append(self.found(rows[mine], self.distances(ids[rows[mine]], points[rows[mine]], self.start[c], end[c]), self.start[c], k))
        best = _kept(got, k)
        at, last, n = np.unique(best[0][::-1], return_index=True, return_counts=True)
        most = np.full(len(rows), np.inf)  # the k-th distance, where the first cell gives k
        most[at[n == k] - rows[0]] = best[1][::-1][last[n == k]]
        bound[np.arange(len(rows)), first] = np.inf
        got = [best]
        for c in np.flatnonzero((bound <= most[:, None]).any(axis=0)).tolist():  # a box as far as the k-th neighbour may hold a tie
            mine = np.flatnonzero((bound[:, c] <= most) & np.isfinite(bound[:, c]))
            if len(mine):
                got.append(self.found(rows[mine], self.distances(ids[rows[mine]], points[rows[mine]], self.start[c], end[c]), self.start[c], k, most[mine]))
        return _kept(got, k)


def _kept(parts: list[tuple], k: int) -> tuple:
    """The k first by distance, then reference, of every query."""
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    new = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((new[2], new[1], new[0]))
    new = tuple(x[order] for x in new)
    start = np.flatnonzero(np.concatenate([[True], new[0][1:] != new[0][:-1]])) if len(new[0]) else np.zeros(0, int)
    place = np.arange(len(new[0])) - np.repeat(start, np.diff([*start, len(new[0])]))
    return tuple(x[place < k] for x in new)


def _batch(ids: np.ndarray, best: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[best[0]], pa.int64()), pa.array(best[2], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[3].astype(np.int32))], names=NAMES)


def _pieces(batches: Iterator[pa.RecordBatch], rows: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches joined to pieces of about rows rows, fewer if vectors are wide."""
    held, n, rows = [], 0, rows * DIMENSIONS // max(len(columns), DIMENSIONS)
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _by_key(keys: np.ndarray) -> Iterator[tuple]:
    """Each key and the places of its rows."""
    values, which = np.unique(keys, return_inverse=True)
    order = np.argsort(which, kind="stable")
    yield from zip(values, np.split(order, np.cumsum(np.bincount(which, minlength=len(values)))[:-1]), strict=True)


def _nearest(batches: Iterator[pa.RecordBatch], shipped, columns: list[str], key: str, k: int, ref_block: int) -> Iterator[pa.RecordBatch]:
    """For each shipped query the k nearest of this task's references that share its key."""
    ids, keys, points = shipped.value
    where = {g: np.flatnonzero(keys == g) for g in np.unique(keys)}
    best: dict = {}
    for batch in _pieces(batches, ref_block, columns):
        refs = _matrix(batch, columns)
        ref_id, fraud = batch.column("ref_id").to_numpy(), batch.column("fraud").to_numpy(zero_copy_only=False)
        for g, mine in _by_key(batch.column(key).to_numpy(zero_copy_only=False)):
            if g in where:
                q = where[g]
                place, *rest = References(ref_id[mine], fraud[mine], refs[mine], k).nearest(ids[q], points[q], k)
                best[g] = _kept([*([best[g]] if g in best else []), (q[place], *rest)], k)
    for found in best.values():
        if len(found[0]):
            yield _batch(ids, found)


def _combined(batches: Iterator[pa.RecordBatch], columns: list[str], key: str, k: int, ref_block: int) -> Iterator[pa.RecordBatch]:
    """The references without those that no query can have among its k nearest, as far as one piece of this task shows them."""
    for batch in _pieces(batches, ref_block, columns):
        ids, points = batch.column("ref_id").to_numpy(), _matrix(batch, columns)
        rows = [mine[_needed(ids[mine], points[mine], k)[0]] for _, mine in _by_key(batch.column(key).to_numpy(zero_copy_only=False))]
        yield batch.take(pa.array(np.sort(np.concatenate(rows))))


def _streamed(batches: Iterator[pa.RecordBatch], columns: list[str], key: str, k: int, celled: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and block, the references of a block before its queries."""
    now, held, asked, refs = None, [], [], None

    def answered() -> Iterator[pa.RecordBatch]:
        nonlocal asked
        if asked and refs is not None:
            ids, points = (np.concatenate(x) for x in zip(*asked, strict=True))
            found = refs.nearest(ids, points, k)
            if len(found[0]):
                yield _batch(ids, found)
        asked = []

    for batch in batches:
        keys, block, side = (batch.column(n).to_numpy(zero_copy_only=False) for n in (key, "_block", "_side"))
        cut = np.flatnonzero((keys[1:] != keys[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
        for a, b in zip([0, *cut], [*cut, len(keys)], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if (keys[a], block[a]) != now:
                yield from answered()
                now, held, refs = (keys[a], block[a]), [], None
            ids, points = part.column("_id").to_numpy(), _matrix(part, columns)
            if side[a] == 0:
                held.append((ids, part.column("fraud").to_numpy(zero_copy_only=False), points, *([part.column("cell").to_numpy(zero_copy_only=False)] if celled else [])))
                continue
            if refs is None and held:
                ref_id, fraud, at, *cell = (np.concatenate(x) for x in zip(*held, strict=True))
                refs, held = References(ref_id, fraud, at, k, *cell), []
            asked.append((ids, points))
            if sum(len(x[0]) for x in asked) >= HELD:
                yield from answered()
    yield from answered()


def _shuffled(queries: DataFrame, refs: DataFrame, k: int, columns: list[str], key: str, ref_block: int, celled: bool) -> DataFrame:
    """Blocks of equal vectors (of whole cells). Their tasks compute much on few bytes, so the number of partitions is given: none are coalesced."""
    spark = refs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    blocks = refs.groupBy(key).agg(F.ceil(F.count("*") / ref_block).alias("_blocks"))
    cell = ["cell"] if celled else []
    if not celled:
        refs = refs.mapInArrow(partial(_combined, columns=columns, key=key, k=k, ref_block=ref_block), refs.schema)
    r = refs.join(blocks, key).select(key, F.pmod(F.xxhash64(*(cell or columns)), "_blocks").alias("_block"), F.lit(0).alias("_side"), F.col("ref_id").alias("_id"), "fraud", *cell, *columns)
    q = queries.join(blocks, key).select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"), F.lit(1).alias("_side"), F.col("query_id").alias("_id"), F.lit(0).alias("fraud"), *(F.lit("").alias(c) for c in cell), *columns)
    both = r.unionByName(q).repartition(tasks, key, "_block").sortWithinPartitions(key, "_block", "_side")
    return both.mapInArrow(partial(_streamed, columns=columns, key=key, k=k, celled=celled), NEIGHBOUR)


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("dist", "ref_id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbours(queries: DataFrame, refs: DataFrame, k: int = 5, columns: list[str] = Q, key: str = "part_key", strategy: str = "blocks", block: int = QUERY_BLOCK, ref_block: int = REF_BLOCK) -> DataFrame:
    """query_id, ref_id, dist, fraud, rank. queries: query_id, key, columns; refs: ref_id, fraud, key, columns (and cell for ``cells``)."""
    if strategy == "join":
        a = queries.select("query_id", key, *(F.col(c).alias(f"_{c}") for c in columns))
        pairs = refs.join(a, key).where("ref_id <> query_id")
        found = pairs.select("query_id", "ref_id", squared_distance([F.col(c) for c in columns], [F.col(f"_{c}") for c in columns]).alias("dist"), "fraud")
        return _ranked(found, k)
    asked = queries.select("query_id", key, *columns).where(F.col(key).isNotNull())
    taken = refs.select("ref_id", "fraud", key, *(["cell"] if strategy == "cells" else []), *columns).where(F.col(key).isNotNull())
    if strategy != "blocks" or asked.count() > block:
        return _ranked(_shuffled(asked, taken, k, columns, key, ref_block, strategy == "cells"), k)
    rows = asked.toPandas()  # checked: one block at most
    shipped = refs.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(np.int64), rows[key].to_numpy(), rows[columns].to_numpy(np.float64)))
    return _ranked(taken.mapInArrow(partial(_nearest, shipped=shipped, columns=columns, key=key, k=k, ref_block=ref_block), NEIGHBOUR), k)


def votes(queries: DataFrame, found: DataFrame) -> DataFrame:
    """query_id and fraud_votes; a query without neighbours has 0."""
    counts = found.groupBy("query_id").agg(F.sum("fraud").alias("n"))
    return queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("fraud_votes"))


def decisions(voted: DataFrame, k: int = 5, declined_from: int = 3) -> DataFrame:
    """query_id, fraud_votes, approved, fraud_score and the JSON response; scores are defined for k of 5 at most."""
    if k > 5:
        raise ValueError("decisions are defined for k of 5 at most; use the votes")
    out = voted.withColumns({"approved": F.col("fraud_votes") < declined_from, "fraud_score": F.col("fraud_votes") / F.lit(5.0)})
    return out.withColumn("response", F.to_json(F.struct("approved", "fraud_score")))
