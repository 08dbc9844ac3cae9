"""k-means and an inverted-list index over 8-bit vectors.

A centroid table has at most a few thousand rows by choice of the caller, so it is collected and shipped; vectors never are. Ties go to the smaller centroid
or reference id. Centroids keep single-precision means between rounds and are truncated to whole numbers for every comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.config import Ivf, U
from quillon.functions.features import f32
from quillon.operators.knn import neighbours, votes
from quillon.operators.ranks import ranked

MOST = 32


def picks(n: int, k: int, seed: int = Ivf.seed) -> list[int]:
    """k draws of a row number below n, with replacement: a 64-bit xorshift by 13, 7 and 17."""
    if n < k:
        raise ValueError("fewer vectors than centroids")
    mask, x, out = (1 << 64) - 1, seed, []
    for _ in range(k):
        x ^= x << 13 & mask
        x ^= x >> 7
        x ^= x << 17 & mask
        out.append(x % n)
    return out


def numbered(vectors: DataFrame, order: str = "ref_id") -> DataFrame:
    """vectors with row_idx, dense from 0 by the order column."""
    return ranked(vectors, [], [order])


def _points(centroids: list[list[float]]) -> np.ndarray:
    """Truncated to whole numbers of 8 bits."""
    return np.clip(np.trunc(np.array(centroids, np.float32)), 0, 255).astype(np.float64)


def _closest(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The nearest point of each row, the lowest of equals; a row's own square is the same for all points."""
    return ((points * points).sum(axis=1)[None, :] - 2.0 * (x @ points.T)).argmin(axis=1)


def _assign(batches: Iterator[pa.RecordBatch], shipped, columns: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    points = shipped.value
    for batch in batches:
        x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], axis=1)
        best = _closest(x, points).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(best) if f.name == "centroid_id" else batch.column(f.name) for f in schema], schema=schema)


def assign(vectors: DataFrame, centroids: list[list[float]], columns: list[str] = U) -> DataFrame:
    """vectors with centroid_id, the nearest truncated centroid, the lowest of equals."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shipped = vectors.sparkSession.sparkContext.broadcast(_points(centroids))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in vectors.schema if f.name != "centroid_id"), T.StructField("centroid_id", T.IntegerType())])
    return vectors.select(*(c for c in vectors.columns if c != "centroid_id")).mapInArrow(partial(_assign, shipped=shipped, columns=columns, schema=to_arrow_schema(schema)), schema)


def _single(x: Column) -> Column:
    """x rounded to single precision. The product keeps the cast: Spark folds a cast of bigint to float under one to double into a cast to double."""
    return x.cast("float") * f32(1)


def means(assigned: DataFrame, columns: list[str] = U) -> DataFrame:
    """centroid_id, n and the single-precision means m_u0.. of its vectors: sums and counts are rounded before they are divided."""
    return assigned.groupBy("centroid_id").agg(F.count("*").alias("n"), *((_single(F.sum(c)) / _single(F.count("*"))).cast("float").alias(f"m_{c}") for c in columns))


def _round(batches: Iterator[pa.RecordBatch], shipped, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """One row for each centroid and task: its vectors, those that were elsewhere before, and their sums."""
    now, before = shipped.value
    total = np.zeros((len(now), 2 + len(columns)), np.int64)
    for batch in batches:
        x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], axis=1)
        best, old = _closest(x, now), _closest(x, before) if before is not None else 0
        np.add.at(total, best, np.concatenate([np.ones((len(x), 1), np.int64), (best != old)[:, None], x], axis=1))
    some = np.flatnonzero(total[:, 0])
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(x) for x in total[some].T)], names=["centroid_id", "n", "changed", *columns])


def kmeans(vectors: DataFrame, params: Ivf = Ivf(), columns: list[str] = U) -> tuple[list[list[float]], DataFrame, list[dict]]:
    """Centroids after the last update, the vectors with the last assignment, and a log row for each round.

    A round is one pass over the vectors, in one job: each task assigns its vectors to the centroids of this round and of the one before, and gives
    counts, changes and sums by centroid. The last assignment may lag the centroids by an update.
    """
    rows = numbered(vectors.select("ref_id"))
    n = vectors.count()
    drawn = picks(n, params.centroids, params.seed)
    names = {r["row_idx"]: r["ref_id"] for r in rows.where(F.col("row_idx").isin(drawn)).collect()}  # at most one row for each centroid
    chosen = {r["ref_id"]: [float(r[c]) for c in columns] for r in vectors.where(F.col("ref_id").isin([*names.values()])).select("ref_id", *columns).collect()}
    now = [chosen[names[i]] for i in drawn]
    spark, plain = vectors.sparkSession, vectors.select(*columns)
    sums = "centroid_id int, n bigint, changed bigint, " + ", ".join(f"{c} bigint" for c in columns)
    log: list[dict] = []
    used = before = None
    for step in range(1, params.iterations + 1):
        used, shipped = now, spark.sparkContext.broadcast((_points(now), before))
        found = plain.mapInArrow(partial(_round, shipped=shipped, columns=columns), sums).groupBy("centroid_id").agg(*(F.sum(c).alias(c) for c in ("n", "changed", *columns))).collect()
        for r in found:  # one row for each centroid
            now = [*now[: r["centroid_id"]], [float(np.float32(r[c]) / np.float32(r["n"])) for c in columns], *now[r["centroid_id"] + 1 :]]
        changed = sum(r["changed"] for r in found)
        log.append({"iteration": step, "changed": changed, "percent": 100.0 * changed / n})
        before = _points(used)
        if not changed:
            break
    return now, assign(vectors, used, columns), log


def centroid_table(spark: SparkSession, centroids: list[list[float]], columns: list[str] = U) -> DataFrame:
    """centroid_id and the truncated centroid."""
    rows = [(i, *(int(min(max(x, 0.0), 255.0)) for x in c)) for i, c in enumerate(centroids)]
    return spark.createDataFrame(rows, "centroid_id int, " + ", ".join(f"{c} int" for c in columns))


def buckets(assigned: DataFrame, centroids: int) -> DataFrame:
    """centroid_id, len and start of each inverted list, empty ones too."""
    ids = assigned.sparkSession.range(centroids).select(F.col("id").cast("int").alias("centroid_id"))
    counts = assigned.groupBy("centroid_id").agg(F.count("*").alias("len"))
    full = ids.join(counts, "centroid_id", "left").select("centroid_id", F.coalesce("len", F.lit(0)).cast("bigint").alias("len"))
    return full.select("centroid_id", "len", (F.sum("len").over(Window.orderBy("centroid_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("len")).alias("start"))  # one row for each centroid


def probes(queries: DataFrame, centroids: list[list[float]], nprobe: int, columns: list[str] = U) -> DataFrame:
    """query_id, centroid_id and probe rank of the nprobe nearest centroids: one array expression for each row, nothing is joined."""
    points = [[int(min(max(x, 0.0), 255.0)) for x in c] for c in centroids]
    table = F.array(*(F.struct(sum((F.pow(F.col(c) - v, 2) for c, v in zip(columns, p, strict=True)), F.lit(0.0)).cast("bigint").alias("dist"), F.lit(i).alias("centroid_id")) for i, p in enumerate(points)))
    near = F.slice(F.array_sort(table), 1, min(nprobe, MOST, len(points))) if nprobe > 0 else F.slice(table, 1, 0)
    return queries.select("query_id", *columns, F.posexplode(near).alias("probe", "_c")).select("query_id", *columns, "probe", F.col("_c.centroid_id").alias("centroid_id"), F.col("_c.dist").alias("centroid_dist"))


def ivf_neighbours(queries: DataFrame, assigned: DataFrame, centroids: list[list[float]], nprobe: int, k: int, columns: list[str] = U) -> DataFrame:
    """The k nearest among the vectors of the probed lists."""
    k = min(k, MOST)
    if not k or nprobe < 1:
        return neighbours(queries.limit(0).withColumn("centroid_id", F.lit(0)), assigned, 1, columns, "centroid_id", "join")
    # a query stands once for each list that it probes, so one pass serves all probes
    return neighbours(probes(queries, centroids, nprobe, columns), assigned, k, columns, "centroid_id")


def ivf_votes(queries: DataFrame, assigned: DataFrame, centroids: list[list[float]], nprobe: int, k: int, columns: list[str] = U) -> DataFrame:
    return votes(queries, ivf_neighbours(queries, assigned, centroids, nprobe, k, columns))


def index_bytes(n: int, centroids: int) -> int:
    """17 for a vector and its label, 24 for a centroid and its list, 32 for the header."""
    return 17 * n + 24 * centroids + 32
