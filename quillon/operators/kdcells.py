"""Median-split cells over a partition key, an accelerator for exact search.

A cell of more than ``leaf`` rows is cut at the middle of its rows in the order of its widest dimension, the smaller half (rounded down) to the left;
equal values go by id, so both halves have their number whatever the values are. Cells of more than ``task_rows`` rows are cut by
ranks that many tasks count, a level at a time; smaller ones are cut down to the leaves inside one task each.
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

from quillon.config import Q
from quillon.operators.knn import neighbours
from quillon.operators.ranks import ranked
from quillon.operators.stats import bounding_boxes, widest_dimension
from quillon.plans.shared import shared_path

LEAF, TASK_ROWS = 64, 1 << 17


def paths(ids: np.ndarray, points: np.ndarray, leaf: int) -> list[str]:
    """The path of bits of every row of one cell."""
    out = np.full(len(ids), "", object)
    todo = [(np.argsort(ids, kind="stable"), "")]
    while todo:
        rows, path = todo.pop()
        if len(rows) <= leaf:
            out[rows] = path
            continue
        x = points[rows].astype(object) if len(rows) > 1 << 31 else points[rows]
        spread = len(rows) * (x * x).sum(axis=0).astype(object) - x.sum(axis=0).astype(object) ** 2
        widest = max(range(len(spread)), key=lambda j: (spread[j], -j))
        rows = rows[np.argsort(points[rows, widest], kind="stable")]
        todo += [(np.sort(rows[: len(rows) // 2]), path + "0"), (np.sort(rows[len(rows) // 2 :]), path + "1")]
    return out.tolist()


def _split(batches: Iterator[pa.RecordBatch], columns: list[str], leaf: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell and id."""

    def cut(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        cell = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        points = np.stack([cell.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], axis=1)
        found = paths(cell.column("ref_id").to_numpy(), points, leaf)
        name = cell.column("cell")[0].as_py()
        return pa.RecordBatch.from_arrays([pa.array([name + x for x in found], pa.string()) if f.name == "cell" else cell.column(f.name) for f in schema], schema=schema)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        cells = batch.column("cell").to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(cells[1:] != cells[:-1]) + 1
        for a, b in zip([0, *edge], [*edge, len(cells)], strict=True):
            if a == b:
                continue
            if held and held[0].column("cell")[0].as_py() != cells[a]:
                yield cut(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield cut(held)


def with_cells(refs: DataFrame, leaf: int = LEAF, columns: list[str] = Q, task_rows: int = TASK_ROWS) -> DataFrame:
    """refs with the string column cell: the key and a path of bits. No cell has more than leaf rows. Rows without a key are left out."""
    spark = refs.sparkSession
    now = refs.where(F.col("part_key").isNotNull()).withColumn("cell", F.concat(F.col("part_key").cast("string"), F.lit("/")))
    while True:
        large = now.groupBy("cell").agg(F.count("*").alias("_n")).where(F.col("_n") > task_rows)
        path = shared_path(spark, "large-cells")
        large.write.parquet(path)
        large = spark.read.parquet(path)
        if large.isEmpty():
            break
        wide = widest_dimension(now.join(large, "cell", "left_semi"), "cell", columns)
        value = F.element_at(F.array(*(F.col(c).cast("bigint") for c in columns)), F.col("dimension") + 1)
        placed = ranked(now.join(large, "cell").join(wide, "cell").withColumn("_value", value), ["cell"], ["_value", "ref_id"])
        side = F.when(F.col("row_idx") < F.floor(F.col("_n") / 2), "0").otherwise("1")
        split = placed.withColumn("cell", F.concat("cell", side)).select(now.columns)
        path = shared_path(spark, "level")
        split.unionByName(now.join(large, "cell", "left_anti").select(now.columns)).write.parquet(path)
        now = spark.read.parquet(path)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in now.schema])
    return now.repartition("cell").sortWithinPartitions("cell", "ref_id").mapInArrow(partial(_split, columns=columns, leaf=leaf, schema=to_arrow_schema(schema)), schema)


def cells(refs: DataFrame, columns: list[str] = Q) -> DataFrame:
    """A row for each cell: key, count and box."""
    counts = refs.groupBy("cell").agg(F.first("part_key").alias("part_key"), F.count("*").alias("n"))
    return counts.join(bounding_boxes(refs, "cell", columns), "cell")


def build_counts(refs: DataFrame) -> DataFrame:
    """part_key, vectors, leaves and nodes of the trees whose leaves are the cells: every inner node has two children."""
    leaves = refs.groupBy("part_key", "cell").agg(F.count("*").alias("n"))
    return leaves.groupBy("part_key").agg(F.sum("n").alias("vectors"), F.count("*").alias("leaves"), (2 * F.count("*") - 1).alias("nodes"))


def neighbours_by_cells(queries: DataFrame, refs: DataFrame, k: int = 5, columns: list[str] = Q, **dealt) -> DataFrame:
    """As a full scan; refs have cells."""
    return neighbours(queries, refs, k, columns, strategy="cells", **dealt)
