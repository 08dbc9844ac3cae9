"""Connected components without collecting edges, links or components to the driver.

At most ``SMALL`` edges, by their count, are joined in one executor task (some tens of MB); any more by alternating large and small stars. Each round of stars joins every edge with its node's least neighbour (an aggregate with map-side combining and a join that Spark can split
where a node has very many edges) and is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.store import Written

SMALL = 500_000


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least reachable node of each node: labels sink along edges and jump along labels until nothing moves."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not sum(len(u) for u, _ in parts):
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    names, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], names=["node", "component"])


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40)))).first()
    return tuple(row)


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def component_table(edges: DataFrame, a: str, b: str, small: int = SMALL) -> Written:
    """(node, component): for each node of an edge the least node it reaches. Null ends and loops are ignored."""
    now = Written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "edges")
    if now.read().count() <= small:
        found = Written(now.read().coalesce(1).mapInArrow(_join, "node bigint, component bigint"), "components")
        now.drop()
        return found
    mark = None
    while True:
        found = _mark(now.read())
        if found == mark or not found[0]:
            break
        mark = found
        step = Written(_stars(now.read(), True), "stars")
        then = Written(_stars(step.read(), False), "stars")
        step.drop()
        now.drop()
        now = then
    stars = now.read()
    out = Written(stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    now.drop()
    return out


def components(edges: DataFrame, a: str, b: str, small: int = SMALL) -> DataFrame:
    return component_table(edges, a, b, small).read()
