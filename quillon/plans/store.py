"""Indexes as Parquet tables: references by partition key, inverted lists by centroid, and a row of parameters that names the format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.config import Ivf
from quillon.operators import ivf

EXACT, IVF = "quillon-exact-1", "quillon-ivf-1"


def _mark(spark: SparkSession, path: str, row: tuple, schema: str) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/params")


def _check(spark: SparkSession, path: str, magic: str) -> dict:
    params = spark.read.parquet(f"{path}/params").first().asDict()
    if params["magic"] != magic:
        raise ValueError(f"{path} holds {params['magic']}, not {magic}")
    return params


def save_exact(refs: DataFrame, path: str, k: int = 5) -> None:
    """refs: ref_id, fraud, part_key and the vector. A key's rows may fill many files: a hot key is not one task's work."""
    refs.write.mode("overwrite").partitionBy("part_key").parquet(f"{path}/refs")
    _mark(refs.sparkSession, path, (EXACT, k), "magic string, k int")


def load_exact(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/refs"), _check(spark, path, EXACT)


def save_ivf(assigned: DataFrame, centroids: DataFrame, path: str, nprobe: int, k: int) -> None:
    assigned.write.mode("overwrite").partitionBy("centroid_id").parquet(f"{path}/lists")
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    _mark(assigned.sparkSession, path, (IVF, nprobe, k, assigned.count()), "magic string, nprobe int, k int, n bigint")


def load_ivf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    params = _check(spark, path, IVF)
    return spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/centroids"), params


def build_ivf(refs: DataFrame, path: str, params: Ivf = Ivf()) -> None:
    """From references (ref_id, fraud, vectors) to a saved index: k-means, the lists of its last assignment, and the centroids."""
    centroids, assigned, _ = ivf.kmeans(refs, params)
    save_ivf(assigned, ivf.centroid_table(refs.sparkSession, centroids), path, params.nprobe, params.k)
