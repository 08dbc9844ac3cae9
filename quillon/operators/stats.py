"""Statistics of labelled, quantised vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.config import Q


def label_counts(labelled: DataFrame) -> DataFrame:
    """Rows, fraud, legit and the share of fraud in per cent."""
    return labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("fraud"), F.lit(0)).cast("bigint").alias("n_fraud")).select("n", "n_fraud", (F.col("n") - F.col("n_fraud")).alias("n_legit"), F.when(F.col("n") > 0, 100.0 * F.col("n_fraud") / F.col("n")).alias("fraud_percent"))


def partition_counts(refs: DataFrame, key: str = "part_key") -> DataFrame:
    return refs.groupBy(key).agg(F.count("*").alias("n"))


def bounding_boxes(refs: DataFrame, key: str = "part_key", columns: list[str] = Q) -> DataFrame:
    return refs.groupBy(key).agg(*(f(c).alias(f"{p}_{c}") for c in columns for p, f in (("min", F.min), ("max", F.max))))


def widest_dimension(refs: DataFrame, key: str = "part_key", columns: list[str] = Q) -> DataFrame:
    """The dimension of the greatest population variance, the lowest of equals; compared exactly as n * sum(x^2) - sum(x)^2."""
    d = lambda x: x.cast("decimal(38,0)")
    sums = refs.groupBy(key).agg(F.count("*").alias("n"), *(s for c in columns for s in (F.sum(c).alias(f"s_{c}"), F.sum(F.col(c).cast("bigint") * F.col(c)).alias(f"ss_{c}"))))
    spread = {f"w_{c}": (d(F.col("n")) * d(F.col(f"ss_{c}")) - d(F.col(f"s_{c}")) * d(F.col(f"s_{c}"))).cast("decimal(38,0)") for c in columns}
    wide = sums.withColumns(spread)
    most = F.greatest(*(F.col(w) for w in spread))
    pick = reduce(lambda rest, i: F.when(F.col(f"w_{columns[i]}") == most, i).otherwise(rest), range(len(columns) - 1, -1, -1), F.lit(0))
    return wide.select(key, pick.cast("int").alias("dimension"))
