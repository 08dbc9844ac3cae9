"""Dense ranks of a whole table without a sort of all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.shared import shared_path

RANGE_ROWS, RANGES = 1_000_000, 16


def ranked(rows: DataFrame, groups: list[str], order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with row_idx, dense from 0 by the order within each group (within the whole table without groups).

    Rows are dealt into ranges of the order of about range_rows rows, by sampled bounds, and written, since such bounds may differ
    from run to run; a rank is the count of the ranges before and the place inside its own.
    """
    spark = rows.sparkSession
    n = rows.count()
    path = shared_path(spark, "ranges")
    rows.repartitionByRange(max(RANGES, -(-n // range_rows)), *groups, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    cut = spark.read.schema(rows.withColumn("_range", F.lit(0)).schema).parquet(path)
    counts = cut.groupBy(*groups, "_range").agg(F.count("*").alias("_c"))
    up = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, and group in it
    before = counts.select(*groups, "_range", F.coalesce(F.sum("_c").over(up), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(*order)) - 1
    placed = cut.withColumn("_inside", inside)
    on = placed["_range"] == before["_range"]
    for g in groups:
        on = on & placed[g].eqNullSafe(before[g])
    return placed.join(before, on).select(*(placed[c] for c in rows.columns), (F.col("_before") + F.col("_inside")).cast("bigint").alias("row_idx"))
