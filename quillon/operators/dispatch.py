"""Dealing connections to two backends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.ranks import ranked


def dispatch(connections: DataFrame, order: list[str], accepts: tuple[Column, Column]) -> DataFrame:
    """connections with slot, 0 and 1 in turn over all of them in their order, and backend: the slot's, the other one where that
    one does not accept, null where neither does. A connection that fails over does not shift the turns after it."""
    slot = (F.col("row_idx") % 2).cast("int")
    first, other = accepts
    own = F.when(F.col("slot") == 0, first).otherwise(other)
    rest = F.when(F.col("slot") == 0, other).otherwise(first)
    return ranked(connections, [], order).withColumn("slot", slot).withColumn("backend", F.when(own, F.col("slot")).when(rest, 1 - F.col("slot"))).drop("row_idx")
