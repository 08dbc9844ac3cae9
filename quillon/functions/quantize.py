"""Integer forms of feature vectors, their partition key and squared distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.config import DIMENSIONS, Q, U, V
from quillon.functions.features import f32


def i16(v: Column) -> Column:
    """Sixteen-bit signed, truncated toward zero."""
    return F.least(F.greatest(v * f32(32767), f32(-32768)), f32(32767)).cast("int")


def u8(v: Column) -> Column:
    """Eight-bit unsigned, truncated: -1 is 0, 0 is 127, 1 is 255."""
    return F.least(F.greatest((v + f32(1)) * f32(127.5), f32(0)), f32(255)).cast("int")


def part_key() -> Column:
    """Bit 0: card present; bit 1: online; bit 2: has a last transaction."""
    return (F.col("v10") > 0.5).cast("int") + 2 * (F.col("v9") > 0.5).cast("int") + 4 * (F.col("v5") >= 0).cast("int")


def with_i16(df: DataFrame) -> DataFrame:
    return df.withColumns({q: i16(F.col(v)) for q, v in zip(Q, V, strict=True)} | {"part_key": part_key()})


def with_u8(df: DataFrame) -> DataFrame:
    return df.withColumns({u: u8(F.col(v)) for u, v in zip(U, V, strict=True)})


def unpacked(df: DataFrame, vector: str = "vector", exact: bool = False) -> DataFrame:
    """v0..v13 of an array column: shorter ones end in zeros, longer ones lose the rest; exact keeps only those of fourteen."""
    df = df.where(F.size(vector) == DIMENSIONS) if exact else df
    return df.withColumns({v: F.coalesce(F.try_element_at(F.col(vector), F.lit(i + 1)), f32(0)).cast("float") for i, v in enumerate(V)})


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    """Unrolled, in 64 bits: sums reach 6e10."""
    return reduce(lambda x, y: x + y, ((p.cast("bigint") - q) * (p.cast("bigint") - q) for p, q in zip(a, b, strict=True)))


def box_distance(low: list[Column], high: list[Column], q: list[Column]) -> Column:
    """Squared distance from a point to a box: a lower bound for all that the box holds."""
    outside = (F.greatest(lo.cast("bigint") - x, x.cast("bigint") - hi, F.lit(0).cast("bigint")) for lo, hi, x in zip(low, high, q, strict=True))
    return reduce(lambda x, y: x + y, (d * d for d in outside))
