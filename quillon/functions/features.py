"""The fourteen features of a transaction, as float columns v0..v13.

Input columns: amount, installments, requested_at, customer_avg, tx_count_24h, known_merchants, merchant_id, mcc, merchant_avg, is_online,
card_present, km_from_home, last_timestamp, last_km. Times are text, YYYY-MM-DDTHH:MM...; what follows the minute is ignored. Nulls other than
in the last two must have been rejected before: least and greatest skip them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.config import MCC_DEFAULT, MCC_RISK, Limits, V


def f32(x: float) -> Column:
    return F.lit(float(x)).cast("float")


def clamp01(x: Column, most: float) -> Column:
    """x over most, held to 0..1, in single precision."""
    return F.greatest(F.least((x.cast("float") / F.lit(float(most))).cast("float"), f32(1)), f32(0))


def _number(ts: Column, at: int) -> Column:
    return F.substring(ts, at, 2).cast("int")


def hour(ts: Column) -> Column:
    return (_number(ts, 12) / F.lit(23.0)).cast("float")


def weekday(ts: Column) -> Column:
    """Monday is 0, Sunday is 1; days of the week in sixths."""
    return (F.weekday(F.substring(ts, 1, 10).cast("date")) / F.lit(6.0)).cast("float")


def minutes_between(late: Column, early: Column) -> Column:
    """Whole minutes; seconds are dropped from both before subtracting."""
    days = F.datediff(F.substring(late, 1, 10).cast("date"), F.substring(early, 1, 10).cast("date"))
    return (days * 1440 + (_number(late, 12) - _number(early, 12)) * 60 + _number(late, 15) - _number(early, 15)).cast("bigint")


def minutes_since_last(ts: Column, last: Column, km: Column, most: float) -> Column:
    return F.when(last.isNull() | km.isNull(), f32(-1)).otherwise(clamp01(minutes_between(ts, last), most))


def km_since_last(last: Column, km: Column, most: float) -> Column:
    return F.when(last.isNull() | km.isNull(), f32(-1)).otherwise(clamp01(km, most))


def amount_ratio(amount: Column, average: Column, most: float) -> Column:
    return F.when(average > 0, clamp01((amount / average).cast("float"), most)).otherwise(f32(0))


def mcc_risk(mcc: Column) -> Column:
    table = F.create_map(*(x for code, risk in MCC_RISK.items() for x in (F.lit(code), f32(risk))))
    return F.coalesce(F.try_element_at(table, mcc), f32(MCC_DEFAULT))


def flag(x: Column) -> Column:
    return x.cast("int").cast("float")


def unknown_merchant(known: Column, merchant: Column) -> Column:
    """A merchant without a name is known where a merchant without a name is."""
    among = F.when(merchant.isNull(), F.exists(known, lambda x: x.isNull())).otherwise(F.array_contains(known, merchant))
    return f32(1) - flag(F.coalesce(among, F.lit(False)))


def feature_columns(limits: Limits = Limits()) -> dict[str, Column]:
    c = F.col
    found = [
        clamp01(c("amount"), limits.amount),
        clamp01(c("installments"), limits.installments),
        amount_ratio(c("amount"), c("customer_avg"), limits.amount_ratio),
        hour(c("requested_at")),
        weekday(c("requested_at")),
        minutes_since_last(c("requested_at"), c("last_timestamp"), c("last_km"), limits.minutes),
        km_since_last(c("last_timestamp"), c("last_km"), limits.km),
        clamp01(c("km_from_home"), limits.km),
        clamp01(c("tx_count_24h"), limits.tx_count_24h),
        flag(c("is_online")),
        flag(c("card_present")),
        unknown_merchant(c("known_merchants"), c("merchant_id")),
        mcc_risk(c("mcc")),
        clamp01(c("merchant_avg"), limits.merchant_avg),
    ]
    return dict(zip(V, found, strict=True))


def with_features(transactions: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return transactions.withColumns(feature_columns(limits))
