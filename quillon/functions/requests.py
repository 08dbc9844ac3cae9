"""HTTP requests as columns: routing, framing, parsing and validation of JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD = """id string,
transaction struct<amount: float, installments: bigint, requested_at: string>,
customer struct<avg_amount: float, tx_count_24h: bigint, known_merchants: array<string>>,
merchant struct<id: string, mcc: string, avg_amount: float>,
terminal struct<is_online: boolean, card_present: boolean, km_from_home: float>,
last_transaction struct<timestamp: string, km_from_current: float>,
_damaged string"""

REQUIRED = ["transaction.amount", "transaction.installments", "transaction.requested_at", "customer.avg_amount", "customer.tx_count_24h", "customer.known_merchants", "merchant.id", "merchant.mcc", "merchant.avg_amount", "terminal.is_online", "terminal.card_present", "terminal.km_from_home"]
_TIME = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d"
_U32 = (1 << 32) - 1


def content_length(head: Column) -> Column:
    """The number in the first Content-Length line, in either case; without one, or without digits, 0."""
    digits = F.regexp_extract(head, r"(?im)^content-length:[ \t]*([0-9]*)", 1)
    return F.coalesce(F.try_to_number(F.when(digits != "", digits), F.lit("999999999999999999")).cast("bigint"), F.lit(0).cast("bigint"))


def route(head: Column) -> Column:
    """By prefix; a request that fits neither gets no response."""
    return F.when(head.startswith("GET /ready"), "ready").when(head.startswith("POST /fraud-score"), "score").otherwise("none")


def parsed(requests: DataFrame, body: str = "body") -> DataFrame:
    """requests with the struct ``payload``."""
    return requests.withColumn("payload", F.from_json(F.col(body), PAYLOAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"}))


def _is_time(x: Column) -> Column:
    return x.rlike(_TIME) & F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd").isNotNull()


def valid(body: Column) -> Column:
    """Every required leaf there and of its type, whole numbers within 32 bits, times readable, a last transaction whole or absent."""
    p = lambda name: F.col(f"payload.{name}")
    ok = (F.length(body) >= 2) & body.startswith("{") & p("_damaged").isNull()
    for name in REQUIRED:
        ok = ok & p(name).isNotNull()
    for name in ("transaction.installments", "customer.tx_count_24h"):
        ok = ok & p(name).between(0, _U32)
    ok = ok & _is_time(p("transaction.requested_at"))
    last = p("last_transaction.timestamp").isNotNull() & p("last_transaction.km_from_current").isNotNull() & _is_time(p("last_transaction.timestamp"))
    return F.coalesce(ok & (p("last_transaction").isNull() | last), F.lit(False))


def status(body: Column, head: Column | None = None, most_bytes: int = 8192) -> Column:
    """200, or 400 for a payload that isn't valid or a request of more than most_bytes."""
    ok = valid(body)
    if head is not None:
        ok = ok & (F.octet_length(head) + content_length(head) <= most_bytes)
    return F.when(ok, 200).otherwise(400)


def transactions(valid_requests: DataFrame, *keep: str) -> DataFrame:
    """The payload's leaves under the names that the features read."""
    names = {"amount": "transaction.amount", "installments": "transaction.installments", "requested_at": "transaction.requested_at", "customer_avg": "customer.avg_amount", "tx_count_24h": "customer.tx_count_24h", "known_merchants": "customer.known_merchants", "merchant_id": "merchant.id", "mcc": "merchant.mcc", "merchant_avg": "merchant.avg_amount", "is_online": "terminal.is_online", "card_present": "terminal.card_present", "km_from_home": "terminal.km_from_home", "last_timestamp": "last_transaction.timestamp", "last_km": "last_transaction.km_from_current"}
    return valid_requests.select(*keep, *(F.col(f"payload.{path}").alias(name) for name, path in names.items()))
