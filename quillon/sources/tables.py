"""Sources: labelled vectors as a gzip JSON array, transactions from an event table, request bodies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.config import MCC_RISK

LABELLED = "vector array<float>, label string"


def labelled_vectors(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Vectors and labels of a JSON array, gzip or plain. Such a file is read by one task; ``partitions`` deals its rows out.

    A row without a vector or a label fails the read.
    """
    rows = spark.read.schema(LABELLED).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a row has no {c}")).cast(t)) for c, t in (("vector", "array<float>"), ("label", "string"))})
    return rows.repartition(partitions) if partitions else rows


def is_fraud(label: Column) -> Column:
    """1 for exactly 'fraud', else 0."""
    return F.coalesce((label == "fraud").cast("int"), F.lit(0))


def _by_day(e: DataFrame) -> DataFrame:
    """e with tx_count_24h, last_ts and last_id: a user's events are taken a day at a time, so a busy user is many groups.

    Each event also stands in the next day's group, which holds all that the 24 hours before its events do; a day's first event
    has the last of the user's latest day before, one row for each user and day.
    """
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    both = e.withColumn("_later", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_day", day + F.make_dt_interval(F.col("_later")))
    in_day = Window.partitionBy("user_id", "_day").orderBy("ts", "event_id")
    recent = F.expr("count(*) over (partition by user_id, _day order by ts range between interval '24' hour preceding and current row)")
    counted = both.withColumns({"tx_count_24h": recent, "_ts": F.lag("ts").over(in_day), "_id": F.lag("event_id").over(in_day)}).where("_later = 0")
    days = e.groupBy("user_id", day.alias("_day")).agg(F.max(F.struct("ts", "event_id")).alias("_last"))
    before = days.select(F.col("user_id").alias("_user"), F.col("_day").alias("_of"), F.lag("_last").over(Window.partitionBy("user_id").orderBy("_day")).alias("_before")).where("_before is not null")
    joined = counted.join(before, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("_day") == F.col("_of")), "left")
    return joined.select(*e.columns, "tx_count_24h", F.coalesce("_ts", "_before.ts").alias("last_ts"), F.coalesce("_id", "_before.event_id").alias("last_id"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction for each event, with the columns the features read and a label.

    Averages and first visits are aggregates joined back, so a busy user or merchant is combined before any shuffle; what needs the order of a
    user's events goes by days. Events without a user are one user's, events without a merchant one merchant's, and keep their rows.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.get_json_object("props", "$.k").alias("k"))
    mean = (F.sum("cents").cast("double") / F.count("*") / 100).cast("float")
    users = e.groupBy(F.col("user_id").alias("_u")).agg(mean.alias("customer_avg"))
    merchants = e.groupBy(F.col("k").alias("_k")).agg(mean.alias("merchant_avg"))
    visits = e.groupBy(F.col("user_id").alias("_vu"), F.col("k").alias("_vk")).agg(F.min(F.struct("ts", "event_id")).alias("_first"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = _by_day(e).join(users, same("user_id", "_u"), "left").join(merchants, same("k", "_k"), "left").join(visits, same("user_id", "_vu") & same("k", "_vk"), "left")
    rows = rows.withColumns({"unknown": F.struct("ts", "event_id") == F.col("_first"), "last_timestamp": text("last_ts"), "last_km": (F.abs(F.col("event_id") - F.col("last_id")) % 1500).cast("float")})
    codes = F.array(*(F.lit(c) for c in MCC_RISK))
    merchant = F.concat(F.lit("MERC-"), F.col("k"))
    return rows.select(
        "event_id", "user_id", "cents",
        (F.col("cents").cast("float") / F.lit(100.0)).cast("float").alias("amount"),
        (1 + F.col("event_id") % 12).alias("installments"),
        text("ts").alias("requested_at"), "customer_avg", "tx_count_24h",
        F.when(F.col("unknown"), F.array(F.lit("MERC-none"))).otherwise(F.array(F.lit("MERC-none"), merchant)).alias("known_merchants"),
        merchant.alias("merchant_id"),
        F.when(F.col("k").isNotNull(), F.element_at(codes, (F.col("k").cast("int") % 10 + 1))).alias("mcc"), "merchant_avg",
        F.col("event_type").isin("click", "view").alias("is_online"), (F.col("event_type") == "purchase").alias("card_present"),
        (F.col("event_id") * 37 % 1500).cast("float").alias("km_from_home"), "last_timestamp", "last_km",
        F.when(F.col("event_type") == "error", "fraud").otherwise("legit").alias("label"),
    )


def write_labelled(rows: DataFrame, path: str) -> None:
    """rows (vector, label) as gzip JSON arrays, one for each partition, streamed; ``labelled_vectors`` reads them back."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = False
        for batch in batches:
            if len(batch):
                lines = batch.column("value").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([("," if some or i else "[") + x for i, x in enumerate(lines)])], names=["value"])
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])

    rows.select(F.to_json(F.struct("vector", "label")).alias("value")).mapInArrow(arrays, "value string").write.option("compression", "gzip").text(path)


def bodies(tx: DataFrame) -> DataFrame:
    """event_id and the JSON payload of each transaction."""
    last = F.when(F.col("last_timestamp").isNotNull(), F.struct(F.col("last_timestamp").alias("timestamp"), F.col("last_km").alias("km_from_current")))
    whole = F.struct(
        F.concat(F.lit("tx-"), F.col("event_id")).alias("id"),
        F.struct("amount", "installments", "requested_at").alias("transaction"),
        F.struct(F.col("customer_avg").alias("avg_amount"), "tx_count_24h", "known_merchants").alias("customer"),
        F.struct(F.col("merchant_id").alias("id"), "mcc", F.col("merchant_avg").alias("avg_amount")).alias("merchant"),
        F.struct("is_online", "card_present", "km_from_home").alias("terminal"),
        last.alias("last_transaction"),
    )
    return tx.select("event_id", F.to_json(whole).alias("body"))


def heads(requests: DataFrame) -> DataFrame:
    """A request head for each body, in the shapes that clients send: by id mod 7."""
    n = F.octet_length("body").cast("string")
    post, host = "POST /fraud-score HTTP/1.1\r\n", "Host: api\r\n"
    shape = F.col("event_id") % 7
    head = (
        F.when(shape == 1, F.concat(F.lit(post + host + "content-length:"), n, F.lit("\r\n\r\n")))
        .when(shape == 2, F.lit(post + host + "\r\n"))
        .when(shape == 3, F.lit(post + "Content-Length: \r\nContent-Length: 12\r\n\r\n"))
        .when(shape == 4, F.concat(F.lit(post + "CONTENT-LENGTH: \t"), n, F.lit("\r\nContent-Length: 7\r\n\r\n")))
        .when(shape == 5, F.lit("GET /ready HTTP/1.1\r\n" + host + "\r\n"))
        .when(shape == 6, F.lit("PUT /fraud-score HTTP/1.1\r\nX-Content-Length: 5\r\n\r\n"))
        .otherwise(F.concat(F.lit(post + host + "Content-Length: "), n, F.lit("\r\n\r\n")))
    )
    return requests.withColumn("head", head)
