"""Scoring as a stream: request bodies in, a decision for each out. Every request stands alone, so there is no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import Scoring
from quillon.functions.features import with_features
from quillon.functions.quantize import with_i16
from quillon.functions.requests import parsed, status, transactions
from quillon.operators.knn import decisions, neighbours, votes

REQUESTS = "event_id bigint, body string"


def score(requests: DataFrame, refs: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """event_id, status, fraud_votes, approved, fraud_score, response; rejected requests have nulls after their status."""
    judged = parsed(requests).withColumn("status", status(F.col("body")))
    good = with_i16(with_features(transactions(judged.where("status = 200"), "event_id"), scoring.limits)).withColumnRenamed("event_id", "query_id")
    voted = decisions(votes(good, neighbours(good, refs, scoring.k)), scoring.k, scoring.declined_from)
    return judged.select("event_id", "status").join(voted.withColumnRenamed("query_id", "event_id"), "event_id", "left")


def start(spark: SparkSession, source: str, refs: DataFrame, sink: str, checkpoint: str, scoring: Scoring = Scoring(), files_per_batch: int = 8, once: bool = True):
    """A query that scores the Parquet files of request bodies under source as they come, into Parquet under sink.

    Each micro-batch overwrites a folder named by its number, so a batch that is run again after a failure leaves no second answer.
    """

    def batch(rows: DataFrame, number: int) -> None:
        score(rows, refs, scoring).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
