"""The registered queries of the scoring engine, each over whole tables.

Searches ask for every event whose id is divisible by 20 against all events; an event is never its own neighbour.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.config import Q, U, V, Ivf
from quillon.functions import features as fx
from quillon.functions import quantize as qz
from quillon.functions import requests as rq
from quillon.operators import ivf, kdcells, knn, stats
from quillon.operators.dispatch import dispatch
from quillon.plans import store
from quillon.plans.shared import shared_path
from quillon.sources import tables
from quillon.streaming import scoring

IVF = Ivf()
EVERY = 20


def _tx(spark: SparkSession, d: str) -> DataFrame:
    return tables.transactions(spark, d)


def _features(spark: SparkSession, d: str) -> DataFrame:
    return fx.with_features(_tx(spark, d))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """All events as references: ref_id, fraud, part_key, both quantised vectors."""
    found = qz.with_u8(qz.with_i16(_features(spark, d))).withColumn("fraud", tables.is_fraud(F.col("label")))
    return found.select(F.col("event_id").alias("ref_id"), "fraud", "part_key", *Q, *U)


def _index(spark: SparkSession, d: str) -> DataFrame:
    """The references, written once: what searches them reads a table instead of deriving it for every pass."""
    path = shared_path(spark, "refs")
    _refs(spark, d).write.parquet(path)
    return spark.read.parquet(path)


def _asked(refs: DataFrame) -> DataFrame:
    return refs.where(F.col("ref_id") % EVERY == 0).withColumnRenamed("ref_id", "query_id")


def _seeds(refs: DataFrame) -> list[list[float]]:
    """The first events as starting centroids: a parameter of IVF.centroids rows."""
    rows = refs.orderBy("ref_id").limit(IVF.centroids).select("ref_id", *U).collect()
    return [[float(r[u]) for u in U] for r in sorted(rows, key=lambda r: r["ref_id"])]


def _single(name: str, *also: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _features(spark, d).select("event_id", *(F.col(v).cast("double").alias(v) for v in (name, *also)))

    return query


def src_transactions(spark, d):
    c = F.col
    return _tx(spark, d).select("event_id", c("amount").cast("double").alias("amount"), "installments", "requested_at", c("customer_avg").cast("double").alias("customer_avg"), "tx_count_24h", "merchant_id", "mcc", c("merchant_avg").cast("double").alias("merchant_avg"), "is_online", "card_present", c("km_from_home").cast("double").alias("km_from_home"), "last_timestamp", c("last_km").cast("double").alias("last_km"), "label")


def parse_payload(spark, d):
    """JSON out and in again."""
    found = rq.transactions(rq.parsed(tables.bodies(_tx(spark, d))), "event_id")
    c = F.col
    return found.select("event_id", c("amount").cast("double").alias("amount"), "installments", "requested_at", c("customer_avg").cast("double").alias("customer_avg"), "tx_count_24h", F.size("known_merchants").cast("bigint").alias("n_known"), "merchant_id", "mcc", "is_online", "card_present", c("km_from_home").cast("double").alias("km_from_home"), "last_timestamp", c("last_km").cast("double").alias("last_km"))


def _damaged(requests: DataFrame) -> DataFrame:
    """Bodies damaged by id mod 11; 0, 9 and 10 stay valid."""
    kind, body = F.col("event_id") % 11, F.col("body")
    cut = (
        F.when(kind == 1, "").when(kind == 2, F.concat(F.lit("["), body, F.lit("]")))
        .when(kind == 3, F.regexp_replace(body, r'"terminal":', '"elsewhere":'))
        .when(kind == 4, F.concat(F.regexp_replace(body, r',"last_transaction":\{[^}]*\}', "").substr(F.lit(1), F.length(F.regexp_replace(body, r',"last_transaction":\{[^}]*\}', "")) - 1), F.lit(',"last_transaction":{}}')))
        .when(kind == 5, F.regexp_replace(body, r'"installments":\d+', '"installments":-1'))
        .when(kind == 6, F.regexp_replace(body, r'"requested_at":"[^"]*"', '"requested_at":"yesterday"'))
        .when(kind == 7, F.regexp_replace(body, r'"is_online":(true|false)', '"is_online":"maybe"'))
        .when(kind == 8, F.regexp_replace(body, r'"amount":', '"amounts":'))
        .when(kind == 9, F.concat(body.substr(F.lit(1), F.length(body) - 1), F.lit(',"extra":{"deep":[1,2,{"x":null}]}}')))
        .otherwise(body)
    )
    return requests.withColumn("body", cut)


def validate_status(spark, d):
    return rq.parsed(_damaged(tables.bodies(_tx(spark, d)))).select("event_id", rq.status(F.col("body")).alias("status"))


def reject_oversize(spark, d):
    """A claimed length of 8192 less the head is accepted, one more is not."""
    asked = rq.parsed(tables.bodies(_tx(spark, d)))
    base = F.lit("POST /fraud-score HTTP/1.1\r\nContent-Length: ")
    head = F.concat(base, (8192 - F.octet_length(base) - 8 + F.col("event_id") % 2).cast("string"), F.lit("\r\n\r\n"))
    return asked.withColumn("head", head).select("event_id", rq.status(F.col("body"), F.col("head")).alias("status"))


def _malformed(requests: DataFrame) -> DataFrame:
    """Bodies changed by id mod 9: escapes, numbers of wrong types and at the bounds of 32 bits, white space; 0, 1, 4 and 8 are valid."""
    kind, body = F.col("event_id") % 9, F.col("body")
    number = lambda name, x: F.regexp_replace(body, rf'"{name}":[^,}}]*', f'"{name}":{x}')
    changed = (
        F.when(kind == 1, F.regexp_replace(body, r'"id":"MERC-', r'"id":"\\u004d\\u0045RC\\u002d'))
        .when(kind == 2, number("amount", '"12.5"'))
        .when(kind == 3, number("km_from_home", "true"))
        .when(kind == 4, number("installments", "4294967295"))
        .when(kind == 5, number("installments", "4294967296"))
        .when(kind == 6, number("installments", "2.5"))
        .when(kind == 7, number("tx_count_24h", "99999999999999999999"))
        .when(kind == 8, F.regexp_replace(F.regexp_replace(body, ",", " ,\n\t"), '":', '" :\r\n  '))
        .otherwise(body)
    )
    return requests.withColumn("body", changed)


def validate_malformed(spark, d):
    """Status of each, and of valid ones the merchant and the installments as read (else -1)."""
    judged = rq.parsed(_malformed(tables.bodies(_tx(spark, d)))).withColumn("status", rq.status(F.col("body")))
    ok = lambda path: F.when(F.col("status") == 200, F.col(f"payload.{path}"))
    return judged.select("event_id", "status", ok("merchant.id").alias("merchant_id"), F.coalesce(ok("transaction.installments"), F.lit(-1)).cast("bigint").alias("installments"))


def labelled_source(spark, d):
    """Vectors of 14, 10 and 16 numbers as gzip JSON arrays, read back and brought to 14."""
    path = shared_path(spark, "labelled")
    whole = F.array(*(F.col(v) for v in V))
    kind = F.col("event_id") % 3
    vector = F.when(kind == 1, F.slice(whole, 1, 10)).when(kind == 2, F.concat(whole, F.array(F.lit(9.0).cast("float"), F.lit(9.0).cast("float")))).otherwise(whole)
    tables.write_labelled(_features(spark, d).select(vector.alias("vector"), "label"), path)
    read = qz.unpacked(tables.labelled_vectors(spark, path))
    return read.select(tables.is_fraud(F.col("label")).alias("fraud"), *(F.col(v).cast("double").alias(v) for v in V))


def dispatch_global(spark, d):
    """All connections in the order of arrival, alternately to two backends; one refuses errors, the other every seventh id; -1 is neither."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "event_type")
    found = dispatch(e, ["ts", "event_id"], (F.col("event_type") != "error", F.col("event_id") % 7 != 0))
    return found.select("event_id", "slot", F.coalesce("backend", F.lit(-1)).alias("backend"))


def http_content_length(spark, d):
    """Heads of a body of 100 bytes, in seven shapes."""
    asked = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.lit("x" * 100).alias("body"))
    return tables.heads(asked).select("event_id", rq.content_length(F.col("head")).alias("content_length"))


def http_route(spark, d):
    asked = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.lit("").alias("body"))
    return tables.heads(asked).select("event_id", rq.route(F.col("head")).alias("route"))


def dispatch_round_robin(spark, d):
    """The backend of each request, in the order of arrival within its listener (the user's): alternately 0 and 1."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", ((F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1) % 2).cast("int").alias("backend"))


def feature_vector(spark, d):
    return _features(spark, d).select("event_id", *(F.col(v).cast("double").alias(v) for v in V))


def quantize_i16(spark, d):
    return qz.with_i16(_features(spark, d)).select("event_id", *Q)


def quantize_u8(spark, d):
    return qz.with_u8(_features(spark, d)).select("event_id", *U)


def partition_key(spark, d):
    return qz.with_i16(_features(spark, d)).select("event_id", "part_key")


def partition_counts(spark, d):
    return stats.partition_counts(_refs(spark, d))


def label_counts(spark, d):
    return stats.label_counts(_tx(spark, d).select(tables.is_fraud(F.col("label")).alias("fraud")))


def bbox_by_partition(spark, d):
    return stats.bounding_boxes(_refs(spark, d))


def max_variance_dim(spark, d):
    return stats.widest_dimension(_refs(spark, d))


def box_lower_bound(spark, d):
    """Every asked event against the box of every partition: a table of at most eight rows, shipped."""
    refs = _index(spark, d)
    boxes = stats.bounding_boxes(refs)
    q = _asked(refs).select("query_id", *Q)
    # at most eight keys, by the definition of the key
    keyed = q.withColumn("part_key", F.explode(F.sequence(F.lit(0), F.lit(7)))).join(F.broadcast(boxes), "part_key")
    return keyed.select("query_id", "part_key", qz.box_distance([F.col(f"min_{c}") for c in Q], [F.col(f"max_{c}") for c in Q], [F.col(c) for c in Q]).alias("bound"))


def box_lower_bound_all(spark, d):
    """Every event against the box of every partition."""
    refs = _index(spark, d)
    # at most eight keys, by the definition of the key
    keyed = refs.select("ref_id", *Q).withColumn("part_key", F.explode(F.sequence(F.lit(0), F.lit(7)))).join(F.broadcast(stats.bounding_boxes(refs)), "part_key")
    return keyed.select("ref_id", "part_key", qz.box_distance([F.col(f"min_{c}") for c in Q], [F.col(f"max_{c}") for c in Q], [F.col(c) for c in Q]).alias("bound"))


def _to_previous(spark, d, columns):
    """Each event's distance to the event before it in its user's order."""
    refs = _refs(spark, d).select(F.col("ref_id").alias("event_id"), *columns).join(spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts"), "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = refs.withColumns({f"_{c}": F.lag(c).over(w) for c in columns}).where(F.col(f"_{columns[0]}").isNotNull())
    return pairs.select("event_id", qz.squared_distance([F.col(c) for c in columns], [F.col(f"_{c}") for c in columns]).alias("dist"))


def dist_i16(spark, d):
    return _to_previous(spark, d, Q)


def dist_u8(spark, d):
    return _to_previous(spark, d, U)


def knn_exact_neighbors(spark, d):
    refs = _index(spark, d)
    return knn.neighbours(_asked(refs), refs).select("query_id", F.col("rank").cast("bigint").alias("rank"), "ref_id", "dist")


def _exact_votes(spark, d):
    refs = _index(spark, d)
    asked = _asked(refs)
    return knn.votes(asked, knn.neighbours(asked, refs))


def knn_exact_votes(spark, d):
    return _exact_votes(spark, d)


def fraud_decision(spark, d):
    return knn.decisions(_exact_votes(spark, d))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """The references with their median-split cells, written once."""
    path = shared_path(spark, "cells")
    _refs(spark, d).select("ref_id", "fraud", "part_key", *Q).write.parquet(f"{path}/refs")
    kdcells.with_cells(spark.read.parquet(f"{path}/refs")).write.parquet(f"{path}/cells")
    return spark.read.parquet(f"{path}/cells")


def knn_cells(spark, d):
    """The same neighbours through median-split cells of 64 rows at most and their boxes."""
    refs = _cells(spark, d)
    found = kdcells.neighbours_by_cells(_asked(refs), refs)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "ref_id", "dist")


def cell_counts(spark, d):
    """Vectors, leaves and nodes of each key's tree."""
    return kdcells.build_counts(_cells(spark, d))


def kmeans_assign(spark, d):
    refs = _index(spark, d)
    return ivf.assign(refs, _seeds(refs)).select("ref_id", "centroid_id")


def kmeans_update(spark, d):
    refs = _index(spark, d)
    found = ivf.means(ivf.assign(refs, _seeds(refs)))
    return found.select("centroid_id", "n", *(F.col(f"m_{u}").cast("double").alias(f"m_{u}") for u in U), *(F.col(f"m_{u}").cast("int").alias(u) for u in U))


def kmeans_full(spark, d):
    """Centroids after all rounds from drawn starts, truncated, with the size of each list."""
    path = shared_path(spark, "vectors")
    _refs(spark, d).write.parquet(path)
    centroids, assigned, _ = ivf.kmeans(spark.read.parquet(path), IVF)
    return ivf.buckets(assigned, IVF.centroids).join(ivf.centroid_table(spark, centroids), "centroid_id")


def kmeans_log(spark, d):
    path = shared_path(spark, "vectors")
    _refs(spark, d).write.parquet(path)
    _, _, log = ivf.kmeans(spark.read.parquet(path), IVF)
    return spark.createDataFrame([(x["iteration"], x["changed"], x["percent"]) for x in log], "iteration int, changed bigint, percent double")


def ivf_buckets(spark, d):
    refs = _index(spark, d)
    return ivf.buckets(ivf.assign(refs, _seeds(refs)), IVF.centroids)


def ivf_probe(spark, d):
    refs = _index(spark, d)
    return ivf.probes(_asked(refs), _seeds(refs), IVF.nprobe).select("query_id", F.col("probe").cast("bigint").alias("probe"), "centroid_id", "centroid_dist")


def ivf_votes(spark, d):
    refs = _index(spark, d)
    seeds = _seeds(refs)
    return ivf.ivf_votes(_asked(refs), ivf.assign(refs, seeds), seeds, IVF.nprobe, IVF.k)


def index_size(spark, d):
    n = F.count("*")
    return spark.read.parquet(f"{d}/events.parquet").agg(n.alias("n"), (17 * n + 24 * IVF.centroids + 32).alias("bytes"))


def store_roundtrip(spark, d):
    """The exact index written and read back: rows, frauds and a checksum by key."""
    path = shared_path(spark, "index")
    store.save_exact(_refs(spark, d), path)
    refs, _ = store.load_exact(spark, path)
    return refs.groupBy(F.col("part_key").cast("int").alias("part_key")).agg(F.count("*").alias("n"), F.sum("fraud").cast("bigint").alias("n_fraud"), F.sum(sum((F.col(q).cast("bigint") for q in Q), F.lit(0).cast("bigint"))).alias("total"))


def ivf_roundtrip(spark, d):
    """Votes from an inverted-list index that was written and read back."""
    refs = _index(spark, d)
    seeds = _seeds(refs)
    path = shared_path(spark, "index")
    store.save_ivf(ivf.assign(refs, seeds), ivf.centroid_table(spark, seeds), path, IVF.nprobe, IVF.k)
    lists, centroids, params = store.load_ivf(spark, path)
    points = [[float(r[u]) for u in U] for r in centroids.orderBy("centroid_id").collect()]
    return ivf.ivf_votes(_asked(refs), lists, points, params["nprobe"], params["k"])


def ivf_build_votes(spark, d):
    """From vectors to trained centroids, lists and a saved index; votes from the index read back."""
    path = shared_path(spark, "index")
    store.build_ivf(_index(spark, d), path, IVF)
    lists, centroids, params = store.load_ivf(spark, path)
    points = [[float(r[u]) for u in U] for r in centroids.orderBy("centroid_id").collect()]  # a row for each centroid
    return ivf.ivf_votes(_asked(lists), lists, points, params["nprobe"], params["k"])


def stream_score(spark, d):
    """Asked events as request bodies through the stream: the answers equal those of the batch."""
    root = shared_path(spark, "stream")
    refs = _refs(spark, d)
    refs.write.parquet(f"{root}/refs")
    tables.bodies(_tx(spark, d).where(F.col("event_id") % EVERY == 0)).write.parquet(f"{root}/in")
    query = scoring.start(spark, f"{root}/in", spark.read.parquet(f"{root}/refs"), f"{root}/out", f"{root}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").select(F.col("event_id").alias("query_id"), "status", "fraud_votes", "approved", "fraud_score", "response")


def embedding_knn(spark, d):
    """Neighbours among embeddings of one label, in 64 dimensions."""
    e = [f"e{i}" for i in range(64)]
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("ref_id"), F.col("label").alias("part_key"), F.lit(0).alias("fraud"), *(qz.i16(F.col("embedding")[i]).alias(c) for i, c in enumerate(e)))
    return knn.neighbours(_asked(rows), rows, columns=e).select("query_id", F.col("rank").cast("bigint").alias("rank"), "ref_id", "dist")


SINGLE = {"feat_amount": _single("v0"), "feat_installments": _single("v1"), "feat_amount_ratio": _single("v2"), "feat_hour": _single("v3"), "feat_weekday": _single("v4"), "feat_minutes_since_last": _single("v5"), "feat_km_last": _single("v6"), "feat_km_home": _single("v7"), "feat_tx_count_24h": _single("v8"), "feat_flags": _single("v9", "v10"), "feat_unknown_merchant": _single("v11"), "feat_mcc_risk": _single("v12"), "feat_merchant_avg": _single("v13")}

WHOLE = [src_transactions, parse_payload, validate_status, validate_malformed, reject_oversize, labelled_source, http_content_length, http_route, dispatch_round_robin, dispatch_global, feature_vector, quantize_i16, quantize_u8, partition_key, partition_counts, label_counts, bbox_by_partition, max_variance_dim, box_lower_bound, box_lower_bound_all, dist_i16, dist_u8, knn_exact_neighbors, knn_exact_votes, fraud_decision, knn_cells, cell_counts, kmeans_assign, kmeans_update, kmeans_full, kmeans_log, ivf_buckets, ivf_probe, ivf_votes, index_size, store_roundtrip, ivf_roundtrip, ivf_build_votes, stream_score, embedding_knn]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in WHOLE} | SINGLE
