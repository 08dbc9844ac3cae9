"""Golden requests, edge semantics, indexes and stream of the scoring engine."""

from __future__ import annotations

import gzip
import json
import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.config import MCC_RISK, Ivf, Q, U, V
from quillon.functions.features import hour, minutes_between, weekday, with_features
from quillon.functions.quantize import unpacked, with_i16, with_u8
from quillon.functions.requests import content_length, parsed, route, status, transactions
from quillon.operators import ivf, kdcells, knn, stats
from quillon.operators.ranks import ranked
from quillon.plans import oracle, queries, store
from quillon.sources.tables import is_fraud, labelled_vectors

A = {"id": "own-7", "transaction": {"amount": 250.0, "installments": 3, "requested_at": "2025-07-04T09:30:10Z"}, "customer": {"avg_amount": 100.0, "tx_count_24h": 5, "known_merchants": ["M-1", "M-2"]}, "merchant": {"id": "M-2", "mcc": "5812", "avg_amount": 1200.0}, "terminal": {"is_online": True, "card_present": False, "km_from_home": 500.0}, "last_transaction": None}


def without(*path):
    x = json.loads(json.dumps(A))
    inner = x
    for p in path[:-1]:
        inner = inner[p]
    del inner[path[-1]]
    return x


def scored(spark, bodies):
    rows = spark.createDataFrame([(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "event_id bigint, body string")
    return parsed(rows).withColumn("status", status(F.col("body")))


def test_golden_vector(spark):
    found = with_u8(with_i16(with_features(transactions(scored(spark, [A, json.dumps(A, indent=2)]).where("status = 200"), "event_id")))).collect()
    assert len(found) == 2
    for row in found:
        # worked out by hand from the definitions
        assert [round(row[v], 7) for v in V] == pytest.approx([0.025, 0.25, 0.25, 0.3913043, 0.6666667, -1, -1, 0.5, 0.25, 1, 0, 0, 0.3, 0.12], abs=1e-6)
        assert [row[q] for q in Q] == [819, 8191, 8191, 12821, 21844, -32767, -32767, 16383, 8191, 32767, 0, 0, 9830, 3932]
        assert [row[u] for u in U] == [130, 159, 159, 177, 212, 0, 0, 191, 159, 255, 127, 127, 165, 142]
        assert row["part_key"] == 2


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        (A, 200),
        (A | {"last_transaction": {"timestamp": "2026-03-11T14:58:35Z", "km_from_current": 18.8}}, 200),
        (without("id"), 200),
        (without("last_transaction"), 200),
        (A | {"more": {"x": [1, {"y": None}]}}, 200),
        (dict(reversed(A.items())), 200),
        ("", 400),
        ("{", 400),
        ("   ", 400),
        ("[]", 400),
        (A | {"last_transaction": {}}, 400),
        (A | {"last_transaction": {"timestamp": "2026-03-11T14:58:35Z"}}, 400),
        (without("terminal"), 400),
        (without("customer", "known_merchants"), 400),
        (A | {"transaction": A["transaction"] | {"installments": -3}}, 400),
        (A | {"transaction": A["transaction"] | {"installments": 1 << 32}}, 400),
        (A | {"transaction": A["transaction"] | {"requested_at": "2026-13-11T18:45:53Z"}}, 400),
        (A | {"transaction": A["transaction"] | {"requested_at": "soon"}}, 400),
        (A | {"terminal": A["terminal"] | {"is_online": "maybe"}}, 400),
    ],
)
def test_status(spark, body, expected):
    assert scored(spark, [body]).first()["status"] == expected


def test_times(spark):
    row = spark.createDataFrame([("2026-03-11T20:23:34Z", "2026-03-11T14:58:35Z", "2026-03-11T00:00:00Z", "2026-03-09T23:59:59Z", "2026-03-10T01:00:00Z")], "a string, b string, wed string, mon string, tue string")
    got = row.select(minutes_between(F.col("a"), F.col("b")).alias("m"), hour(F.col("wed")), hour(F.col("mon")), weekday(F.col("wed")), weekday(F.col("mon")), weekday(F.col("tue"))).first()
    assert got[0] == 325
    assert list(got[1:]) == pytest.approx([0.0, 1.0, 2 / 6, 0.0, 1 / 6], abs=1e-6)


def test_http(spark):
    heads = [("POST /fraud-score HTTP/1.1\r\ncontent-length:  12\r\n\r\n", 12, "score"), ("GET /ready HTTP/1.1\r\n\r\n", 0, "ready"), ("POST /fraud-scorex\r\nX-Content-Length: 3\r\n", 0, "score"), ("PUT / HTTP/1.1\r\nContent-Length:\r\nContent-Length: 4\r\n", 0, "none")]
    got = spark.createDataFrame(heads, "head string, n bigint, r string").select(content_length(F.col("head")), "n", route(F.col("head")), "r").collect()
    assert all(x[0] == x[1] and x[2] == x[3] for x in got)


def points(spark, rows, columns, key=None):
    schema = "ref_id bigint, fraud int" + (f", {key} int" if key else "") + "".join(f", {c} int" for c in columns)
    return spark.createDataFrame(rows, schema)


def test_fewer_neighbours_than_k_and_empty_keys(spark):
    refs = points(spark, [(1, 1, 0, *[0] * 14), (2, 1, 0, *[5] * 14)], Q, "part_key")
    asked = points(spark, [(10, 0, 0, *[0] * 14), (11, 0, 3, *[0] * 14)], Q, "part_key").withColumnRenamed("ref_id", "query_id")
    got = {r["query_id"]: r for r in knn.decisions(knn.votes(asked, knn.neighbours(asked, refs))).collect()}
    assert (got[10]["fraud_votes"], got[10]["approved"], got[10]["fraud_score"]) == (2, True, 0.4)
    assert (got[11]["fraud_votes"], got[11]["approved"], got[11]["fraud_score"]) == (0, True, 0.0)
    assert got[10]["response"] == '{"approved":true,"fraud_score":0.4}'


def test_strategies_agree_on_ties(spark):
    rows = [(i, i % 2, i % 3, *[(i * 7 + j) % 4 for j in range(14)]) for i in range(120)]
    refs = points(spark, rows, Q, "part_key")
    asked = refs.where("ref_id % 7 = 0").withColumnRenamed("ref_id", "query_id")
    scan = knn.neighbours(asked, refs, block=5)
    plain = knn.neighbours(asked, refs, strategy="join")
    pick = lambda d: sorted(map(tuple, d.select("query_id", "rank", "ref_id", "dist").collect()))
    assert pick(scan) == pick(plain)


@pytest.mark.parametrize("votes", range(6))
def test_decisions(spark, votes):
    row = knn.decisions(spark.createDataFrame([(1, votes)], "query_id bigint, fraud_votes bigint")).first()
    assert (row["approved"], row["fraud_score"]) == (votes < 3, votes / 5)


def test_decisions_refuse_larger_k(spark):
    with pytest.raises(ValueError):
        knn.decisions(spark.range(1), k=6)


def test_kmeans_separates(spark):
    rows = [(i, 0, *[10] * 14) for i in range(50)] + [(50 + i, 0, *[240] * 14) for i in range(50)]
    centroids, assigned, log = ivf.kmeans(points(spark, rows, U), Ivf(centroids=2, iterations=10))
    found = {r["ref_id"]: r["centroid_id"] for r in assigned.collect()}
    if len({tuple(c) for c in centroids}) == 2:  # the two draws may be of one cluster
        assert len({found[i] for i in range(50)}) == 1 and found[0] != found[50]
    assert log[-1]["iteration"] <= 10


def test_build_and_predict(spark):
    data = points(spark, [(i, int(i >= 200), *[127 if i < 200 else 255] * 14) for i in range(400)], U)
    centroids, assigned, _ = ivf.kmeans(data, Ivf(centroids=4, nprobe=1, k=5, iterations=5))
    asked = points(spark, [(1000, 0, *[127] * 14), (1001, 0, *[255] * 14)], U).withColumnRenamed("ref_id", "query_id")
    got = {r["query_id"]: r["fraud_votes"] for r in ivf.ivf_votes(asked, assigned, centroids, 1, 5).collect()}
    assert got == {1000: 0, 1001: 5}
    assert {r["fraud_votes"] for r in ivf.ivf_votes(asked, assigned, centroids, 0, 5).collect()} == {0}


def test_kmeans_separates_whatever_is_drawn(spark):
    rows = [(i, 0, *[10 + i % 3] * 14) for i in range(50)] + [(50 + i, 0, *[240 + i % 3] * 14) for i in range(50)]
    data = points(spark, rows, U)
    seed = next(s for s in range(1, 100) if len({x < 50 for x in ivf.picks(100, 2, s)}) == 2)
    centroids, assigned, log = ivf.kmeans(data, Ivf(centroids=2, iterations=10, seed=seed))
    found = {r["ref_id"]: r["centroid_id"] for r in assigned.collect()}
    assert len({found[i] for i in range(50)}) == len({found[i] for i in range(50, 100)}) == 1 and found[0] != found[50]
    assert sorted(round(c[0], 2) for c in centroids) == [10.98, 240.98] and log[-1]["changed"] == 0 and len(log) < 10


def test_means_round_sums_before_dividing(spark):
    """A sum beyond 2**24: 23701205 is 23701204 in single precision, which moves the mean by a last place."""
    rows = spark.range(96226).select(F.lit(0).alias("centroid_id"), (246 + (F.col("id") < 29609).cast("int")).alias("u0"))
    got = ivf.means(rows, ["u0"]).select("n", F.col("m_u0").cast("double").alias("m")).first()
    want = duckdb.sql("SELECT CAST(CAST(CAST(CAST(23701205 AS FLOAT) AS DOUBLE) / CAST(CAST(96226 AS FLOAT) AS DOUBLE) AS FLOAT) AS DOUBLE)").fetchall()[0][0]
    assert (got["n"], got["m"]) == (96226, want) == (96226, 246.3076934814453)


def test_built_index_finds_neighbours(spark, tmp_path):
    """Recall of the built index against all lists."""
    r = random.Random(4)
    refs = points(spark, [(i, i % 2, *[min(255, max(0, int(r.gauss(60 * (i % 4) + 30, 12)))) for _ in range(14)]) for i in range(1500)], U)
    store.build_ivf(refs, f"file://{tmp_path}/built", Ivf(centroids=12, nprobe=3, iterations=5))
    lists, centroids, params = store.load_ivf(spark, f"file://{tmp_path}/built")
    at = [[float(x[u]) for u in U] for x in centroids.orderBy("centroid_id").collect()]
    asked = lists.where("ref_id % 20 = 0").withColumnRenamed("ref_id", "query_id")
    pick = lambda n: {(x["query_id"], x["ref_id"]) for x in ivf.ivf_neighbours(asked, lists, at, n, params["k"]).collect()}
    every = pick(12)
    assert params["n"] == lists.count() == 1500 and len(every) == 375 and len(pick(params["nprobe"]) & every) >= 0.9 * len(every)


def test_shuffled_and_pruned_searches(spark):
    """Several blocks of references for a key, cells of a few rows, keys that are null: the neighbours of a plain join."""
    r = random.Random(3)
    rows = [(i, i % 2, None if i % 50 == 0 else i % 3 if i % 4 else 0, *[r.randrange(6) for _ in range(14)]) for i in range(400)]
    refs = points(spark, rows, Q, "part_key")
    asked = refs.where("ref_id % 5 = 0").withColumnRenamed("ref_id", "query_id")
    pick = lambda d: sorted(map(tuple, d.select("query_id", "rank", "ref_id", "dist").collect()))
    plain = pick(knn.neighbours(asked, refs, strategy="join"))
    assert pick(knn.neighbours(asked, refs)) == plain
    assert pick(knn.neighbours(asked, refs, block=5, ref_block=30)) == plain
    for task_rows in (1 << 17, 40):  # cut inside tasks, and a level at a time before
        celled = kdcells.with_cells(refs, leaf=16, task_rows=task_rows)
        sizes = {x["cell"]: x["n"] for x in kdcells.cells(celled).collect()}
        assert max(sizes.values()) <= 16 and min(sizes.values()) >= 8 and sum(sizes.values()) == 392
        nodes = lambda n: 1 if n <= 16 else 1 + nodes(n // 2) + nodes(n - n // 2)
        assert all(x["nodes"] == nodes(x["vectors"]) == 2 * x["leaves"] - 1 for x in kdcells.build_counts(celled).collect())
        assert pick(kdcells.neighbours_by_cells(asked.join(celled.select(F.col("ref_id").alias("query_id"), "cell"), "query_id", "left"), celled, ref_block=100)) == plain


@pytest.mark.parametrize(("n", "dim", "values", "of_an_id"), [(3000, 14, 6, 1), (3000, 14, 2, 1), (500, 3, 3, 1), (4, 14, 9, 1), (1000, 2, 2, 7)])
def test_block_of_references_against_brute_force(n, dim, values, of_an_id):
    """Ties, copies, fewer rows than k and repeated ids."""
    r = np.random.default_rng(n + values)
    ids, points = r.permutation(n) // of_an_id, r.integers(-values, values, (n, dim)).astype(float)
    asked = r.choice(n, min(300, n), replace=False)
    want = []
    for i, q in enumerate(asked):
        d = ((points - points[q]) ** 2).sum(axis=1).astype(int)
        order = np.lexsort((ids, d))
        want += [(i, d[x], ids[x], ids[x] % 2) for x in order[ids[order] != ids[q]][:5]]
    got = knn.References(ids, ids % 2, points, 5).nearest(ids[asked], points[asked], 5)
    assert list(zip(*got, strict=True)) == want


def test_search_looks_at_few_of_many_rows():
    """Copies are one point, before the shuffle too, and far cells are not visited: every pair of rows was computed before."""
    r = np.random.default_rng(2)
    points = np.repeat(r.integers(0, 32768, (4000, 14)).astype(float) // np.array([1] * 2 + [1 << 14] * 12), 20, axis=0)
    ids = np.arange(len(points))
    refs = knn.References(ids, ids % 2, points, 5)
    assert len(refs.points) <= 4000 and len(refs.ids) <= 10 * len(refs.points)
    seen = [0]

    class Counted(np.ndarray):
        def __getitem__(self, rows):
            seen[0] += len(rows) * knn.GROUP
            return np.asarray(self)[rows]

    refs.points = refs.points.view(Counted)
    assert len(refs.nearest(ids[::20], points[::20], 5)[0]) == 5 * 4000 and seen[0] < 4000 * 4000
    names = [f"x{j}" for j in range(14)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids % 2, pa.int32()), pa.array(ids * 0, pa.int32()), *(pa.array(c.astype(np.int32)) for c in points.T)], names=["ref_id", "fraud", "part_key", *names])
    assert sum(map(len, knn._combined(iter([batch]), names, "part_key", 5, 200_000))) == len(refs.ids)


def test_ranks(spark):
    rows = [(i, i * 7919 % 101 // 3, None if i % 3 == 0 else i % 2) for i in range(500)]
    got = ranked(spark.createDataFrame(rows, "id int, v int, g int"), ["g"], ["v", "id"], range_rows=9).collect()
    for g in (None, 0, 1):
        own = sorted((x["v"], x["id"], x["row_idx"]) for x in got if x["g"] == g)
        assert [x[2] for x in own] == [*range(len(own))]
    assert len(got) == 500 and ranked(spark.createDataFrame([], "id int"), [], ["id"]).count() == 0


@pytest.mark.parametrize("name", ["src_transactions", "feature_vector", "partition_counts", "knn_exact_votes", "dispatch_global"])
def test_events_without_user_or_merchant(spark, tmp_path, name):
    """Null users and merchants, days without events, equal times and a user with most of the events."""
    r = random.Random(6)
    start = datetime(2025, 1, 1)
    rows = [(i, start + timedelta(minutes=r.choice([0, 1, 1439, 1440, 1441, 9000]) * r.randrange(12) + r.randrange(3)), r.choice([7, 7, 7, 8, 9, None]), r.choice(["click", "purchase", "error", "view"]), r.randrange(1, 90000) / 100, r.choice([None, '{"k": null}', "{}", '{"k": 3}', '{"k": 14}'])) for i in range(400)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got, want = queries.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(oracle.SQL[name]).df()
    plain = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)))
    assert len(got) > 5 and plain(got) == plain(want)


def test_escapes_and_wrong_numbers(spark):
    text = json.dumps(A)
    bodies = [text.replace('"M-2", "mcc"', '"M\\u002d2", "mcc"'), text.replace("250.0", '"250"'), text.replace("250.0", "[1]"), text.replace('"installments": 3', '"installments": 4294967295'), text.replace('"installments": 3', '"installments": 18446744073709551616')]
    rows = scored(spark, bodies).select("event_id", "status", "payload.merchant.id").collect()
    assert [x["status"] for x in sorted(rows)] == [200, 400, 400, 200, 400] and min(rows)["id"] == "M-2"


def test_picks_refuse_too_few():
    with pytest.raises(ValueError):
        ivf.picks(3, 4)


def test_gzip_source_and_padding(spark, tmp_path):
    path = tmp_path / "refs.json.gz"
    with gzip.open(path, "wt") as f:
        json.dump([{"vector": [0.5, 0.25], "label": "fraud", "x": 1}, {"vector": [1.0] * 16, "label": "Fraud"}], f)
    rows = sorted(unpacked(labelled_vectors(spark, f"file://{path}")).withColumn("fraud", is_fraud(F.col("label"))).collect(), key=lambda r: -r["fraud"])
    assert [rows[0][v] for v in V] == [0.5, 0.25, *[0.0] * 12] and rows[0]["fraud"] == 1
    assert [rows[1][v] for v in V] == [1.0] * 14 and rows[1]["fraud"] == 0


def test_store(spark, tmp_path):
    refs = points(spark, [(i, i % 2, i % 8, *[i] * 14) for i in range(40)], Q, "part_key")
    store.save_exact(refs, f"file://{tmp_path}/x")
    back, params = store.load_exact(spark, f"file://{tmp_path}/x")
    assert params["k"] == 5 and sorted(back.select(refs.columns).collect()) == sorted(refs.collect())
    with pytest.raises(ValueError):
        store.load_ivf(spark, f"file://{tmp_path}/x")


def test_stats(spark):
    refs = points(spark, [(1, 1, 0, *[1] * 14), (2, 0, 0, *[1] * 13, 9), (3, 0, 1, *[2] * 14)], Q, "part_key")
    counts = stats.label_counts(refs).first()
    assert (counts["n"], counts["n_fraud"], counts["n_legit"]) == (3, 1, 2)
    assert {r["part_key"]: r["dimension"] for r in stats.widest_dimension(refs).collect()} == {0: 13, 1: 0}


def test_mcc_table():
    assert MCC_RISK["7995"] == 0.85 and len(MCC_RISK) == 10
