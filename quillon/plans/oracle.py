"""DuckDB SQL that states the same results."""

from __future__ import annotations

from quillon.config import DIMENSIONS, MCC_RISK, Ivf

_N = range(DIMENSIONS)
_CODES = "[" + ", ".join(f"'{c}'" for c in MCC_RISK) + "]"
_RISK = "CASE mcc " + " ".join(f"WHEN '{c}' THEN CAST({r} AS FLOAT)" for c, r in MCC_RISK.items()) + " ELSE CAST(0.5 AS FLOAT) END"


def _clamp(x: str, most: int) -> str:
    return f"greatest(least(CAST(CAST({x} AS DOUBLE) / {most} AS FLOAT), CAST(1 AS FLOAT)), CAST(0 AS FLOAT))"


TX = f"""e AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents, json_extract_string(props, '$.k') AS k FROM events),
w AS (SELECT *, CAST(CAST(sum(cents) OVER (PARTITION BY user_id) AS DOUBLE) / count(*) OVER (PARTITION BY user_id) / 100 AS FLOAT) AS customer_avg,
  CAST(CAST(sum(cents) OVER (PARTITION BY k) AS DOUBLE) / count(*) OVER (PARTITION BY k) / 100 AS FLOAT) AS merchant_avg,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '24' HOUR PRECEDING AND CURRENT ROW) AS tx_count_24h,
  row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) = 1 AS unknown,
  lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_ts, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_id FROM e),
tx AS (SELECT event_id, user_id, ts, CAST(CAST(cents AS DOUBLE) / 100 AS FLOAT) AS amount, 1 + event_id % 12 AS installments, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS requested_at, customer_avg, tx_count_24h, unknown, 'MERC-' || k AS merchant_id, ({_CODES})[CAST(k AS INTEGER) % 10 + 1] AS mcc, merchant_avg,
  event_type IN ('click', 'view') AS is_online, event_type = 'purchase' AS card_present, CAST(event_id * 37 % 1500 AS FLOAT) AS km_from_home, last_ts, strftime(last_ts, '%Y-%m-%dT%H:%M:%SZ') AS last_timestamp, CAST(abs(event_id - last_id) % 1500 AS FLOAT) AS last_km,
  CASE WHEN event_type = 'error' THEN 'fraud' ELSE 'legit' END AS label FROM w)"""

FEATURES = f"""{TX},
f AS (SELECT event_id, user_id, ts, CAST(label = 'fraud' AS INTEGER) AS fraud,
  {_clamp("amount", 10000)} AS v0, {_clamp("installments", 12)} AS v1,
  CASE WHEN customer_avg > 0 THEN {_clamp("CAST(CAST(amount AS DOUBLE) / CAST(customer_avg AS DOUBLE) AS FLOAT)", 10)} ELSE CAST(0 AS FLOAT) END AS v2,
  CAST(CAST(hour(ts) AS DOUBLE) / 23 AS FLOAT) AS v3, CAST(CAST(isodow(ts) - 1 AS DOUBLE) / 6 AS FLOAT) AS v4,
  CASE WHEN last_ts IS NULL THEN CAST(-1 AS FLOAT) ELSE {_clamp("date_diff('minute', last_ts, ts)", 1440)} END AS v5,
  CASE WHEN last_ts IS NULL THEN CAST(-1 AS FLOAT) ELSE {_clamp("last_km", 1000)} END AS v6,
  {_clamp("km_from_home", 1000)} AS v7, {_clamp("tx_count_24h", 20)} AS v8, CAST(CAST(is_online AS INTEGER) AS FLOAT) AS v9, CAST(CAST(card_present AS INTEGER) AS FLOAT) AS v10,
  CAST(CAST(unknown AS INTEGER) AS FLOAT) AS v11, {_RISK} AS v12, {_clamp("merchant_avg", 10000)} AS v13 FROM tx)"""

VECTORS = f"""{FEATURES},
r AS (SELECT event_id AS ref_id, user_id, ts, fraud, CAST(v10 > 0.5 AS INTEGER) + 2 * CAST(v9 > 0.5 AS INTEGER) + 4 * CAST(v5 >= 0 AS INTEGER) AS part_key,
  {", ".join(f"CAST(trunc(CAST(v{i} * CAST(32767 AS FLOAT) AS FLOAT)) AS INTEGER) AS q{i}" for i in _N)},
  {", ".join(f"CAST(trunc(CAST(CAST(v{i} + CAST(1 AS FLOAT) AS FLOAT) * CAST(127.5 AS FLOAT) AS FLOAT)) AS INTEGER) AS u{i}" for i in _N)} FROM f)"""


def _dist(a: str, b: str, p: str, n=_N) -> str:
    return "CAST(" + " + ".join(f"CAST({a}.{p}{i} - {b}.{p}{i} AS BIGINT) * ({a}.{p}{i} - {b}.{p}{i})" for i in n) + " AS BIGINT)"


def _v(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


NEAR = f"""{VECTORS},
x AS (SELECT a.ref_id AS query_id, b.ref_id, b.fraud, {_dist("a", "b", "q")} AS dist FROM r a JOIN r b ON a.part_key = b.part_key AND a.ref_id <> b.ref_id WHERE a.ref_id % 20 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS rank FROM x QUALIFY rank <= 5)"""

_VOTES = "SELECT a.ref_id AS query_id, CAST(coalesce(sum(n.fraud), 0) AS BIGINT) AS fraud_votes FROM r a LEFT JOIN n ON n.query_id = a.ref_id WHERE a.ref_id % 20 = 0 GROUP BY 1"
_DECIDED = f"""SELECT query_id, fraud_votes, fraud_votes < 3 AS approved, fraud_votes / CAST(5 AS DOUBLE) AS fraud_score, '{{"approved":' || CASE WHEN fraud_votes < 3 THEN 'true' ELSE 'false' END || ',"fraud_score":' || CAST(fraud_votes / CAST(5 AS DOUBLE) AS VARCHAR) || '}}' AS response FROM ({_VOTES})"""

LISTS = f"""{VECTORS},
c AS (SELECT ref_id AS centroid_id, {", ".join(f"u{i}" for i in _N)} FROM r ORDER BY ref_id LIMIT {Ivf.centroids}),
a AS (SELECT r.*, c.centroid_id, row_number() OVER (PARTITION BY r.ref_id ORDER BY {_dist("r", "c", "u")}, c.centroid_id) AS place FROM r, c QUALIFY place = 1)"""

PROBES = f"""{LISTS},
p AS (SELECT r.ref_id AS query_id, CAST(c.centroid_id AS INTEGER) AS centroid_id, {_dist("r", "c", "u")} AS centroid_dist, row_number() OVER (PARTITION BY r.ref_id ORDER BY {_dist("r", "c", "u")}, c.centroid_id) - 1 AS probe FROM r, c WHERE r.ref_id % 20 = 0 QUALIFY probe < {Ivf.nprobe})"""

IVF_NEAR = f"""{PROBES},
n AS (SELECT p.query_id, b.ref_id, b.fraud, row_number() OVER (PARTITION BY p.query_id ORDER BY {_dist("q", "b", "u")}, b.ref_id) AS rank FROM p JOIN r q ON q.ref_id = p.query_id JOIN a b ON b.centroid_id = p.centroid_id AND b.ref_id <> p.query_id QUALIFY rank <= {Ivf.k})"""



def _draws(k: int, x: int) -> str:
    """Rows (number, draw) of the 64-bit xorshift by 13, 7 and 17."""
    rows = []
    for i in range(k):
        x ^= x << 13 & (1 << 64) - 1
        x ^= x >> 7
        x ^= x << 17 & (1 << 64) - 1
        rows.append(f"({i}, CAST('{x}' AS UBIGINT))")
    return ", ".join(rows)


def _u(f: str) -> str:
    return ", ".join(f.format(i=i) for i in _N)


def _trained(rounds: int) -> str:
    """d: numbered vectors; c1.. and t1..: centroids before each round and truncated; a1..: assignments; g1..: how many changed."""
    parts = [
        f"{VECTORS}, d AS MATERIALIZED (SELECT ref_id, fraud, {_u('u{i}')}, row_number() OVER (ORDER BY ref_id) - 1 AS idx FROM r)",
        f"c1 AS MATERIALIZED (SELECT p.centroid_id, {_u('CAST(u{i} AS FLOAT) AS u{i}')} FROM (VALUES {_draws(Ivf.centroids, Ivf.seed)}) p(centroid_id, x) JOIN d ON d.idx = CAST(p.x % (SELECT CAST(count(*) AS UBIGINT) FROM d) AS BIGINT))",
    ]
    mean = _u("CAST(CAST(CAST(sum(u{i}) AS FLOAT) AS DOUBLE) / CAST(CAST(count(*) AS FLOAT) AS DOUBLE) AS FLOAT) AS u{i}")
    for j in range(1, rounds + 2):
        parts.append(f"t{j} AS MATERIALIZED (SELECT centroid_id, {_u('CAST(trunc(u{i}) AS INTEGER) AS u{i}')} FROM c{j})")
        if j > rounds:
            break
        parts.append(f"a{j} AS MATERIALIZED (SELECT d.ref_id, CAST(min({_dist('d', 't', 'u')} * {Ivf.centroids} + t.centroid_id) % {Ivf.centroids} AS INTEGER) AS centroid_id FROM d, t{j} t GROUP BY d.ref_id)")
        parts.append(f"g{j} AS (SELECT {j} AS iteration, count(*) AS changed FROM a1 WHERE centroid_id <> 0)" if j == 1 else f"g{j} AS (SELECT {j} AS iteration, count(*) AS changed FROM a{j} x JOIN a{j - 1} y USING (ref_id) WHERE x.centroid_id <> y.centroid_id)")
        parts.append(f"c{j + 1} AS MATERIALIZED (SELECT c.centroid_id, {_u('coalesce(m.u{i}, c.u{i}) AS u{i}')} FROM c{j} c LEFT JOIN (SELECT centroid_id, {mean} FROM a{j} JOIN d USING (ref_id) GROUP BY centroid_id) m USING (centroid_id))")
    return ", ".join(parts)


_R = Ivf.iterations
TRAINED = _trained(_R)
BUILT = f"""{TRAINED},
p AS (SELECT d.ref_id AS query_id, c.centroid_id, row_number() OVER (PARTITION BY d.ref_id ORDER BY {_dist("d", "c", "u")}, c.centroid_id) AS probe FROM d, t{_R + 1} c WHERE d.ref_id % 20 = 0 QUALIFY probe <= {Ivf.nprobe}),
n AS (SELECT p.query_id, b.ref_id, b.fraud, row_number() OVER (PARTITION BY p.query_id ORDER BY {_dist("q", "b", "u")}, b.ref_id) AS rank FROM p JOIN d q ON q.ref_id = p.query_id JOIN (SELECT d.*, a.centroid_id FROM d JOIN a{_R} a USING (ref_id)) b ON b.centroid_id = p.centroid_id AND b.ref_id <> p.query_id QUALIFY rank <= {Ivf.k})"""

_PREVIOUS = "o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, ref_id) AS at FROM r)".replace("AS at", "AS place")

SPREAD = f"""{VECTORS},
s AS (SELECT part_key, {", ".join(f"CAST(count(*) AS HUGEINT) * sum(CAST(q{i} AS HUGEINT) * q{i}) - CAST(sum(q{i}) AS HUGEINT) * sum(q{i}) AS w{i}" for i in _N)} FROM r GROUP BY part_key),
m AS (SELECT *, greatest({", ".join(f"w{i}" for i in _N)}) AS most FROM s)"""

_BOXES = ", ".join(f"min(q{i}) AS min_q{i}, max(q{i}) AS max_q{i}" for i in _N)
_OUTSIDE = " + ".join(f"greatest(CAST(b.min_q{i} AS BIGINT) - r.q{i}, CAST(r.q{i} AS BIGINT) - b.max_q{i}, 0) * greatest(CAST(b.min_q{i} AS BIGINT) - r.q{i}, CAST(r.q{i} AS BIGINT) - b.max_q{i}, 0)" for i in _N)

SQL: dict[str, str] = {
    "src_transactions": f"WITH {TX} SELECT event_id, {_v('amount', 'customer_avg', 'merchant_avg', 'km_from_home', 'last_km')}, installments, requested_at, tx_count_24h, merchant_id, mcc, is_online, card_present, last_timestamp, label FROM tx",
    "parse_payload": f"WITH {TX} SELECT event_id, {_v('amount', 'customer_avg', 'km_from_home', 'last_km')}, installments, requested_at, tx_count_24h, CAST(CASE WHEN unknown THEN 1 ELSE 2 END AS BIGINT) AS n_known, merchant_id, mcc, is_online, card_present, last_timestamp FROM tx",
    "validate_status": "SELECT event_id, CASE WHEN event_id % 11 IN (0, 9, 10) THEN 200 ELSE 400 END AS status FROM events",
    "reject_oversize": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 200 ELSE 400 END AS status FROM events",
    "http_content_length": "SELECT event_id, CAST(CASE event_id % 7 WHEN 0 THEN 100 WHEN 1 THEN 100 WHEN 4 THEN 100 ELSE 0 END AS BIGINT) AS content_length FROM events",
    "http_route": "SELECT event_id, CASE event_id % 7 WHEN 5 THEN 'ready' WHEN 6 THEN 'none' ELSE 'score' END AS route FROM events",
    "dispatch_round_robin": "SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 2 AS INTEGER) AS backend FROM events",
    "feature_vector": f"WITH {FEATURES} SELECT event_id, {_v(*(f'v{i}' for i in _N))} FROM f",
    "quantize_i16": f"WITH {VECTORS} SELECT ref_id AS event_id, {', '.join(f'q{i}' for i in _N)} FROM r",
    "quantize_u8": f"WITH {VECTORS} SELECT ref_id AS event_id, {', '.join(f'u{i}' for i in _N)} FROM r",
    "partition_key": f"WITH {VECTORS} SELECT ref_id AS event_id, part_key FROM r",
    "partition_counts": f"WITH {VECTORS} SELECT part_key, count(*) AS n FROM r GROUP BY part_key",
    "label_counts": f"WITH {FEATURES} SELECT count(*) AS n, CAST(sum(fraud) AS BIGINT) AS n_fraud, CAST(count(*) - sum(fraud) AS BIGINT) AS n_legit, CAST(100 AS DOUBLE) * CAST(sum(fraud) AS BIGINT) / count(*) AS fraud_percent FROM f",
    "bbox_by_partition": f"WITH {VECTORS} SELECT part_key, {_BOXES} FROM r GROUP BY part_key",
    "max_variance_dim": f"WITH {SPREAD} SELECT part_key, CASE {' '.join(f'WHEN w{i} = most THEN {i}' for i in _N)} END AS dimension FROM m",
    "box_lower_bound": f"WITH {VECTORS}, b AS (SELECT part_key, {_BOXES} FROM r GROUP BY part_key) SELECT r.ref_id AS query_id, b.part_key, CAST({_OUTSIDE} AS BIGINT) AS bound FROM r, b WHERE r.ref_id % 20 = 0",
    "box_lower_bound_all": f"WITH {VECTORS}, b AS (SELECT part_key, {_BOXES} FROM r GROUP BY part_key) SELECT r.ref_id, b.part_key, CAST({_OUTSIDE} AS BIGINT) AS bound FROM r, b",
    "cell_counts": f"WITH RECURSIVE {VECTORS}, s AS (SELECT part_key, count(*) AS n FROM r GROUP BY part_key), t AS (SELECT part_key, n FROM s UNION ALL SELECT part_key, unnest([n // 2, n - n // 2]) FROM t WHERE n > 64) SELECT part_key, max(n) AS vectors, count(*) FILTER (WHERE n <= 64) AS leaves, count(*) AS nodes FROM t GROUP BY part_key",
    "validate_malformed": f"WITH {TX}, s AS (SELECT *, event_id % 9 IN (0, 1, 4, 8) AS ok FROM tx) SELECT event_id, CASE WHEN ok THEN 200 ELSE 400 END AS status, CASE WHEN ok THEN merchant_id END AS merchant_id, CAST(CASE WHEN NOT ok THEN -1 WHEN event_id % 9 = 4 THEN 4294967295 ELSE installments END AS BIGINT) AS installments FROM s",
    "labelled_source": f"WITH {FEATURES} SELECT fraud, {', '.join(f'CAST(v{i} AS DOUBLE) AS v{i}' if i < 10 else f'CASE WHEN event_id % 3 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(v{i} AS DOUBLE) END AS v{i}' for i in _N)} FROM f",
    "dispatch_global": "WITH s AS (SELECT event_id, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) % 2 AS INTEGER) AS slot, event_type <> 'error' AS up0, event_id % 7 <> 0 AS up1 FROM events) SELECT event_id, slot, CASE WHEN slot = 0 THEN CASE WHEN up0 THEN 0 WHEN up1 THEN 1 ELSE -1 END ELSE CASE WHEN up1 THEN 1 WHEN up0 THEN 0 ELSE -1 END END AS backend FROM s",
    "kmeans_full": f"WITH {TRAINED}, l AS (SELECT t.centroid_id, count(a.ref_id) AS len FROM t{_R + 1} t LEFT JOIN a{_R} a USING (centroid_id) GROUP BY t.centroid_id) SELECT centroid_id, len, CAST(sum(len) OVER (ORDER BY centroid_id) - len AS BIGINT) AS start, {_u('u{i}')} FROM l JOIN t{_R + 1} USING (centroid_id)",
    "kmeans_log": f"WITH {TRAINED}, g AS ({' UNION ALL '.join(f'SELECT * FROM g{j}' for j in range(1, _R + 1))}) SELECT iteration, changed, CAST(100 AS DOUBLE) * changed / (SELECT count(*) FROM d) AS percent FROM g WHERE iteration <= coalesce((SELECT min(iteration) FROM g WHERE changed = 0), {_R})",
    "ivf_build_votes": f"WITH {BUILT} SELECT d.ref_id AS query_id, CAST(coalesce(sum(n.fraud), 0) AS BIGINT) AS fraud_votes FROM d LEFT JOIN n ON n.query_id = d.ref_id WHERE d.ref_id % 20 = 0 GROUP BY 1",
    "dist_i16": f"WITH {VECTORS}, {_PREVIOUS} SELECT a.ref_id AS event_id, {_dist('a', 'b', 'q')} AS dist FROM o a JOIN o b ON a.user_id = b.user_id AND a.place = b.place + 1",
    "dist_u8": f"WITH {VECTORS}, {_PREVIOUS} SELECT a.ref_id AS event_id, {_dist('a', 'b', 'u')} AS dist FROM o a JOIN o b ON a.user_id = b.user_id AND a.place = b.place + 1",
    "knn_exact_neighbors": f"WITH {NEAR} SELECT query_id, rank, ref_id, dist FROM n",
    "knn_cells": f"WITH {NEAR} SELECT query_id, rank, ref_id, dist FROM n",
    "knn_exact_votes": f"WITH {NEAR} {_VOTES}",
    "fraud_decision": f"WITH {NEAR} {_DECIDED}",
    "stream_score": f"WITH {NEAR} SELECT *, 200 AS status FROM ({_DECIDED})",
    "kmeans_assign": f"WITH {LISTS} SELECT ref_id, CAST(centroid_id AS INTEGER) AS centroid_id FROM a",
    "kmeans_update": f"WITH {LISTS}, m AS (SELECT CAST(centroid_id AS INTEGER) AS centroid_id, count(*) AS n, {', '.join(f'CAST(CAST(CAST(sum(u{i}) AS FLOAT) AS DOUBLE) / CAST(CAST(count(*) AS FLOAT) AS DOUBLE) AS FLOAT) AS m{i}' for i in _N)} FROM a GROUP BY centroid_id) SELECT centroid_id, n, {', '.join(f'CAST(m{i} AS DOUBLE) AS m_u{i}, CAST(trunc(m{i}) AS INTEGER) AS u{i}' for i in _N)} FROM m",
    "ivf_buckets": f"WITH {LISTS}, l AS (SELECT c.centroid_id, count(a.ref_id) AS len FROM c LEFT JOIN a ON a.centroid_id = c.centroid_id GROUP BY c.centroid_id) SELECT CAST(centroid_id AS INTEGER) AS centroid_id, len, CAST(sum(len) OVER (ORDER BY centroid_id) - len AS BIGINT) AS start FROM l",
    "ivf_probe": f"WITH {PROBES} SELECT query_id, CAST(probe AS BIGINT) AS probe, centroid_id, centroid_dist FROM p",
    "ivf_votes": f"WITH {IVF_NEAR} {_VOTES}",
    "ivf_roundtrip": f"WITH {IVF_NEAR} {_VOTES}",
    "index_size": f"SELECT count(*) AS n, CAST(17 * count(*) + 24 * {Ivf.centroids} + 32 AS BIGINT) AS bytes FROM events",
    "store_roundtrip": f"WITH {VECTORS} SELECT part_key, count(*) AS n, CAST(sum(fraud) AS BIGINT) AS n_fraud, CAST(sum({' + '.join(f'CAST(q{i} AS BIGINT)' for i in _N)}) AS BIGINT) AS total FROM r GROUP BY part_key",
    "embedding_knn": f"WITH r AS (SELECT vec_id AS ref_id, label AS part_key, {', '.join(f'CAST(trunc(CAST(embedding[{i + 1}] * CAST(32767 AS FLOAT) AS FLOAT)) AS INTEGER) AS e{i}' for i in range(64))} FROM embeddings) SELECT a.ref_id AS query_id, row_number() OVER (PARTITION BY a.ref_id ORDER BY {_dist('a', 'b', 'e', range(64))}, b.ref_id) AS rank, b.ref_id, {_dist('a', 'b', 'e', range(64))} AS dist FROM r a JOIN r b ON a.part_key = b.part_key AND a.ref_id <> b.ref_id WHERE a.ref_id % 20 = 0 QUALIFY rank <= 5",
}
for _name, _columns in {"feat_amount": ["v0"], "feat_installments": ["v1"], "feat_amount_ratio": ["v2"], "feat_hour": ["v3"], "feat_weekday": ["v4"], "feat_minutes_since_last": ["v5"], "feat_km_last": ["v6"], "feat_km_home": ["v7"], "feat_tx_count_24h": ["v8"], "feat_flags": ["v9", "v10"], "feat_unknown_merchant": ["v11"], "feat_mcc_risk": ["v12"], "feat_merchant_avg": ["v13"]}.items():
    SQL[_name] = f"WITH {FEATURES} SELECT event_id, {_v(*_columns)} FROM f"
