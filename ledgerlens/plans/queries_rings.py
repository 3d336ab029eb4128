"""Queries of the graph and of fraud rings (survey section 2.9 and the joins it needs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import aggregates as A
from ledgerlens.operators import graph as G
from ledgerlens.operators import joins as J
from ledgerlens.operators import merge as M
from ledgerlens.operators import rings as R
from ledgerlens.operators.components import connected_components
from ledgerlens.operators.sampling import top_groups
from ledgerlens.plans.registry import WITH_D, WITH_TX, d, query, rounded, tx

# ---------------------------------------------------------------- edges and nodes
EDGE_CTE = """, edges AS (
    SELECT payer_id AS src_id, transaction_id AS dst_id, 'user' AS src_type, 'transaction' AS dst_type,
        'make_transaction' AS edge_type, 1.0::DOUBLE AS weight, timestamp,
        'transaction_log' AS source, greatest(is_fraud, 0) AS label FROM d
    UNION ALL SELECT transaction_id, payee_id, 'transaction', 'account', 'transfer_to', amount,
        timestamp, 'transaction_log', greatest(is_fraud, 0) FROM d
    UNION ALL SELECT payer_id, device_id, 'user', 'device', 'uses_device', 1.0, timestamp,
        'transaction_log', greatest(is_fraud, 0) FROM d WHERE device_id IS NOT NULL
    UNION ALL SELECT payer_id, ip_id, 'user', 'ip', 'login_ip', 1.0, timestamp, 'transaction_log',
        greatest(is_fraud, 0) FROM d WHERE ip_id IS NOT NULL
    UNION ALL SELECT transaction_id, merchant_id, 'transaction', 'merchant', 'paid_to_merchant',
        amount, timestamp, 'transaction_log', greatest(is_fraud, 0) FROM d
        WHERE merchant_id IS NOT NULL)"""
WITH_EDGES = WITH_D + EDGE_CTE


@query("tx_edges", WITH_EDGES + "SELECT * FROM edges")
def _edges(spark, sf):
    return G.tx_edges(d(spark, sf))


_INJ = WITH_D + """, i AS (SELECT *, 'mule' AS fraud_type FROM d WHERE is_injected = 1)"""
_INJ_EDGES = """, ie AS (
    SELECT payer_id AS src_id, transaction_id AS dst_id, 'make_transaction' AS edge_type,
        1.0::DOUBLE AS weight FROM i
    UNION ALL SELECT transaction_id, payee_id, 'transfer_to', amount FROM i
    UNION ALL SELECT payer_id, device_id, 'uses_device', 1.0 FROM i
    UNION ALL SELECT payer_id, ip_id, 'login_ip', 1.0 FROM i
    UNION ALL SELECT transaction_id, merchant_id, 'paid_to_merchant', amount FROM i
    UNION ALL SELECT payer_id, payee_id, fraud_type || '_transfer', amount FROM i
        WHERE merchant_id IS NULL
    UNION ALL SELECT payer_id, fraud_group_id, 'member_of_fraud_group', 1.0 FROM i
    UNION ALL SELECT device_id, fraud_group_id, 'device_used_by_fraud_group', 1.0 FROM i
    UNION ALL SELECT ip_id, fraud_group_id, 'ip_used_by_fraud_group', 1.0 FROM i
    UNION ALL SELECT merchant_id, fraud_group_id, 'merchant_used_by_fraud_group', 1.0 FROM i)"""


def _injected(spark, sf) -> DataFrame:
    return d(spark, sf).where(F.col("is_injected") == 1).withColumn("fraud_type", F.lit("mule"))


@query("augmented_edges", _INJ + _INJ_EDGES + """
SELECT src_id, dst_id, edge_type, weight, CAST(1 AS TINYINT) AS label FROM ie
WHERE src_id IS NOT NULL AND dst_id IS NOT NULL""")
def _augmented(spark, sf):
    return G.augmented_edges(_injected(spark, sf)).select(
        "src_id", "dst_id", "edge_type", "weight", "label")


@query("transfer_edges", WITH_D + """
SELECT payer_id AS src_id, payee_id AS dst_id, 'amlsim_transfer' AS edge_type, amount AS weight,
    timestamp, is_fraud AS label FROM d""")
def _transfers(spark, sf):
    return G.transfer_edges(d(spark, sf)).select(
        "src_id", "dst_id", "edge_type", "weight", "timestamp", "label")


@query("graph_union", WITH_D + """
SELECT payer_id AS src_id, payee_id AS dst_id, CAST(NULL AS SMALLINT) AS edge_subtype FROM d
UNION ALL SELECT payee_id, payer_id, CAST(k % 11 AS SMALLINT) FROM d""")
def _graph_union(spark, sf):
    base = d(spark, sf)
    one = base.select(F.col("payer_id").alias("src_id"), F.col("payee_id").alias("dst_id"))
    two = base.select(F.col("payee_id").alias("src_id"), F.col("payer_id").alias("dst_id"),
                      (F.col("k") % 11).alias("edge_subtype"))
    return G.graph_union([one, two])


_ENTITY_CTE = """, entity AS (SELECT DISTINCT * FROM (
    SELECT payer_id AS node_id, 'user' AS node_type, 0 AS r FROM d
    UNION ALL SELECT payee_id, 'user', 0 FROM d WHERE merchant_id IS NULL
    UNION ALL SELECT transaction_id, 'transaction', 1 FROM d
    UNION ALL SELECT merchant_id, 'merchant', 2 FROM d
    UNION ALL SELECT device_id, 'device', 3 FROM d
    UNION ALL SELECT ip_id, 'ip', 4 FROM d) AS q WHERE node_id IS NOT NULL)"""


@query("entity_nodes", WITH_D + _ENTITY_CTE + """
SELECT node_id, node_type, CAST(-1 AS TINYINT) AS label, 'entity' AS raw_label FROM entity""")
def _entities(spark, sf):
    return G.entity_nodes(d(spark, sf)).select("node_id", "node_type", "label", "raw_label")


_ENDPOINT_CTE = """, ends AS (
    SELECT src_id AS node_id, src_type AS node_type, source, 0 AS side, edge_type FROM edges
    UNION ALL SELECT dst_id, dst_type, source, 1, edge_type FROM edges),
endpoint AS (SELECT node_id, node_type, source FROM ends QUALIFY row_number() OVER (
    PARTITION BY node_id ORDER BY side, CASE edge_type WHEN 'make_transaction' THEN 0
    WHEN 'transfer_to' THEN 1 WHEN 'uses_device' THEN 2 WHEN 'login_ip' THEN 3 ELSE 4 END) = 1)"""


@query("endpoint_nodes", WITH_EDGES + _ENDPOINT_CTE + """
SELECT node_id, node_type, source, 'edge_endpoint' AS raw_label FROM endpoint""")
def _endpoints(spark, sf):
    return G.endpoint_nodes(G.tx_edges(d(spark, sf))).select(
        "node_id", "node_type", "source", "raw_label")


@query("graph_nodes", WITH_EDGES + _ENTITY_CTE + _ENDPOINT_CTE + """, every AS (
    SELECT node_id, node_type, 'entity' AS raw_label, 0 AS p, r FROM entity
    UNION ALL SELECT node_id, node_type, 'edge_endpoint', 1, 0 FROM endpoint)
SELECT node_id, node_type, raw_label FROM every
QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY p, r) = 1""")
def _nodes(spark, sf):
    from ledgerlens.plans.dataset import build_graph

    nodes, _ = build_graph(d(spark, sf))
    return nodes.select("node_id", "node_type", "raw_label")


@query("explicit_nodes", _INJ + """, n AS (
    SELECT transaction_id AS node_id, 'transaction' AS node_type, 0 AS r, timestamp, transaction_id AS x FROM i
    UNION ALL SELECT fraud_group_id, 'fraud_group', 1, timestamp, transaction_id FROM i
    UNION ALL SELECT payer_id, 'user', 2, timestamp, transaction_id FROM i
    UNION ALL SELECT payee_id, 'user', 3, timestamp, transaction_id FROM i
        WHERE payee_id IS DISTINCT FROM merchant_id
    UNION ALL SELECT merchant_id, 'merchant', 4, timestamp, transaction_id FROM i
    UNION ALL SELECT device_id, 'device', 5, timestamp, transaction_id FROM i
    UNION ALL SELECT ip_id, 'ip', 6, timestamp, transaction_id FROM i)
SELECT node_id, node_type, CAST(1 AS TINYINT) AS label, 'mule' AS raw_label, timestamp FROM n
WHERE node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY timestamp, x, r) = 1""")
def _explicit(spark, sf):
    return G.explicit_nodes(_injected(spark, sf)).select(
        "node_id", "node_type", "label", "raw_label", "timestamp")


_DEGREE = WITH_EDGES + """, degree AS (SELECT entity_id, count(*) AS graph_degree,
    count(*) FILTER (label = 1) AS graph_fraud_edge_count,
    count(*) FILTER (label = 1) / count(*) AS ratio FROM (
        SELECT src_id AS entity_id, label FROM edges UNION ALL SELECT dst_id, label FROM edges) AS q
    GROUP BY entity_id)"""


@query("entity_degree", _DEGREE + """
SELECT entity_id, graph_degree, graph_fraud_edge_count, round(ratio, 5) AS graph_fraud_edge_ratio
FROM degree""")
def _degree(spark, sf):
    return rounded(A.entity_degree(G.tx_edges(d(spark, sf))), "graph_fraud_edge_ratio", digits=5)


@query("node_timestamp_lookup", WITH_EDGES + """
SELECT e.src_id, e.dst_id, n.timestamp FROM edges AS e LEFT JOIN
    (SELECT transaction_id AS node_id, timestamp FROM d) AS n ON e.src_id = n.node_id
WHERE e.edge_type IN ('transfer_to', 'login_ip')""")
def _node_time(spark, sf):
    base = d(spark, sf)
    edges = G.tx_edges(base).where(F.col("edge_type").isin("transfer_to", "login_ip"))
    nodes = base.select(F.col("transaction_id").alias("node_id"), "timestamp")
    return J.node_timestamp_lookup(edges, nodes).select("src_id", "dst_id", "timestamp")


_NODE_CTE = """, node AS (SELECT node_id, max(k[2]) AS top, count(*) AS degree,
    max(label) AS node_label, max_by(kind, key) AS node_type FROM (
    SELECT node_id, label, kind, side * 100 + CASE edge_type WHEN 'make_transaction' THEN 0
        WHEN 'transfer_to' THEN 1 WHEN 'uses_device' THEN 2 WHEN 'login_ip' THEN 3 ELSE 4 END AS key,
        [0, side] AS k FROM (
        SELECT src_id AS node_id, src_type AS kind, label, 0 AS side, edge_type FROM edges
        UNION ALL SELECT dst_id, dst_type, label, 1, edge_type FROM edges) AS q) AS r
    GROUP BY node_id)"""


@query("node_features", WITH_EDGES + _NODE_CTE + """
SELECT node_id, node_type, degree, CAST(node_type = 'user' AS DOUBLE) AS type_user,
    CAST(node_type = 'device' AS DOUBLE) AS type_device, round(ln(1 + degree), 6) AS log_degree,
    round(degree / (SELECT max(degree) FROM node), 6) AS relative_degree, node_label FROM node""")
def _node_features(spark, sf):
    out = G.node_features(G.tx_edges(d(spark, sf))).select(
        "node_id", "node_type", "degree", "type_user", "type_device", "log_degree",
        "relative_degree", "node_label")
    return rounded(out, "log_degree", "relative_degree")


@query("neighbor_mean", WITH_EDGES + _NODE_CTE + """, f AS (
    SELECT node_id, ln(1 + degree) AS ld, CAST(node_type = 'user' AS DOUBLE) AS tu FROM node),
one AS (SELECT n.node_id, avg(f.ld) AS ld, avg(f.tu) AS tu FROM (
        SELECT src_id AS node_id, dst_id AS other FROM edges
        UNION ALL SELECT dst_id, src_id FROM edges) AS n JOIN f ON n.other = f.node_id
    GROUP BY n.node_id)
SELECT node_id, round(ld, 6) AS nbr_log_degree, round(tu, 6) AS nbr_type_user FROM one""")
def _neighbor(spark, sf):
    edges = G.tx_edges(d(spark, sf))
    out = G.neighbor_mean(G.node_features(edges), edges, ["log_degree", "type_user"])
    return rounded(out.select("node_id", "nbr_log_degree", "nbr_type_user"),
                   "nbr_log_degree", "nbr_type_user")


# ---------------------------------------------------------------- rings
TOUCH_CTE = """, mtx AS (SELECT * FROM tx WHERE split = 'train'),
touch AS (SELECT 0 AS kind_order, 'device' AS entity_type, device_id AS entity_id, * FROM mtx
    WHERE device_id IS NOT NULL
    UNION ALL SELECT 1, 'ip', ip_id, * FROM mtx WHERE ip_id IS NOT NULL
    UNION ALL SELECT 2, 'merchant', merchant_id, * FROM mtx WHERE merchant_id IS NOT NULL
    UNION ALL SELECT 3, 'payee', payee_id, * FROM mtx WHERE payee_id IS NOT NULL),
stats AS (SELECT kind_order, entity_type, entity_id, count(DISTINCT payer_id) AS shared_user_count,
    count(*) AS txn_count, sum(amount) AS amount_sum, CAST(sum(is_fraud) AS BIGINT) AS
    fraud_seed_count, CAST(sum(is_injected) AS BIGINT) AS injected_count,
    count(DISTINCT injection_scenario) AS scenario_count FROM touch GROUP BY ALL
    HAVING count(DISTINCT payer_id) >= CASE entity_type WHEN 'device' THEN 2 WHEN 'merchant'
        THEN 4 ELSE 3 END),
q AS (SELECT entity_type, quantile_cont(amount_sum, 0.9) AS aq, quantile_cont(txn_count, 0.9) AS tq
    FROM stats GROUP BY entity_type),
risk AS (SELECT stats.*, least(1.0, 0.38 * least(1.0, fraud_seed_count / txn_count)
    + 0.26 * least(1.0, ln(1 + shared_user_count) / ln(40))
    + 0.18 * least(1.0, amount_sum / greatest(aq, 1.0)) + 0.10 * least(1.0, txn_count / tq)
    + 0.08 * least(1.0, scenario_count / 3)) AS resource_risk_score
    FROM stats JOIN q USING (entity_type)),
cand AS (SELECT * FROM risk WHERE fraud_seed_count >= CASE WHEN kind_order < 2 THEN 1 ELSE 2 END
    OR (resource_risk_score >= 0.45 AND txn_count >= 2 * CASE entity_type WHEN 'device' THEN 2
        WHEN 'merchant' THEN 4 ELSE 3 END))"""
WITH_CAND = WITH_TX.replace("WITH tx", "WITH RECURSIVE tx", 1) + TOUCH_CTE
RING_CTE = """, payers AS (SELECT DISTINCT payer_id FROM mtx),
chains AS (SELECT payer_id, payee_id, timestamp, transaction_id FROM mtx
    WHERE payee_id IN (SELECT payer_id FROM payers)
    AND (is_fraud = 1 OR amount >= (SELECT quantile_cont(amount, 0.95) FROM mtx))),
redges AS (SELECT DISTINCT payer_id AS src, entity_id AS dst FROM touch
        JOIN (SELECT entity_type, entity_id FROM cand) AS c USING (entity_type, entity_id)
    UNION SELECT payer_id, payee_id FROM chains),
sym AS (SELECT src AS a, dst AS b FROM redges UNION SELECT dst, src FROM redges),
reach(node, other) AS (SELECT a, a FROM sym UNION
    SELECT reach.node, sym.b FROM reach JOIN sym ON reach.other = sym.a),
labels AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
marked AS (SELECT component, node AS entity_id, node IN (SELECT payer_id FROM payers) AS is_user
    FROM labels),
members AS (SELECT * FROM marked WHERE component IN (SELECT component FROM marked WHERE is_user
    GROUP BY component HAVING count(*) >= 2)),
evid AS (SELECT * REPLACE (first_kind AS kind_order) FROM (SELECT *, min(kind_order) OVER
    (PARTITION BY entity_id) AS first_kind, row_number() OVER (PARTITION BY entity_id ORDER BY
    kind_order DESC) AS place FROM cand) AS e WHERE place = 1),
proof AS (SELECT m.component, e.* FROM evid AS e JOIN members AS m USING (entity_id)),
rtx AS (SELECT m.component, t.* FROM mtx AS t JOIN members AS m ON t.payer_id = m.entity_id
    AND m.is_user),
shape AS (SELECT component, count(*) AS entity_count, count(*) FILTER (is_user) AS user_count,
    count(*) FILTER (starts_with(entity_id, 'D_')) AS shared_device_count,
    count(*) FILTER (starts_with(entity_id, 'IP_')) AS shared_ip_count,
    count(*) FILTER (starts_with(entity_id, 'M_')) AS shared_merchant_count,
    count(*) FILTER (starts_with(entity_id, 'payee:')) AS shared_payee_count
    FROM members GROUP BY component),
money AS (SELECT component, count(*) AS txn_count, sum(amount) AS amount_sum,
    CAST(sum(is_fraud) AS BIGINT) AS fraud_seed_count,
    CAST(sum(is_injected) AS BIGINT) AS injected_txn_count,
    count(DISTINCT fraud_group_id) AS injected_group_count,
    count(DISTINCT injection_scenario) AS scenario_count FROM rtx GROUP BY component),
domi AS (SELECT component, fraud_group_id AS dominant_injected_group, n / total AS
    dominant_injected_share FROM (SELECT component, fraud_group_id, count(*) AS n,
    sum(count(*)) OVER (PARTITION BY component) AS total, row_number() OVER (PARTITION BY component
    ORDER BY count(*) DESC, fraud_group_id) AS place FROM rtx WHERE fraud_group_id IS NOT NULL
    GROUP BY component, fraud_group_id) AS g WHERE place = 1),
scen AS (SELECT component, injection_scenario AS name, count(*) AS n, row_number() OVER (
    PARTITION BY component ORDER BY count(*) DESC, injection_scenario) AS place
    FROM rtx WHERE injection_scenario IS NOT NULL GROUP BY component, injection_scenario),
topscen AS (SELECT component, string_agg(name || '=' || n, ',' ORDER BY place) AS top_scenarios
    FROM scen WHERE place <= 5 GROUP BY component),
figures AS (SELECT shape.*, money.* EXCLUDE (component),
    coalesce((SELECT count(*) FROM proof WHERE proof.component = shape.component), 0)
    AS evidence_count, dominant_injected_group, coalesce(dominant_injected_share, 0)
    AS dominant_injected_share, coalesce(top_scenarios, '') AS top_scenarios
    FROM shape JOIN money USING (component) LEFT JOIN domi USING (component)
    LEFT JOIN topscen USING (component)),
ring0 AS (SELECT *, least(1.0, 0.40 * fraud_seed_count / txn_count
    + 0.20 * least(1.0, ln(1 + user_count) / ln(30))
    + 0.17 * least(1.0, ln(1 + evidence_count) / ln(20))
    + 0.13 * least(1.0, (shared_device_count + shared_ip_count) / user_count)
    + 0.06 * least(1.0, scenario_count / 3)
    + 0.04 * least(1.0, entity_count / (2 * user_count))) AS score FROM figures),
born AS (SELECT component, min(kind_order * 1000000 + rk) AS res FROM (SELECT component, kind_order,
    row_number() OVER (ORDER BY kind_order, entity_id) AS rk FROM proof) AS z GROUP BY component),
bornc AS (SELECT component, min(rk) AS ch FROM (SELECT m.component, row_number() OVER (
    ORDER BY c.timestamp, c.transaction_id) AS rk FROM chains AS c JOIN members AS m
    ON c.payer_id = m.entity_id) AS z GROUP BY component),
rings AS (SELECT ring0.*, 'GM_' || lpad(CAST(row_number() OVER (ORDER BY res IS NULL, res, ch)
    AS VARCHAR), 6, '0') AS ring_id FROM ring0 LEFT JOIN born USING (component)
    LEFT JOIN bornc USING (component) WHERE score >= 0.35 OR evidence_count > 0)"""
WITH_RINGS = WITH_CAND + RING_CTE


def mining(spark, sf) -> DataFrame:
    return tx(spark, sf).where(F.col("split") == "train")


def mined(spark, sf) -> R.RingTables:
    return R.mine_rings(mining(spark, sf))


_STATS = """entity_type, entity_id, shared_user_count, txn_count, round(amount_sum, 4) AS amount_sum,
    fraud_seed_count, injected_count, scenario_count"""


@query("resource_stats", WITH_CAND + f"SELECT {_STATS} FROM stats")
def _stats(spark, sf):
    return rounded(R.resource_stats(mining(spark, sf)).select(
        "entity_type", "entity_id", "shared_user_count", "txn_count", "amount_sum",
        "fraud_seed_count", "injected_count", "scenario_count"), "amount_sum", digits=4)


@query("resource_risk", WITH_CAND + """
SELECT entity_type, entity_id, round(resource_risk_score, 6) AS resource_risk_score FROM risk""")
def _risk(spark, sf):
    return rounded(R.resource_risk(R.resource_stats(mining(spark, sf))).select(
        "entity_type", "entity_id", "resource_risk_score"), "resource_risk_score")


@query("candidate_resources", WITH_CAND + """
SELECT entity_type, entity_id, entity_type || '_id' AS resource_col, 'shared_' || entity_type
    AS evidence_kind FROM cand""")
def _candidates(spark, sf):
    return R.candidate_resources(mining(spark, sf)).select(
        "entity_type", "entity_id", "resource_col", "evidence_kind")


@query("resource_membership", WITH_CAND + """
SELECT transaction_id, payer_id, device_id FROM mtx WHERE device_id IN (
    SELECT entity_id FROM cand WHERE entity_type = 'device')""")
def _membership(spark, sf):
    base = mining(spark, sf)
    return J.resource_membership(base, R.candidate_resources(base), "device_id").select(
        "transaction_id", "payer_id", "device_id")


@query("ring_edges", WITH_RINGS + "SELECT src, dst FROM redges")
def _ring_edges(spark, sf):
    base = mining(spark, sf)
    return R.ring_edges(base, R.candidate_resources(base))


@query("connected_components", WITH_RINGS + "SELECT node, component FROM labels")
def _components(spark, sf):
    base = mining(spark, sf)
    return connected_components(R.ring_edges(base, R.candidate_resources(base)))


@query("components_of_transfers", WITH_TX.replace("WITH tx", "WITH RECURSIVE tx", 1) + """,
sym AS (SELECT DISTINCT payer_id AS a, payee_id AS b FROM tx UNION SELECT payee_id, payer_id FROM tx),
reach(node, other) AS (SELECT a, a FROM sym UNION
    SELECT reach.node, sym.b FROM reach JOIN sym ON reach.other = sym.a)
SELECT node, min(other) AS component FROM reach GROUP BY node""")
def _transfer_components(spark, sf):
    edges = tx(spark, sf).select(F.col("payer_id").alias("src"), F.col("payee_id").alias("dst"))
    return connected_components(edges)


@query("ring_members", WITH_RINGS + "SELECT component, entity_id, is_user FROM members")
def _members(spark, sf):
    return mined(spark, sf).members


@query("member_intersect", WITH_RINGS + "SELECT entity_id FROM members WHERE is_user")
def _intersect(spark, sf):
    return M.member_intersect(mined(spark, sf).members, mining(spark, sf), "entity_id").select("entity_id")


@query("member_minus", WITH_RINGS + "SELECT entity_id FROM members WHERE NOT is_user")
def _minus(spark, sf):
    return M.member_minus(mined(spark, sf).members, mining(spark, sf), "entity_id").select("entity_id")


_FIGURES = ("entity_count", "user_count", "txn_count", "amount_sum", "fraud_seed_count",
            "injected_txn_count", "injected_group_count", "scenario_count", "shared_device_count",
            "shared_ip_count", "shared_merchant_count", "shared_payee_count", "evidence_count")


@query("ring_features", WITH_RINGS + f"""
SELECT ring_id, {', '.join(_FIGURES).replace('amount_sum', 'round(amount_sum, 3) AS amount_sum')},
    entity_count - user_count AS resource_count,
    round(fraud_seed_count / txn_count, 6) AS fraud_seed_ratio FROM rings""")
def _features(spark, sf):
    out = mined(spark, sf).rings.select(F.col("fraud_group_mining_id").alias("ring_id"), *_FIGURES,
                                        "resource_count", "fraud_seed_ratio")
    return rounded(rounded(out, "fraud_seed_ratio"), "amount_sum", digits=3)


@query("ring_risk", WITH_RINGS + "SELECT component, round(score, 6) AS risk FROM rings")
def _ring_risk(spark, sf):
    return rounded(mined(spark, sf).rings.select(
        "component", F.col("graph_mining_group_risk_score").alias("risk")), "risk")


@query("ring_filter_number", WITH_RINGS + "SELECT component, ring_id FROM rings")
def _number(spark, sf):
    return mined(spark, sf).rings.select("component", F.col("fraud_group_mining_id").alias("ring_id"))


@query("ring_evidence", WITH_RINGS + """
SELECT component, entity_id, entity_type, shared_user_count, txn_count, fraud_seed_count,
    round(resource_risk_score, 6) AS resource_risk_score FROM proof""")
def _evidence(spark, sf):
    return rounded(mined(spark, sf).evidence.select(
        "component", "entity_id", "entity_type", "shared_user_count", "txn_count",
        "fraud_seed_count", "resource_risk_score"), "resource_risk_score")


@query("top_evidence", WITH_RINGS + """, p AS (SELECT component, entity_id, row_number() OVER (
    PARTITION BY component ORDER BY kind_order, entity_id) AS place FROM proof)
SELECT component, string_agg(entity_id, ',' ORDER BY place) AS evidence FROM p WHERE place <= 20
GROUP BY component""")
def _top_evidence(spark, sf):
    out = R.top_evidence(mined(spark, sf).evidence)
    return out.select("component", F.array_join(
        F.transform("evidence", lambda e: e["entity_id"]), ",").alias("evidence"))


@query("sample_members", WITH_RINGS + """, p AS (SELECT component, entity_id, is_user, row_number()
    OVER (PARTITION BY component, is_user ORDER BY entity_id) AS place FROM members)
SELECT component, string_agg(entity_id, ',' ORDER BY entity_id) FILTER (is_user) AS users,
    string_agg(entity_id, ',' ORDER BY entity_id) FILTER (NOT is_user) AS resources
FROM p WHERE place <= 12 GROUP BY component""")
def _samples(spark, sf):
    return R.sample_members(mined(spark, sf).members).select(
        "component", F.array_join("sample_users", ",").alias("users"),
        F.array_join("sample_resources", ",").alias("resources"))


@query("top_k_scenarios", WITH_RINGS + "SELECT ring_id, top_scenarios FROM rings")
def _scenarios(spark, sf):
    rings = mined(spark, sf).rings
    pairs = F.transform("scenario_names", lambda n: F.concat(
        n, F.lit("="), F.element_at("top_scenarios", n).cast("string")))
    return rings.select(F.col("fraud_group_mining_id").alias("ring_id"), F.coalesce(
        F.array_join(pairs, ","), F.lit("")).alias("top_scenarios"))


@query("dominant_group", WITH_RINGS + """
SELECT ring_id, dominant_injected_group, round(dominant_injected_share, 6) AS dominant_injected_share
FROM rings""")
def _dominant(spark, sf):
    return rounded(mined(spark, sf).rings.select(
        F.col("fraud_group_mining_id").alias("ring_id"), "dominant_injected_group",
        "dominant_injected_share"), "dominant_injected_share")


@query("top_groups", WITH_RINGS + """
SELECT ring_id, round(score, 6) AS risk FROM rings ORDER BY score DESC, ring_id LIMIT 5""")
def _top(spark, sf):
    return rounded(top_groups(mined(spark, sf).rings, 5).select(
        F.col("fraud_group_mining_id").alias("ring_id"),
        F.col("graph_mining_group_risk_score").alias("risk")), "risk")


_CODES = """array_to_string(list_filter([
    CASE WHEN score >= 0.75 THEN 'high_confidence_ring' END,
    CASE WHEN shared_device_count >= 2 THEN 'shared_device_ring' END,
    CASE WHEN shared_ip_count >= 2 THEN 'shared_ip_cluster' END,
    CASE WHEN shared_merchant_count >= 1 THEN 'merchant_cashout_cluster' END,
    CASE WHEN shared_payee_count >= 1 THEN 'shared_payee_chain' END,
    CASE WHEN fraud_seed_count >= 3 THEN 'fraud_seed_propagation' END,
    CASE WHEN scenario_count >= 2 THEN 'multi_scenario_campaign' END,
    CASE WHEN contains(top_scenarios, 'money_laundering') OR contains(top_scenarios, 'mule')
        THEN 'fund_transfer_chain' END], lambda x: x IS NOT NULL), ',')"""


@query("ring_explain", WITH_RINGS + f""", t AS (SELECT component, entity_id, row_number() OVER (
    PARTITION BY component ORDER BY resource_risk_score DESC, kind_order, entity_id) AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY component ORDER BY kind_order, entity_id) AS p1
        FROM proof) AS z WHERE p1 <= 20),
kinds AS (SELECT component, string_agg(kind || '=' || n, ',' ORDER BY kind) AS by_kind FROM (
    SELECT component, evidence_kind AS kind, count(*) AS n FROM (
        SELECT *, 'shared_' || entity_type AS evidence_kind FROM proof) AS p GROUP BY ALL) AS g
    GROUP BY component)
SELECT ring_id, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.65 THEN 'medium' ELSE 'watch' END
    AS risk_level, {_CODES} AS codes, (SELECT string_agg(entity_id, ',' ORDER BY place) FROM t
    WHERE t.component = rings.component AND place <= 5) AS top_resources,
    (SELECT by_kind FROM kinds WHERE kinds.component = rings.component) AS by_kind FROM rings""")
def _explain(spark, sf):
    return R.ring_detail(mined(spark, sf)).select(
        F.col("fraud_group_mining_id").alias("ring_id"), "risk_level",
        F.array_join("explanation_codes", ",").alias("codes"),
        F.array_join(F.transform("top_resources", lambda e: e["entity_id"]), ",").alias("top_resources"),
        F.array_join(F.transform(F.array_sort(F.map_entries("evidence_by_kind")), lambda e: F.concat(
            e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("by_kind"))


@query("ring_subgraph", WITH_RINGS + """, u AS (SELECT component, is_user, count(*) AS n FROM members
    GROUP BY component, is_user)
SELECT ring_id, 2 + least(10, user_count) + least(12, entity_count - user_count) AS nodes,
    1 + least(10, user_count) + least(12, entity_count - user_count) AS edges FROM rings""")
def _subgraph(spark, sf):
    return R.ring_detail(mined(spark, sf)).select(
        F.col("fraud_group_mining_id").alias("ring_id"), F.size("nodes").alias("nodes"),
        F.size("edges").alias("edges"))


@query("entity_ring_risk", WITH_RINGS + """
SELECT m.entity_id, ring_id AS fraud_group_mining_id, round(score, 6) AS
    graph_mining_group_risk_score, user_count AS graph_mining_group_user_count,
    evidence_count AS graph_mining_evidence_count FROM members AS m JOIN rings USING (component)""")
def _entity_risk(spark, sf):
    return rounded(R.entity_ring_risk(mined(spark, sf)).select(
        "entity_id", "fraud_group_mining_id", "graph_mining_group_risk_score",
        "graph_mining_group_user_count", "graph_mining_evidence_count"),
        "graph_mining_group_risk_score")


_FLAGGED_CTE = """, ent AS (SELECT m.entity_id, r.ring_id, r.score FROM members AS m
    JOIN rings AS r USING (component)),
etx AS (SELECT * FROM tx WHERE split IN ('train', 'valid', 'test')),
steps AS (SELECT unnest({steps}) AS threshold),
fl AS (SELECT s.threshold, t.is_injected, t.fraud_group_id, e.ring_id,
    coalesce(e.score >= s.threshold, FALSE) AS hit
    FROM etx AS t LEFT JOIN ent AS e ON t.payer_id = e.entity_id, steps AS s),
pur AS (SELECT threshold, avg(p) AS purity FROM (SELECT threshold, ring_id, max(n) / sum(n) AS p FROM (
    SELECT threshold, ring_id, fraud_group_id, count(*) AS n FROM fl WHERE hit AND fraud_group_id
    IS NOT NULL GROUP BY ALL) AS a GROUP BY threshold, ring_id) AS b GROUP BY threshold)
SELECT {first} count(*) FILTER (is_injected = 1) AS injected_rows,
    count(*) FILTER (is_injected = 1 AND hit) AS detected_injected_rows,
    round(count(*) FILTER (is_injected = 1 AND hit) / greatest(count(*) FILTER (is_injected = 1), 1), 6)
        AS injected_row_recall,
    count(DISTINCT fraud_group_id) FILTER (is_injected = 1) AS injected_group_count,
    count(DISTINCT fraud_group_id) FILTER (is_injected = 1 AND hit) AS detected_injected_group_count,
    round(count(DISTINCT fraud_group_id) FILTER (is_injected = 1 AND hit)
        / greatest(count(DISTINCT fraud_group_id) FILTER (is_injected = 1), 1), 6)
        AS injected_group_recall,
    count(*) FILTER (hit) AS flagged_rows,
    count(*) FILTER (hit AND is_injected = 1) AS flagged_injected_rows,
    round(count(*) FILTER (hit AND is_injected = 1) / greatest(count(*) FILTER (hit), 1), 6)
        AS flagged_row_precision_vs_injection,
    round(coalesce(max(purity), 0), 6) AS average_detected_group_purity
FROM fl LEFT JOIN pur USING (threshold) GROUP BY threshold"""
_SHARES = ("injected_row_recall", "injected_group_recall", "flagged_row_precision_vs_injection",
           "average_detected_group_purity")


def _evaluated(spark, sf) -> DataFrame:
    return tx(spark, sf).where(F.col("split").isin("train", "valid", "test"))


@query("ring_evaluate", WITH_RINGS + _FLAGGED_CTE.format(steps="[-1.0]", first=""))
def _evaluate(spark, sf):
    entities = R.entity_ring_risk(mined(spark, sf))
    return rounded(R.ring_evaluate(_evaluated(spark, sf), entities), *_SHARES)


@query("ring_threshold_sweep", WITH_RINGS + _FLAGGED_CTE.format(
    steps="[0.35, 0.55, 0.65, 0.75]", first="CAST(threshold AS DOUBLE) AS threshold,"))
def _sweep(spark, sf):
    entities = R.entity_ring_risk(mined(spark, sf))
    return rounded(R.ring_threshold_sweep(_evaluated(spark, sf), entities), *_SHARES)


@query("ring_summary", WITH_RINGS + """
SELECT (SELECT count(*) FROM cand) AS candidate_resource_count,
    (SELECT count(*) FROM rings) AS detected_group_count,
    (SELECT count(*) FROM members JOIN rings USING (component)) AS detected_entity_count,
    0.65::DOUBLE AS recommended_high_confidence_threshold, 4 AS steps,
    (SELECT count(*) FROM tx WHERE split <> 'unlabeled' AND is_injected = 1) AS injected_rows""")
def _summary(spark, sf):
    return R.ring_summary(_evaluated(spark, sf), mined(spark, sf)).select(
        "candidate_resource_count", "detected_group_count", "detected_entity_count",
        "recommended_high_confidence_threshold", F.size("threshold_breakdown").alias("steps"),
        "injected_rows")


@query("ring_lookup", WITH_RINGS + """
SELECT ring_id, component, user_count FROM rings WHERE ring_id = 'GM_000001'""")
def _ring_lookup(spark, sf):
    found = R.ring_lookup(R.ring_detail(mined(spark, sf)), "GM_000001")
    return found.select(F.col("fraud_group_mining_id").alias("ring_id"), "component", "user_count")


@query("entity_lookup", WITH_RINGS + """
SELECT m.entity_id, ring_id FROM members AS m JOIN rings USING (component)
WHERE m.entity_id = (SELECT min(entity_id) FROM members)""")
def _entity_lookup(spark, sf):
    tables = mined(spark, sf)
    entities = R.entity_ring_risk(tables)
    first = tables.members.agg(F.min("entity_id").alias("e")).first().e
    return R.entity_lookup(entities, first).select(
        "entity_id", F.col("fraud_group_mining_id").alias("ring_id"))


# ---------------------------------------------------------------- features on transactions
_MERGED = """, ring_of AS (SELECT m.entity_id, ring_id, score, user_count FROM members AS m
    JOIN rings USING (component)),
feat AS (SELECT entity_id, ring_id, coalesce(graph_degree, 0) AS graph_degree,
    coalesce(graph_fraud_edge_count, 0) AS fe, coalesce(ratio, 0) AS ratio, coalesce(score, 0) AS score,
    coalesce(user_count, 0) AS user_count FROM degree FULL JOIN ring_of USING (entity_id))"""
_WITH_FEAT = (_DEGREE.replace("WITH tx", "WITH RECURSIVE tx", 1) + TOUCH_CTE + RING_CTE + _MERGED)


def _entity_features(spark, sf) -> DataFrame:
    return J.outer_feature_merge(A.entity_degree(G.tx_edges(d(spark, sf))),
                                 R.entity_ring_risk(mined(spark, sf)))


@query("outer_feature_merge", _WITH_FEAT + """
SELECT entity_id, ring_id AS fraud_group_mining_id, CAST(graph_degree AS DOUBLE) AS graph_degree,
    CAST(fe AS DOUBLE) AS graph_fraud_edge_count, round(ratio, 5) AS graph_fraud_edge_ratio,
    round(score, 6) AS graph_mining_group_risk_score FROM feat""")
def _merged(spark, sf):
    out = _entity_features(spark, sf).select(
        "entity_id", "fraud_group_mining_id", "graph_degree", "graph_fraud_edge_count",
        "graph_fraud_edge_ratio", "graph_mining_group_risk_score")
    return rounded(rounded(out, "graph_fraud_edge_ratio", digits=5), "graph_mining_group_risk_score")


@query("attach_graph_features", _WITH_FEAT + """
SELECT t.transaction_id, CAST(p.graph_degree AS DOUBLE) AS payer_graph_degree,
    p.ring_id AS payer_fraud_group_mining_id,
    round(coalesce(p.score, 0), 6) AS payer_graph_mining_group_risk_score,
    CAST(coalesce(q.graph_degree, 0) AS DOUBLE) AS payee_graph_degree,
    CAST(coalesce(m.graph_degree, 0) AS DOUBLE) AS merchant_graph_degree,
    round(coalesce(v.score, 0), 6) AS device_graph_mining_group_risk_score,
    CAST(coalesce(i.graph_degree, 0) AS DOUBLE) AS ip_graph_degree
FROM d AS t LEFT JOIN feat AS p ON t.payer_id = p.entity_id
LEFT JOIN feat AS q ON t.payee_id = q.entity_id LEFT JOIN feat AS m ON t.merchant_id = m.entity_id
LEFT JOIN feat AS v ON t.device_id = v.entity_id LEFT JOIN feat AS i ON t.ip_id = i.entity_id""")
def _attach(spark, sf):
    wide = J.attach_graph_features(d(spark, sf), _entity_features(spark, sf), with_rings=True)
    return rounded(wide.select(
        "transaction_id", "payer_graph_degree", "payer_fraud_group_mining_id",
        "payer_graph_mining_group_risk_score", "payee_graph_degree", "merchant_graph_degree",
        "device_graph_mining_group_risk_score", "ip_graph_degree"),
        "payer_graph_mining_group_risk_score", "device_graph_mining_group_risk_score")
