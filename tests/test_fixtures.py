"""Small hand-written cases: pinned results and edges of the rules."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.operators import aggregates as A
from ledgerlens.operators import derive as D
from ledgerlens.operators import evaluate as E
from ledgerlens.operators import feedback as B
from ledgerlens.operators import graph as G
from ledgerlens.operators import merge as M
from ledgerlens.operators import ordering as O
from ledgerlens.operators import profiles as P
from ledgerlens.operators import rings as R
from ledgerlens.operators import sampling as X
from ledgerlens.operators import windows as W
from ledgerlens.operators.components import connected_components
from ledgerlens.sources import tables as T

T0 = dt.datetime(2026, 1, 1)


def payments(spark, rows):
    """Rows of (id, minutes, payer, payee, merchant, device, ip, amount, label)."""
    return spark.createDataFrame(
        [(i, T0 + dt.timedelta(minutes=m), p, q, me, d, ip, float(a), lab)
         for i, m, p, q, me, d, ip, a, lab in rows],
        "transaction_id string, timestamp timestamp_ntz, payer_id string, payee_id string, "
        "merchant_id string, device_id string, ip_id string, amount double, is_fraud int")


def test_windows_of_two_events(spark):
    tx = payments(spark, [("a", 0, "u1", "p1", "m1", "d1", "ip1", 10, 0),
                          ("b", 4, "u1", "p2", "m1", "d1", "ip1", 15, 0)])
    row = W.window_features(tx).where("transaction_id = 'b'").first()
    assert row.window_features_user_txn_count_5min == 2
    assert row.window_features_user_amount_sum_5min == 25.0
    assert row.window_features_user_unique_payee_count_1h == 2


def test_windows_without_time_are_zero(spark):
    row = W.window_features(spark.createDataFrame([("a",)], "transaction_id string")).first()
    assert all(row[c] == 0.0 for c in W.FEATURE_COLUMNS)


def test_ties_see_only_earlier_rows_and_peers_see_all(spark):
    tx = payments(spark, [("a", 0, "u", "x", None, "d", "i", 1, 0), ("b", 0, "u", "x", None, "d", "i", 2, 0),
                          ("c", 60, "u", "y", None, "d", "i", 4, 0)])
    exact = {r.transaction_id: r for r in W.sliding_features(tx, "payer_id", W.USER_1H, prefix="").collect()}
    assert [exact[k].user_txn_count_1h for k in "abc"] == [1, 2, 3]
    assert [exact[k].user_unique_payee_count_1h for k in "abc"] == [1, 1, 2]
    peers = {r.transaction_id: r.user_txn_count_1h
             for r in W.sliding_features(tx, "payer_id", W.USER_1H, ties="peers", prefix="").collect()}
    assert peers == {"a": 2, "b": 2, "c": 3}


def test_missing_ids_form_one_window(spark):
    tx = payments(spark, [("a", 0, "u", "x", None, "d", "i", 1, 0), ("b", 1, "v", "x", None, "d", "i", 1, 0)])
    rows = W.sliding_features(tx, "merchant_id", W.MERCHANT_1H, prefix="").collect()
    assert {r.transaction_id: r.merchant_unique_user_count_1h for r in rows} == {"a": 1, "b": 2}


def test_window_longer_than_one_hour(spark):
    feature = [W.Feature("n", "count", 86400), W.Feature("who", "distinct", 86400, "payee_id")]
    tx = payments(spark, [(str(i), 400 * i, "u", f"p{i % 2}", None, "d", "i", 1, 0) for i in range(8)])
    rows = {int(r.transaction_id): r for r in W.sliding_features(tx, "payer_id", feature, prefix="").collect()}
    assert [rows[i].n for i in range(8)] == [1, 2, 3, 4, 4, 4, 4, 4]
    assert [rows[i].who for i in range(8)] == [1, 2, 2, 2, 2, 2, 2, 2]


def test_bucket_edges(spark):
    df = spark.createDataFrame([(10.0,), (100.0,), (1000.0,), (10000.0,)], "amount double")
    rows = df.orderBy("amount").select(D.amount_bucket().alias("r"), D.amount_bucket_left().alias("l")).collect()
    assert [r.r for r in rows] == ["micro", "small", "medium", "large"]
    assert [r.l for r in rows] == ["small", "medium", "large", "xlarge"]


def test_flatten_names(spark):
    event = spark.createDataFrame([Row(
        user_profile=Row(txn_count=7), device_profile=Row(txn_count=3), ip_profile=Row(bind_user_count=2),
        merchant_profile=Row(txn_count=9, merchant_category="retail"),
        window_features=Row(user_txn_count_5min=2), graph_features=Row(payer_graph_degree=4))])
    row = D.flatten_event(event).first().asDict()
    assert row == {"txn_count": 7, "txn_count_device": 3, "bind_user_count_ip": 2,
                   "txn_count_merchant": 9, "merchant_category_merchant": "retail",
                   "window_features_user_txn_count_5min": 2, "payer_graph_degree": 4}


def test_contract_adds_and_fills(spark):
    contract = D.FeatureContract(("amount", "channel", "txn_count"), ("channel",),
                                 {"amount": 0.0, "txn_count": 5.0})
    again = D.FeatureContract.from_dict(contract.to_dict())
    out = D.apply_feature_contract(spark.createDataFrame([("1.25",)], "amount string"), again)
    assert out.columns == ["amount", "channel", "txn_count"]
    assert tuple(out.first()) == (1.25, "__missing__", 5.0)


def ring_row(spark):
    evidence = [("D_1", "device", "shared_device", 3, 5, 2, 0.9), ("IP_1", "ip", "shared_ip", 3, 5, 2, 0.8)]
    df = spark.createDataFrame(
        [("GM_1", 0.82, 4, 2, 1, 0, 1, 4, 2, 2, 4, {"mule_account": 3}, evidence, ["u1", "u2"], ["D_1", "IP_1"])],
        "fraud_group_mining_id string, graph_mining_group_risk_score double, fraud_seed_count int, "
        "shared_device_count int, shared_ip_count int, shared_merchant_count int, shared_payee_count int, "
        "user_count int, resource_count int, scenario_count int, txn_count int, "
        "top_scenarios map<string,bigint>, evidence array<struct<entity_id:string,entity_type:string,"
        "evidence_kind:string,shared_user_count:bigint,txn_count:bigint,fraud_seed_count:bigint,"
        "resource_risk_score:double>>, sample_users array<string>, sample_resources array<string>")
    return df.withColumns({"device_evidence": F.lit(1), "ip_evidence": F.lit(1)}).withColumns(
        {"merchant_evidence": F.lit(0), "payee_evidence": F.lit(0)})


def test_ring_explanation(spark):
    row = R.ring_explain(ring_row(spark)).first()
    assert row.risk_level == "high"
    assert {"high_confidence_ring", "shared_device_ring", "fund_transfer_chain"} <= set(row.explanation_codes)
    assert row.evidence_by_kind["shared_device"] == 1
    assert [e.entity_id for e in row.top_resources] == ["D_1", "IP_1"]
    assert "0.820" in row.explanation_text


def test_weak_ring_has_a_fallback_code(spark):
    weak = ring_row(spark).withColumns({
        "graph_mining_group_risk_score": F.lit(0.1), "fraud_seed_count": F.lit(0),
        "shared_device_count": F.lit(0), "shared_payee_count": F.lit(0), "scenario_count": F.lit(0),
        "top_scenarios": F.lit(None).cast("map<string,bigint>"),
        "evidence": F.slice("evidence", 1, 1)})
    assert R.ring_explain(weak).first().explanation_codes == ["weak_graph_signal"]


def test_ring_subgraph(spark):
    row = R.ring_subgraph(ring_row(spark)).first()
    assert [n.id for n in row.nodes] == ["GM_1", "GM_1:risk", "u1", "u2", "D_1", "IP_1"]
    assert [e.label for e in row.edges] == ["risk_score", "member", "member", "shared_device", "shared_ip"]


def graph_edges(spark):
    return spark.createDataFrame(
        [(f"u{i}", f"t{i}", "user", "transaction", "make_transaction", int(i == 1)) for i in (1, 2, 3)],
        "src_id string, dst_id string, src_type string, dst_type string, edge_type string, label int"
    ).withColumn("timestamp", F.lit(T0))


def test_node_labels(spark):
    nodes = {r.node_id: r for r in G.node_features(graph_edges(spark)).collect()}
    assert len(nodes) == 6 and nodes["u1"].node_label == 1 and nodes["u2"].node_label == 0
    assert nodes["t3"].type_transaction == 1.0 and sum(n.degree for n in nodes.values()) == 6


def test_graph_sample_limits(spark):
    kept = X.sample_graph_balanced(graph_edges(spark), 2, 4, 1)
    assert 0 < kept.count() <= 2
    assert kept.select(F.explode(F.array("src_id", "dst_id"))).distinct().count() <= 4


def test_degree_counts_a_self_loop_twice(spark):
    edges = spark.createDataFrame([("a", "a", 1), ("a", "b", -1)], "src_id string, dst_id string, label int")
    rows = {r.entity_id: r for r in A.entity_degree(edges).collect()}
    assert (rows["a"].graph_degree, rows["a"].graph_fraud_edge_count) == (3, 2)
    assert rows["b"].graph_fraud_edge_count == 0


def test_unlabelled_edges_count_as_normal(spark):
    tx = payments(spark, [("a", 0, "u", "p", None, None, "i", 5, -1)])
    edges = G.tx_edges(tx).collect()
    assert {e.edge_type for e in edges} == {"make_transaction", "transfer_to", "login_ip"}
    assert all(e.label == 0 for e in edges)


SCORED = "is_fraud int, risk_score double, transaction_id string"


def scored(spark, pairs):
    return spark.createDataFrame([(a, float(s), str(i)) for i, (a, s) in enumerate(pairs)], SCORED)


def test_sandbox_and_its_argument_check(spark):
    df = scored(spark, [(0, .1), (0, .6), (1, .7), (1, .9)])
    row = E.threshold_sandbox(df, 0.5, 0.8).first()
    assert (row.pass_rows, row.review_rows, row.reject_rows) == (1, 2, 1)
    assert (row.true_positive, row.false_positive, row.recall) == (1, 0, 0.5)
    with pytest.raises(ValueError):
        E.threshold_sandbox(df, 0.8, 0.5)


def test_one_class_and_equal_scores(spark):
    one = scored(spark, [(0, .1), (0, .6)])
    assert E.roc_auc(one).first().roc_auc == 0.0
    assert E.average_precision(one).first().average_precision == 0.0
    assert E.recall_at_top_k(one).first().recall_at_top_k == 0.0
    flat = scored(spark, [(1, .5), (0, .5), (0, .5), (1, .5)])
    assert E.roc_auc(flat).first().roc_auc == 0.5
    assert E.average_precision(flat).first().average_precision == 0.5
    assert E.recall_at_top_k(flat, 0.5).first().recall_at_top_k == 0.5


def test_calibration_takes_the_lowest_threshold_on_ties(spark):
    df = scored(spark, [(0, .1), (1, .9)])
    named = {r.name: r.threshold for r in E.calibrate_thresholds(df).collect()}
    assert named["best_f1"] == pytest.approx(0.11) and named["default_high"] == 0.8


def test_kv_projection(spark):
    df = spark.createDataFrame([("u1", T0, 1.5), (None, T0, 2.0), ("u2", T0, None)],
                               "user_id string, seen timestamp_ntz, amount double")
    rows = {r.key: r.value for r in T.profile_kv(df, "user_id", "profile:user").collect()}
    assert sorted(rows) == ["profile:user:u1", "profile:user:u2"]
    assert '"seen":"2026-01-01T00:00:00"' in rows["profile:user:u1"]
    assert '"amount":null' in rows["profile:user:u2"]
    with pytest.raises(ValueError):
        T.profile_kv(df, "nothing", "x")


def test_feedback_twice_unknown_and_bad_label(spark):
    tx = spark.createDataFrame([("a", 0, 1.0, "test"), ("b", 1, 2.0, "valid")],
                               "transaction_id string, is_fraud int, amount double, split string")
    reviews = spark.createDataFrame([("a", 1, 1), ("a", 0, 2), ("b", 0, 1), ("new", 1, 1), ("b", 5, 9)],
                                    "transaction_id string, reviewed_is_fraud int, seq int")
    out = {r.transaction_id: r for r in B.feedback_apply(tx, reviews, ["seq"]).collect()}
    assert (out["a"].is_fraud, out["b"].is_fraud, out["new"].is_fraud) == (0, 0, 1)
    assert out["new"].split == "train" and out["new"].amount is None and out["a"].split == "test"


def test_mode_ties_take_the_smallest(spark):
    rows = [(f"t{i}", T0, 1.0, 0, "u", "p", None, "d", "i", s, c, "x")
            for i, (s, c) in enumerate([("b", "UK"), ("a", "US"), ("b", "US"), ("a", "UK")])]
    tx = spark.createDataFrame(rows, "transaction_id string, timestamp timestamp_ntz, amount double, "
                               "is_fraud int, payer_id string, payee_id string, merchant_id string, "
                               "device_id string, ip_id string, source string, payer_country string, "
                               "payee_country string").withColumn("merchant_category", F.lit("c"))
    row = P.user_profile(tx).where("user_id = 'u'").first()
    assert (row.source_hint, row.home_country, row.txn_count) == ("a", "UK", 4)
    assert P.merchant_profile(tx).count() == 0


def test_components_match_a_simple_search(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(200, 260)] + [(300, 300), (260, 61)]
    df = spark.createDataFrame([(f"n{a:04d}", f"n{b:04d}") for a, b in pairs], "src string, dst string")
    got = {r.node: r.component for r in connected_components(df).collect()}
    label = {}
    for a, b in pairs:
        label.setdefault(a, {a}), label.setdefault(b, {b})
        if label[a] is not label[b]:
            joined = label[a] | label[b]
            for n in joined:
                label[n] = joined
    assert got == {f"n{n:04d}": f"n{min(group):04d}" for n, group in label.items()}


def test_component_with_one_payer_is_no_ring(spark):
    labels = spark.createDataFrame([("u1", "c"), ("d1", "c"), ("u2", "e"), ("u3", "e")], "node string, component string")
    payers = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "payer_id string")
    assert {r.component for r in R.ring_members(labels, payers).collect()} == {"e"}


def test_an_id_of_two_kinds_keeps_the_later_kind_at_the_first_place(spark):
    df = spark.createDataFrame([(2, "merchant", "x", 5), (3, "payee", "x", 7), (0, "device", "D_1", 1)],
                               "kind_order int, entity_type string, entity_id string, txn_count int")
    rows = {r.entity_id: r for r in R.unique_evidence(df).collect()}
    assert (rows["x"].entity_type, rows["x"].txn_count, rows["x"].place_kind) == ("payee", 7, 2)


def test_low_risk_ring_without_evidence_is_dropped(spark):
    rings = spark.createDataFrame([("a", 0.2, 0), ("b", 0.2, 1), ("c", 0.5, 0)],
                                  "component string, graph_mining_group_risk_score double, evidence_count int")
    members = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("c", "u3"), ("b", "D_9")],
                                    "component string, entity_id string")
    evidence = spark.createDataFrame([("D_9", 0)], "entity_id string, place_kind int")
    chains = spark.createDataFrame([("u3", "u1", (T0, "t1"))], "payer_id string, payee_id string, "
                                   "first_row struct<timestamp:timestamp_ntz,transaction_id:string>")
    out = R.number_rings(rings, members, evidence, chains).select("component", "fraud_group_mining_id").collect()
    assert {r.component: r.fraud_group_mining_id for r in out} == {"b": "GM_000001", "c": "GM_000002"}


def test_rescale_of_flat_missing_and_moving_sources(spark):
    hour = dt.timedelta(hours=1)
    df = spark.createDataFrame(
        [("a1", "a", T0), ("a2", "a", T0), ("a3", "a", T0), ("b1", "b", None), ("c1", "c", T0),
         ("c2", "c", T0 + hour), ("c3", "c", None)], "transaction_id string, source string, timestamp timestamp_ntz")
    got = {r.transaction_id: r.timestamp for r in D.rescale_time(df).collect()}
    end = dt.datetime(2026, 3, 31, 23, 59, 59)
    assert got["a1"] == got["b1"] == got["c1"] == got["c3"] == T0
    assert got["a3"] == got["c2"] == end and T0 < got["a2"] < end


def test_widened_union_and_priority(spark):
    base = spark.createDataFrame([("a", 1.0)], "transaction_id string, amount double")
    extra = spark.createDataFrame([("b", 2.0, 1, "g")], "transaction_id string, amount double, is_injected int, fraud_group_id string")
    rows = {r.transaction_id: r for r in M.union_widen(base, extra).collect()}
    assert rows["a"].is_injected == 0 and rows["a"].fraud_group_id is None and rows["b"].fraud_group_id == "g"
    assert set(S.AUGMENTED_COLUMNS) <= set(M.union_widen(base, extra).columns)


def test_empty_inputs(spark):
    none = payments(spark, []).withColumn("source", F.lit("s"))
    assert O.running_position(none, ["timestamp"]).count() == 0
    assert W.window_features(none).count() == 0
    assert G.tx_edges(none).count() == 0
    assert connected_components(none.select(F.col("payer_id").alias("src"), F.col("payee_id").alias("dst"))).count() == 0
    assert O.exact_quantiles(none, "amount", {"q": 0.5}, ["source"]).count() == 0


def test_page_arguments(spark):
    df = spark.createDataFrame([("u",)], "user_id string")
    for bad in ({"limit": 0}, {"limit": 201}, {"offset": -1}):
        with pytest.raises(ValueError):
            X.page_users(df, sort="user_id", **bad)


def test_model_catalog_and_feature_index(spark, tmp_path):
    for name, auc in (("a", 0.5), ("b", 0.6)):
        folder = tmp_path / name / "latest"
        folder.mkdir(parents=True)
        (folder / "metrics.json").write_text('{"model_name": "%s", "pr_auc": %s}' % (name, auc))
    rows = E.model_catalog(spark, f"{tmp_path}/*/latest/metrics.json", active="b").collect()
    assert [(r.name, r.loaded) for r in rows] == [("b", True), ("a", False)]


def test_splits_are_written_by_split(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "transaction_id string, split string")
    T.sink_splits(df, str(tmp_path / "s"))
    assert (tmp_path / "s" / "split=train").exists()
    back = T.scan_splits(spark.read.parquet(str(tmp_path / "s")), ["train"])
    assert back.count() == 1 and back.first().amount == 0.0
