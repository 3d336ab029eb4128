"""Queries of sources and sinks (survey section 2.1).

The CSV and JSON inputs are written by Spark from the driver tables, whole, and read back with
the source's reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.operators.derive import calendar_fields, payment_method, risk_fields
from ledgerlens.operators.ordering import running_position
from ledgerlens.operators.profiles import device_profile
from ledgerlens.plans.queries_derive import WITH_RULE, _FRAUD_TYPE, _LEVEL
from ledgerlens.plans.queries_profiles import DEVICE_CTE
from ledgerlens.plans.registry import WITH_D, WITH_TX, d, query, rounded, tx
from ledgerlens.session import scratch_path
from ledgerlens.sources import csv_sources as C
from ledgerlens.sources import tables as T

_NO = "row_number() OVER (ORDER BY event_id) - 1"
_BASE = f"TIMESTAMP '{S.WINDOW_START}'"


def _csv(df: DataFrame, columns: dict[str, Column], header: bool = True) -> str:
    """The rows as CSV in event order; returns the folder."""
    path = scratch_path(df.sparkSession, "csv")
    rows = df.orderBy("event_id").select(*[v.alias(k) for k, v in columns.items()])
    rows.write.option("header", header).csv(path)
    return path


def _text(prefix: str, column: str, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"), F.lit(suffix))


def _paysim(spark, sf) -> DataFrame:
    dest = F.when(F.col("k") % 3 == 0, _text("M", "k")).otherwise(_text("C", "k"))
    path = _csv(tx(spark, sf), {
        "step": F.col("k"), "type": F.upper(F.coalesce("txn_type", F.lit("Debit"))),
        "amount": F.col("amount"), "nameOrig": _text("C", "u"), "oldbalanceOrg": F.col("amount") * 2,
        "newbalanceOrig": F.col("amount"), "nameDest": dest, "oldbalanceDest": F.lit(0.0),
        "newbalanceDest": F.col("amount") / 4, "isFraud": F.col("k") % 2,
        "isFlaggedFraud": (F.col("k") % 7 == 0).cast("int")})
    return C.paysim_raw(spark, path)


@query("src_paysim", WITH_TX + f"""
SELECT 'paysim:' || CAST({_NO} AS VARCHAR) AS transaction_id, 'paysim' AS source,
    {_BASE} + to_hours(k) AS timestamp, amount, 'USD' AS currency,
    lower(coalesce(txn_type, 'Debit')) AS txn_type, 'paysim_u:C' || u AS payer_id,
    'paysim_u:' || CASE WHEN k % 3 = 0 THEN 'M' ELSE 'C' END || k AS payee_id,
    CASE WHEN k % 3 = 0 THEN 'paysim_m:M' || k END AS merchant_id, NULL AS merchant_category,
    'SG' AS payer_country, 'SG' AS payee_country, CAST(k % 2 AS TINYINT) AS is_fraud,
    CASE WHEN k % 7 = 0 THEN 'rule_flagged' END AS fraud_subtype FROM tx""")
def _src_paysim(spark, sf):
    return C.src_paysim(_paysim(spark, sf))


@query("src_paysim_balances", WITH_TX + f"""
SELECT 'paysim:' || CAST({_NO} AS VARCHAR) AS transaction_id, round(amount * 2, 2) AS payer_old_balance,
    round(amount, 2) AS payer_new_balance, 0.0 AS payee_old_balance FROM tx""")
def _balances(spark, sf):
    out = C.src_paysim_balances(_paysim(spark, sf)).drop("payee_new_balance")
    return rounded(out, "payer_old_balance", "payer_new_balance", digits=2)


def _banksim(spark, sf) -> DataFrame:
    path = _csv(tx(spark, sf), {
        "step": F.col("k"), "customer": _text("'C", "u", "'"), "age": _text("'", "k", "'"),
        "gender": F.lit("'F'"), "zipcodeOri": F.lit("'28007'"),
        "merchant": F.concat(F.lit("'M"), (F.col("u") % 9).cast("string"), F.lit("'")),
        "zipMerchant": F.lit("'28007'"), "category": F.lit("'es_travel'"), "amount": F.col("amount"),
        "fraud": F.col("k") % 2})
    return C.banksim_raw(spark, path)


@query("src_banksim", WITH_TX + f"""
SELECT 'banksim:' || CAST({_NO} AS VARCHAR) AS transaction_id, 'banksim' AS source,
    {_BASE} + to_days(CAST(k AS INT)) AS timestamp, amount, 'USD' AS currency,
    'card_payment' AS txn_type, 'banksim_u:C' || u AS payer_id, 'banksim_m:M' || (u % 9) AS payee_id,
    'banksim_m:M' || (u % 9) AS merchant_id, 'es_travel' AS merchant_category, 'ES' AS payer_country,
    'ES' AS payee_country, CAST(k % 2 AS TINYINT) AS is_fraud, NULL AS fraud_subtype FROM tx""")
def _src_banksim(spark, sf):
    return C.src_banksim(_banksim(spark, sf))


@query("src_banksim_features", WITH_TX + f"""
SELECT 'banksim:' || CAST({_NO} AS VARCHAR) AS transaction_id, CAST(k AS VARCHAR) AS user_age_bucket,
    'F' AS user_gender, '28007' AS user_zipcode, '28007' AS merchant_zipcode FROM tx""")
def _src_banksim_features(spark, sf):
    return C.src_banksim_features(_banksim(spark, sf))


def _cards(spark, sf) -> DataFrame:
    path = _csv(tx(spark, sf), {
        "Time": F.col("event_id") * 1.5, **{f"V{i}": F.col("amount") / i for i in range(1, 29)},
        "Amount": F.col("amount"), "Class": F.col("k") % 2})
    return C.creditcard_raw(spark, path)


@query("src_creditcard", WITH_TX + f"""
SELECT 'cc:' || CAST({_NO} AS VARCHAR) AS transaction_id, 'creditcard' AS source,
    {_BASE} + to_milliseconds(event_id * 1500) AS timestamp, amount, 'EUR' AS currency,
    'card_payment' AS txn_type, 'cc_u:' || CAST({_NO} AS VARCHAR) AS payer_id,
    'cc_unknown' AS payee_id, NULL AS merchant_id, NULL AS merchant_category, 'EU' AS payer_country,
    'EU' AS payee_country, CAST(k % 2 AS TINYINT) AS is_fraud, NULL AS fraud_subtype FROM tx""")
def _src_cards(spark, sf):
    return C.src_creditcard(_cards(spark, sf))


@query("src_creditcard_pca", WITH_TX + f"""
SELECT 'cc:' || CAST({_NO} AS VARCHAR) AS transaction_id, round(amount, 2) AS "V1",
    round(amount / 10, 3) AS "V10" FROM tx""")
def _src_pca(spark, sf):
    out = C.src_creditcard_pca(_cards(spark, sf)).select("transaction_id", "V1", "V10")
    return rounded(rounded(out, "V1", digits=2), "V10", digits=3)


_SAML_KIND = ("Cash Deposit", "Cross-border", "Mobile Top-Up", "Wire Cheque Draft", "Local Transfer")


@query("src_saml_d", WITH_TX + f"""
SELECT 'saml:' || CAST({_NO} AS VARCHAR) AS transaction_id, 'saml_d' AS source,
    CASE WHEN k % 10 = 0 THEN NULL ELSE date_trunc('second', timestamp) END AS timestamp, amount,
    'UK pounds' AS currency, list_extract(['cash_in', 'cross_border_transfer', 'topup',
        'wire_cheque_draft', 'transfer'], CAST(k % 5 + 1 AS BIGINT)) AS txn_type,
    'saml_a:' || u AS payer_id, 'saml_a:' || k AS payee_id, NULL AS merchant_id,
    NULL AS merchant_category, 'UK' AS payer_country, 'UAE' AS payee_country,
    CAST(k % 2 AS TINYINT) AS is_fraud, CASE WHEN k % 2 = 1 THEN 'Fan Out' END AS fraud_subtype FROM tx""")
def _src_saml(spark, sf):
    kinds = F.array(*map(F.lit, _SAML_KIND))
    day = F.when(F.col("k") % 10 == 0, "no date").otherwise(F.date_format("timestamp", "yyyy-MM-dd"))
    path = _csv(tx(spark, sf), {
        "Time": F.date_format("timestamp", "HH:mm:ss"), "Date": day, "Sender_account": F.col("u"),
        "Receiver_account": F.col("k"), "Amount": F.col("amount"),
        "Payment_currency": F.lit("UK pounds"), "Received_currency": F.lit("Dirham"),
        "Sender_bank_location": F.lit("UK"), "Receiver_bank_location": F.lit("UAE"),
        "Payment_type": F.element_at(kinds, (F.col("k") % 5 + 1).cast("int")),
        "Is_laundering": F.col("k") % 2, "Laundering_type": F.lit("Fan Out")})
    return C.src_saml_d(C.saml_raw(spark, path))


def _ieee(spark, sf, part: int, labelled: bool) -> DataFrame:
    rows = tx(spark, sf).where(F.col("k") % 2 == part)
    number = lambda c, missing: F.when(missing, None).otherwise(
        F.col(c).cast("double").cast("string"))
    columns = {
        "TransactionID": F.col("event_id"), "TransactionDT": F.col("k") * 100,
        "TransactionAmt": F.col("amount"), "ProductCD": F.lit("W"),
        "card1": F.col("u"), "addr1": number("k", F.col("k") % 5 == 0),
        "addr2": number("u", F.col("k") % 7 == 0), "V5": F.col("amount")}
    if labelled:
        columns["isFraud"] = (F.col("k") % 3 == 0).cast("int")
    return C.ieee_raw(spark, _csv(rows, columns))


@query("src_ieee_cis", WITH_TX + f"""
SELECT 'ieee:' || event_id AS transaction_id, 'ieee_cis' AS source,
    {_BASE} + to_seconds(k * 100) AS timestamp, amount, 'USD' AS currency, 'W' AS txn_type,
    'ieee_card:' || u AS payer_id,
    CASE WHEN k % 5 = 0 THEN 'ieee_unknown' ELSE 'ieee_addr:' || k END AS payee_id,
    NULL AS merchant_id, 'W' AS merchant_category,
    CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(u AS VARCHAR) END AS payer_country, NULL AS payee_country,
    CAST(CASE WHEN k % 2 = 1 THEN -1 WHEN k % 3 = 0 THEN 1 ELSE 0 END AS TINYINT) AS is_fraud,
    NULL AS fraud_subtype FROM tx""")
def _src_ieee(spark, sf):
    return C.src_ieee_cis(_ieee(spark, sf, 0, True), _ieee(spark, sf, 1, False))


@query("src_ieee_features", WITH_TX + """
SELECT 'ieee:' || event_id AS transaction_id, 'W' AS "ProductCD", round(amount, 2) AS "V5",
    CASE WHEN k % 4 = 0 THEN 'mobile' END AS "DeviceType" FROM tx""")
def _src_ieee_features(spark, sf):
    device = tx(spark, sf).where(F.col("k") % 4 == 0)
    identity = C.ieee_raw(spark, _csv(device, {"TransactionID": F.col("event_id"),
                                               "DeviceType": F.lit("mobile")}))
    out = C.src_ieee_features([(_ieee(spark, sf, 0, True), identity),
                               (_ieee(spark, sf, 1, False), identity)])
    return rounded(out.select("transaction_id", "ProductCD", "V5", "DeviceType"), "V5", digits=2)


@query("src_aml_accounts", WITH_TX + f"""
SELECT 'amlsim_tx:' || event_id AS transaction_id, {_BASE} + to_days(CAST(k AS INT)) AS timestamp,
    amount, 'amlsim_a:' || u AS payer_id, 'amlsim_a:' || k AS payee_id, NULL AS merchant_id,
    'aml_transfer' AS merchant_category, CAST(u % 10 = 3 OR k % 10 = 3 AS TINYINT) AS is_fraud,
    CASE WHEN u % 10 = 3 OR k % 10 = 3 THEN 'cycle' END AS fraud_subtype FROM tx
UNION ALL SELECT 'amlsim_cash:' || event_id, {_BASE} + to_days(CAST(k AS INT)), amount,
    'amlsim_a:' || u, 'amlsim_branch:' || k, 'amlsim_branch:' || k, 'cash_service',
    CAST(u % 10 = 3 AS TINYINT), CASE WHEN u % 10 = 3 THEN 'cycle' END FROM tx""")
def _src_aml(spark, sf):
    base = tx(spark, sf)
    common = {"TXN_ID": F.col("event_id"), "ACCOUNT_ID": F.col("u"),
              "TXN_SOURCE_TYPE_CODE": F.lit("TRANSFER"), "TXN_AMOUNT_ORIG": F.col("amount")}
    transfers = _csv(base, {**common, "COUNTER_PARTY_ACCOUNT_NUM": F.col("k"),
                            "start": F.col("k"), "end": F.col("k")})
    cash = _csv(base, {**common, "BRANCH_ID": F.col("k"), "RUN_DATE": F.col("k")})
    account = F.explode(F.array("u", "k"))
    alerts = _csv(base.select("event_id", account.alias("a")).where(F.col("a") % 10 == 3),
                  {"ACCOUNT_ID": F.col("a")})
    return C.src_aml_accounts(spark, transfers, cash, alerts).select(
        "transaction_id", "timestamp", "amount", "payer_id", "payee_id", "merchant_id",
        "merchant_category", "is_fraud", "fraud_subtype")


@query("src_card_network", WITH_TX + f"""
SELECT 'banksim_u:C' || u AS src_id, 'banksim_m:M' || k AS dst_id, amount AS weight,
    {_BASE} AS timestamp, CAST(k % 2 AS TINYINT) AS label FROM tx""")
def _src_network(spark, sf):
    path = _csv(tx(spark, sf), {
        "Source": _text("'C", "u", "'"), "Target": _text("'M", "k", "'"), "Weight": F.col("amount"),
        "typeTrans": F.lit("'es_travel'"), "fraud": F.col("k") % 2})
    return C.src_card_network(spark, path).select("src_id", "dst_id", "weight", "timestamp", "label")


@query("src_crypto_graph", WITH_TX + f"""
SELECT 'node' AS part, 'elliptic_tx:' || event_id AS a, CASE WHEN k % 3 = 2 THEN 'unknown' ELSE
    CAST(k % 3 + 1 AS VARCHAR) END AS b, CAST(CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END AS
    TINYINT) AS label, {_BASE} + to_days(CAST(k AS INT)) AS timestamp FROM tx
UNION ALL SELECT 'edge', 'elliptic_tx:' || event_id, 'elliptic_tx:' || (event_id + 1), CAST(-1 AS TINYINT),
    {_BASE} + to_days(CAST(k AS INT)) FROM tx""")
def _src_crypto(spark, sf):
    base = tx(spark, sf)
    kind = F.when(F.col("k") % 3 == 2, "unknown").otherwise((F.col("k") % 3 + 1).cast("string"))
    classes = _csv(base, {"txId": F.col("event_id"), "class": kind})
    features = _csv(base, {"txId": F.col("event_id"), "step": F.col("k"), "x": F.col("amount")}, False)
    edges = _csv(base, {"txId1": F.col("event_id"), "txId2": F.col("event_id") + 1})
    nodes, links = C.src_crypto_graph(spark, classes, edges, features)
    return nodes.select(F.lit("node").alias("part"), F.col("node_id").alias("a"),
                        F.col("raw_label").alias("b"), "label", "timestamp").unionByName(
        links.select(F.lit("edge").alias("part"), F.col("src_id").alias("a"),
                     F.col("dst_id").alias("b"), "label", "timestamp"))


@query("src_user_relation_graph", WITH_TX + f""", e AS (SELECT u AS src, k AS dst, event_id AS t FROM tx),
nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
span AS (SELECT min(t) AS lo, max(t) AS hi FROM e)
SELECT 'edge' AS part, 'dgraph_u:' || src AS a, 'dgraph_u:' || dst AS b,
    {_BASE} + to_seconds(CAST(round_even((t - lo) / (hi - lo) * {S.WINDOW_SECONDS}, 0) AS BIGINT))
    AS timestamp, CAST(-1 AS TINYINT) AS label FROM e, span
UNION ALL SELECT 'node', 'dgraph_u:' || node, CAST(node % 4 AS VARCHAR), NULL,
    CAST(CASE node % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS TINYINT) FROM nodes
UNION ALL SELECT 'feature', 'dgraph_u:' || node, CAST(node AS VARCHAR), NULL, NULL FROM nodes""")
def _src_relation(spark, sf):
    base = tx(spark, sf)
    edges = base.select(F.col("u").alias("src"), F.col("k").alias("dst"),
                        (F.col("k") % 11).alias("edge_type"), F.col("event_id").alias("edge_timestamp"))
    users = (base.select(F.explode(F.array("u", "k")).alias("node")).distinct()
             .withColumns({"y": F.col("node") % 4, "x": F.array("node")}))
    nodes, links, features = C.src_user_relation_graph(edges, users)
    none = F.lit(None).cast("timestamp_ntz").alias("timestamp")
    return (links.select(F.lit("edge").alias("part"), F.col("src_id").alias("a"),
                         F.col("dst_id").alias("b"), "timestamp", "label")
            .unionByName(nodes.select(F.lit("node").alias("part"), F.col("node_id").alias("a"),
                                      F.col("raw_label").alias("b"), "timestamp", "label"))
            .unionByName(features.select(
                F.lit("feature").alias("part"), F.col("node_id").alias("a"),
                F.col("features")[0].cast("string").alias("b"), none,
                F.lit(None).cast("tinyint").alias("label"))))


# ---------------------------------------------------------------- own tables
def stream_log(spark, sf) -> DataFrame:
    """The log columns a stream carries, with injected columns."""
    return risk_fields(calendar_fields(d(spark, sf))).withColumns({
        "channel": F.lit("web"), "payment_method": payment_method("txn_type"),
        "injection_evidence": F.lit(None).cast("string")})


_STREAM = WITH_RULE + f""", ord AS (SELECT *, {_FRAUD_TYPE} AS fraud_type, {_LEVEL} AS risk_level,
    row_number() OVER (ORDER BY timestamp, transaction_id) AS place,
    row_number() OVER (PARTITION BY is_injected ORDER BY timestamp, transaction_id) AS part_place,
    sum(is_injected) OVER () AS n_inj FROM rule)"""


@query("scan_jsonl_events", _STREAM + """
SELECT transaction_id, date_trunc('millisecond', timestamp) AS timestamp, amount, payer_id,
    merchant_id, is_fraud, risk_level FROM ord""")
def _jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    T.sink_event_stream(T.event_stream_rows(stream_log(spark, sf), None), path)
    return T.scan_jsonl_events(spark, path).select(
        "transaction_id", "timestamp", "amount", "payer_id", "merchant_id", "is_fraud", "risk_level")


@query("sink_event_stream", _STREAM + """
SELECT transaction_id, timestamp, fraud_type, rule_score FROM ord
WHERE place <= (SELECT count(*) * 3 // 10 FROM tx)""")
def _stream_rows(spark, sf):
    share = tx(spark, sf).count() * 3 // 10
    return T.event_stream_rows(stream_log(spark, sf), share).select(
        "transaction_id", "timestamp", "fraud_type", "rule_score")


@query("sink_event_stream_mixed", _STREAM + """
SELECT transaction_id, is_injected, scenario_step FROM ord WHERE CASE WHEN is_injected = 1
    THEN part_place <= (SELECT count(*) // 5 FROM tx)
    ELSE part_place <= greatest((SELECT count(*) // 5 FROM tx) - n_inj, 0) END""")
def _mixed(spark, sf):
    share = tx(spark, sf).count() // 5
    return T.event_stream_rows_mixed(stream_log(spark, sf), share).select(
        "transaction_id", "is_injected", "scenario_step")


@query("sink_parquet", WITH_TX + "SELECT transaction_id, amount, is_fraud FROM tx")
def _sink_parquet(spark, sf):
    path = scratch_path(spark, "sink")
    T.sink_parquet(tx(spark, sf).select("transaction_id", "amount", "is_fraud"), path)
    return spark.read.parquet(path)


@query("sink_splits", WITH_TX + """
SELECT transaction_id, split FROM tx WHERE split IN ('valid', 'unlabeled')""")
def _sink_splits(spark, sf):
    path = scratch_path(spark, "splits")
    T.sink_splits(tx(spark, sf).select("transaction_id", "split"), path)
    return spark.read.parquet(path).where(F.col("split").isin("valid", "unlabeled"))


@query("sink_profile_kv", WITH_D + DEVICE_CTE + """
SELECT 'profile:device:' || device_id AS key, device_type, CAST(txn_count AS VARCHAR) AS txn_count,
    strftime(first_seen_time, '%Y-%m-%dT%H:%M:%S.%f') AS first_seen_time FROM device_profile""")
def _kv(spark, sf):
    kv = T.profile_kv(device_profile(d(spark, sf)), "device_id", "profile:device")
    return kv.select("key", *[F.get_json_object("value", f"$.{c}").alias(c) for c in (
        "device_type", "txn_count", "first_seen_time")])


@query("tail_topic", WITH_TX + """, m AS (SELECT u % 3 AS partition, row_number() OVER (
    PARTITION BY u % 3 ORDER BY event_id) - 1 AS "offset", k, transaction_id,
    count(*) OVER (PARTITION BY u % 3) AS n FROM tx)
SELECT partition, "offset", transaction_id AS key, k % 5 <> 0 AS is_json FROM m
ORDER BY partition DESC, "offset" DESC LIMIT 20""")
def _tail(spark, sf):
    base = tx(spark, sf).select("transaction_id", "k", "event_id", (F.col("u") % 3).alias("partition"))
    placed = running_position(base, ["event_id"], ["partition"], out="offset")
    value = F.when(F.col("k") % 5 == 0, "plain text").otherwise(F.to_json(F.struct("k")))
    messages = placed.select("partition", "offset", F.col("transaction_id").alias("key"),
                             value.alias("value"))
    return T.tail_topic(messages, 20).select("partition", "offset", "key", "is_json")


@query("feature_store_lookup", WITH_TX + """
SELECT transaction_id, CASE WHEN k % 2 = 0 THEN amount * 2 END AS payer_old_balance FROM tx""")
def _feature_store(spark, sf):
    base = tx(spark, sf)
    path = scratch_path(spark, "features")
    T.sink_parquet(base.where(F.col("k") % 2 == 0).select(
        "transaction_id", (F.col("amount") * 2).alias("payer_old_balance")), path)
    index = spark.createDataFrame(
        [("balances", "nowhere", "transaction_id", "balances before and after")],
        "table string, path string, join_key string, description string")
    index = T.rewrite_index(index, "balances", path)
    return T.feature_store_lookup(base.select("transaction_id"), index, "balances")
