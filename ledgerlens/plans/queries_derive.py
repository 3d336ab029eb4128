"""Queries of the row-wise derivations (survey section 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions import hashing as H
from ledgerlens.operators import derive as D
from ledgerlens.operators import profiles
from ledgerlens.operators.windows import BY_KEY, sliding_features
from ledgerlens.plans.queries_profiles import USER_SQL
from ledgerlens.plans.registry import (
    HIGH_RISK, WITH_D, WITH_TX, d, query, rounded, sql_hash, sql_pct_rank, sql_pick, tx,
)
from ledgerlens.sources.tables import scan_splits


@query("stable_hash", WITH_TX + f"""
SELECT transaction_id, {sql_hash('payer_id', 'user')} AS salted, {sql_hash('payer_id')} AS plain
FROM tx""")
def _stable_hash(spark, sf):
    return tx(spark, sf).select("transaction_id", H.stable_hash("payer_id", "user").alias("salted"),
                                H.stable_hash("payer_id").alias("plain"))


@query("choose_by_hash", WITH_TX + f"""
SELECT transaction_id, {sql_pick(sql_hash('transaction_id', 'channel'), S.CHANNELS['paysim'])}
    AS channel FROM tx""")
def _choose(spark, sf):
    return tx(spark, sf).select("transaction_id", H.choose_by_hash(
        "transaction_id", S.CHANNELS["paysim"], "channel").alias("channel"))


@query("id_by_hash", WITH_TX + f"""
SELECT transaction_id,
    'D_' || lpad(CAST({sql_hash('payer_id || transaction_id', 'device')} % 280000 AS VARCHAR), 7, '0')
    AS device_id FROM tx""")
def _id_by_hash(spark, sf):
    return tx(spark, sf).select("transaction_id", H.id_by_hash(
        F.concat("payer_id", "transaction_id"), "D_", 280_000, "device").alias("device_id"))


@query("fake_ip", WITH_TX + f""", h AS (
    SELECT transaction_id, {sql_hash('transaction_id', 'ip_profile')} AS h FROM tx)
SELECT transaction_id, concat(10 + h % 210, '.', (h // 210) % 256, '.', (h // 53760) % 256, '.',
    (h // 13762560) % 254 + 1) AS ip_address FROM h""")
def _fake_ip(spark, sf):
    return tx(spark, sf).select("transaction_id", H.fake_ip(
        H.stable_hash("transaction_id", "ip_profile")).alias("ip_address"))


@query("default_fields", WITH_D + """
SELECT transaction_id, currency, txn_type, amount, payer_id, payee_id, merchant_id,
    merchant_category, payer_country, payee_country, is_fraud FROM d""")
def _default_fields(spark, sf):
    return d(spark, sf).select(
        "transaction_id", "currency", "txn_type", "amount", "payer_id", "payee_id", "merchant_id",
        "merchant_category", "payer_country", "payee_country", "is_fraud")


_RAGGED = """CASE WHEN source = 'creditcard' THEN NULL WHEN k % 10 = 0 THEN NULL
    WHEN source = 'saml_d' THEN TIMESTAMP{ntz} '2024-01-05 06:00:00' ELSE timestamp END"""


@query("rescale_time", WITH_TX + f""", r AS (
    SELECT transaction_id, source, {_RAGGED.format(ntz='')} AS ts FROM tx),
s AS (SELECT source, min(ts) AS lo, max(ts) AS hi, count(*) AS n FROM r GROUP BY source),
f AS (SELECT transaction_id, CASE WHEN lo IS NULL THEN 0.0 WHEN lo = hi THEN
        (row_number() OVER (PARTITION BY source ORDER BY transaction_id) - 1)
            / CAST(greatest(n - 1, 1) AS DOUBLE)
      ELSE ((epoch_us(coalesce(ts, lo)) - epoch_us(lo)) / 1e6) / ((epoch_us(hi) - epoch_us(lo)) / 1e6)
      END AS share FROM r JOIN s USING (source))
SELECT transaction_id, TIMESTAMP '{S.WINDOW_START}'
    + to_seconds(CAST(round_even(share * {S.WINDOW_SECONDS}, 0) AS BIGINT)) AS timestamp FROM f""")
def _rescale(spark, sf):
    ragged = tx(spark, sf).withColumn("timestamp", F.expr(_RAGGED.format(ntz="_NTZ")))
    return D.rescale_time(ragged.select("transaction_id", "source", "timestamp")).select(
        "transaction_id", "timestamp")


@query("payment_method", WITH_D + """
SELECT transaction_id, CASE
    WHEN regexp_matches(txn_type, 'payment|online|topup|top_up') THEN 'wallet'
    WHEN regexp_matches(txn_type, 'cross_border|transfer|wire|ach') THEN 'bank_transfer'
    WHEN regexp_matches(txn_type, 'cash|withdrawal|deposit') THEN 'cash'
    WHEN regexp_matches(txn_type, 'card|product|w|c|h|r') THEN 'card' ELSE 'balance' END
    AS payment_method FROM d""")
def _payment_method(spark, sf):
    return d(spark, sf).select("transaction_id", D.payment_method("txn_type").alias("payment_method"))


@query("ts_coerce", WITH_TX + """
SELECT transaction_id, round(CASE k % 4
    WHEN 0 THEN epoch(date_trunc('second', timestamp)) WHEN 1 THEN epoch(timestamp)
    WHEN 2 THEN epoch(date_trunc('second', timestamp)) - 19800
    ELSE epoch(timestamp + INTERVAL 1 HOUR) END, 3) AS epoch_seconds FROM tx""")
def _ts_coerce(spark, sf):
    second = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    text = (F.when(F.col("k") % 4 == 0, F.replace(second, F.lit("T"), F.lit(" ")))
            .when(F.col("k") % 4 == 1, F.concat(
                F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
            .when(F.col("k") % 4 == 2, F.concat(second, F.lit("+05:30")))
            .otherwise("not a time"))
    ingest = F.col("timestamp") + F.expr("INTERVAL 1 HOUR")
    return rounded(tx(spark, sf).withColumn("_text", text).withColumn("_in", ingest).select(
        "transaction_id", D.ts_coerce("_text", "_in").alias("epoch_seconds")),
        "epoch_seconds", digits=3)


_CALENDAR = """CAST(hour(timestamp) AS TINYINT) AS hour,
    CAST(isodow(timestamp) - 1 AS TINYINT) AS day_of_week,
    CAST(isodow(timestamp) >= 6 AS TINYINT) AS is_weekend,
    CAST(hour(timestamp) BETWEEN 0 AND 5 AS TINYINT) AS is_night"""


@query("calendar_fields", WITH_TX + f"SELECT transaction_id, {_CALENDAR} FROM tx")
def _calendar(spark, sf):
    return D.calendar_fields(tx(spark, sf)).select(
        "transaction_id", "hour", "day_of_week", "is_weekend", "is_night")


@query("label_quality", WITH_TX + """
SELECT transaction_id, CASE is_fraud WHEN 1 THEN 'labeled_fraud' WHEN 0 THEN 'labeled_normal'
    ELSE 'unlabeled' END AS label_quality FROM tx""")
def _label_quality(spark, sf):
    return tx(spark, sf).select("transaction_id", D.label_quality().alias("label_quality"))


_FRAUD_TYPE = """CASE WHEN is_fraud < 0 THEN 'unknown' WHEN is_fraud = 0 THEN 'normal'
    WHEN source = 'creditcard' THEN 'card_fraud' WHEN source = 'ieee_cis' THEN 'ecommerce_fraud'
    WHEN source = 'banksim' THEN 'merchant_fraud'
    WHEN source = 'saml_d' THEN regexp_replace(lower(coalesce(fraud_subtype, '')), '\\s+', '_', 'g')
    WHEN source = 'paysim' AND regexp_matches(txn_type, 'transfer|cross_border|wire|ach')
        THEN 'money_laundering' ELSE 'payment_fraud' END"""


@query("infer_fraud_type", WITH_D + f"SELECT transaction_id, {_FRAUD_TYPE} AS fraud_type FROM d")
def _fraud_type(spark, sf):
    return d(spark, sf).select("transaction_id", D.infer_fraud_type().alias("fraud_type"))


WITH_RULE = WITH_D + f""", c AS (SELECT *, {_CALENDAR} FROM d),
rule AS (SELECT *, round_even(least(1.0::DOUBLE, greatest(0.0::DOUBLE,
    0.45::DOUBLE * {sql_pct_rank('amount', 'source')} + 0.20::DOUBLE * is_night
    + 0.20::DOUBLE * CAST(payer_country <> payee_country AS INT)
    + 0.15::DOUBLE * CAST(regexp_matches(txn_type, '{HIGH_RISK}') AS INT))), 4) AS rule_score FROM c)"""
_LEVEL = """CASE WHEN is_fraud = 1 THEN 'high' WHEN is_fraud < 0 THEN 'unknown'
    WHEN rule_score >= 0.70 THEN 'high' WHEN rule_score >= 0.35 THEN 'medium' ELSE 'low' END"""


@query("rule_score", WITH_RULE + "SELECT transaction_id, rule_score FROM rule")
def _rule_score(spark, sf):
    return D.rule_score(D.calendar_fields(d(spark, sf))).select("transaction_id", "rule_score")


@query("risk_level_rule", WITH_RULE + f"SELECT transaction_id, {_LEVEL} AS risk_level FROM rule")
def _risk_level(spark, sf):
    return D.risk_fields(D.calendar_fields(d(spark, sf))).select("transaction_id", "risk_level")


_EDGY = "round(amount / 10) * CASE WHEN k % 3 = 0 THEN 10 WHEN k % 3 = 1 THEN 100 ELSE 1000 END"


def _bucket_sql(op: str) -> str:
    return WITH_TX + f""", e AS (SELECT transaction_id, {_EDGY} AS amount FROM tx)
    SELECT transaction_id, CASE WHEN amount {op} 10 THEN 'micro' WHEN amount {op} 100 THEN 'small'
    WHEN amount {op} 1000 THEN 'medium' WHEN amount {op} 10000 THEN 'large' ELSE 'xlarge' END
    AS amount_bucket FROM e"""


@query("amount_bucket", _bucket_sql("<="))
def _bucket(spark, sf):
    return tx(spark, sf).select("transaction_id", F.expr(_EDGY).alias("amount")).select(
        "transaction_id", D.amount_bucket().alias("amount_bucket"))


@query("amount_bucket_left", _bucket_sql("<"))
def _bucket_left(spark, sf):
    return tx(spark, sf).select("transaction_id", F.expr(_EDGY).alias("amount")).select(
        "transaction_id", D.amount_bucket_left().alias("amount_bucket"))


_CHANNEL = "CASE source " + " ".join(
    f"WHEN '{s}' THEN {sql_pick(sql_hash('transaction_id', 'channel'), S.CHANNELS[s])}"
    for s in ("paysim", "banksim", "ieee_cis", "creditcard", "saml_d")) + " END"


@query("project_log_columns", WITH_D + f""",
s AS (SELECT source, min(timestamp) AS lo, max(timestamp) AS hi FROM d GROUP BY source),
e AS (SELECT d.* REPLACE (TIMESTAMP '{S.WINDOW_START}' + to_seconds(CAST(round_even(
        ((epoch_us(timestamp) - epoch_us(lo)) / 1e6) / ((epoch_us(hi) - epoch_us(lo)) / 1e6)
        * {S.WINDOW_SECONDS}, 0) AS BIGINT)) AS timestamp) FROM d JOIN s USING (source)),
c AS (SELECT *, {_CALENDAR} FROM e),
rule AS (SELECT *, round_even(least(1.0::DOUBLE, greatest(0.0::DOUBLE,
    0.45::DOUBLE * {sql_pct_rank('amount', 'source')} + 0.20::DOUBLE * is_night
    + 0.20::DOUBLE * CAST(payer_country <> payee_country AS INT)
    + 0.15::DOUBLE * CAST(regexp_matches(txn_type, '{HIGH_RISK}') AS INT))), 4) AS rule_score FROM c),
lab AS (SELECT transaction_id, row_number() OVER (ORDER BY timestamp, transaction_id) - 1 AS place,
    count(*) OVER () AS n FROM rule WHERE is_fraud IN (0, 1))
SELECT CAST(row_number() OVER (ORDER BY timestamp, transaction_id) - 1 AS BIGINT) AS row_id,
    transaction_id, source, timestamp, 'transaction' AS event_type, amount,
    CASE WHEN amount <= 10 THEN 'micro' WHEN amount <= 100 THEN 'small'
         WHEN amount <= 1000 THEN 'medium' WHEN amount <= 10000 THEN 'large' ELSE 'xlarge' END
        AS amount_bucket, currency, txn_type, {_CHANNEL} AS channel,
    CASE WHEN regexp_matches(txn_type, 'payment|online|topup|top_up') THEN 'wallet'
         WHEN regexp_matches(txn_type, 'cross_border|transfer|wire|ach') THEN 'bank_transfer'
         WHEN regexp_matches(txn_type, 'cash|withdrawal|deposit') THEN 'cash'
         WHEN regexp_matches(txn_type, 'card|product|w|c|h|r') THEN 'card' ELSE 'balance' END
        AS payment_method, payer_id, payee_id, merchant_id, merchant_category,
    'D_' || lpad(CAST({sql_hash('payer_id || transaction_id', 'device')} % 280000 AS VARCHAR), 7, '0')
        AS device_id,
    'IP_' || lpad(CAST({sql_hash("payer_id || strftime(timestamp, '%Y-%m-%d %H:%M:%S')", 'ip')}
        % 180000 AS VARCHAR), 7, '0') AS ip_id,
    payer_country, payee_country, is_fraud, {_FRAUD_TYPE} AS fraud_type, {_LEVEL} AS risk_level,
    rule_score, CASE is_fraud WHEN 1 THEN 'labeled_fraud' WHEN 0 THEN 'labeled_normal'
        ELSE 'unlabeled' END AS label_quality,
    CASE WHEN place IS NULL THEN 'unlabeled' WHEN place < floor(n * 0.70::DOUBLE) THEN 'train'
         WHEN place < floor(n * 0.85::DOUBLE) THEN 'valid' ELSE 'test' END AS split,
    hour, day_of_week, is_weekend, is_night
FROM rule LEFT JOIN lab USING (transaction_id)""")
def _log(spark, sf):
    from ledgerlens.plans.dataset import build_log

    return build_log([tx(spark, sf).select(*S.CORE_COLUMNS)])


@query("split_by_bound", WITH_TX + """, b AS (
    SELECT max(timestamp) FILTER (split = 'train') AS t, max(timestamp) FILTER (split = 'valid') AS v
    FROM tx)
SELECT transaction_id, CASE WHEN timestamp + INTERVAL 36 HOUR <= t THEN 'train'
    WHEN timestamp + INTERVAL 36 HOUR <= v THEN 'valid' ELSE 'test' END AS split FROM tx, b""")
def _split_by_bound(spark, sf):
    log = tx(spark, sf)
    moved = log.select("transaction_id", (F.col("timestamp") + F.expr("INTERVAL 36 HOURS")).alias("timestamp"))
    return D.split_by_bound(moved, log).select("transaction_id", "split")


@query("flatten_event", WITH_D + """
SELECT transaction_id, u AS txn_count, k AS txn_count_device, payer_country AS home_country,
    u % 7 AS bind_user_count_ip, k % 9 AS txn_count_merchant, merchant_category AS
    merchant_category_merchant, timestamp AS device_first_seen_time, k AS note_k,
    CAST(NULL AS VARCHAR) AS note, k % 3 AS window_features_user_txn_count_5min,
    CAST(u % 4 AS DOUBLE) AS payer_graph_degree FROM d""")
def _flatten(spark, sf):
    nested = d(spark, sf).select(
        "transaction_id",
        F.struct(F.col("u").alias("txn_count"), F.col("payer_country").alias("home_country"))
        .alias("user_profile"),
        F.struct(F.col("k").alias("txn_count"), F.col("timestamp").alias("first_seen_time"))
        .alias("device_profile"),
        F.struct((F.col("u") % 7).alias("bind_user_count")).alias("ip_profile"),
        F.struct((F.col("k") % 9).alias("txn_count"), "merchant_category").alias("merchant_profile"),
        F.struct((F.col("k") % 3).alias("user_txn_count_5min")).alias("window_features"),
        F.struct((F.col("u") % 4).cast("double").alias("payer_graph_degree")).alias("graph_features"),
        F.to_json(F.struct("k")).alias("note"))
    from pyspark.sql import types as T
    return D.flatten_event(nested, {"note": T.StructType([T.StructField("k", T.LongType())])})


@query("apply_feature_contract", WITH_TX + """
SELECT transaction_id, amount, coalesce(txn_type, '__missing__') AS txn_type,
    '__missing__' AS channel, 5.0::DOUBLE AS txn_count, 0.0::DOUBLE AS merchant_id FROM tx""")
def _contract(spark, sf):
    contract = D.FeatureContract(
        ("amount", "txn_type", "channel", "txn_count", "merchant_id"), ("txn_type", "channel"),
        {"amount": 0.0, "txn_count": 5.0})
    source = tx(spark, sf).withColumn("amount", F.col("amount").cast("string"))
    return D.apply_feature_contract(source, contract, keep=["transaction_id"])


@query("risk_decision", WITH_TX + """
SELECT transaction_id, CASE WHEN risk_score >= 0.6 THEN 'high' WHEN risk_score >= 0.2 THEN 'medium'
    ELSE 'low' END AS risk_level, CASE WHEN risk_score >= 0.6 THEN 'reject'
    WHEN risk_score >= 0.2 THEN 'review' ELSE 'pass' END AS decision FROM tx""")
def _decision(spark, sf):
    level, action = D.risk_decision("risk_score", D.Thresholds(0.2, 0.6))
    return tx(spark, sf).select("transaction_id", level.alias("risk_level"), action.alias("decision"))


def _win(key: str, seconds: int) -> str:
    return (f"OVER (PARTITION BY coalesce({key}, '') ORDER BY timestamp RANGE BETWEEN INTERVAL "
            f"{seconds} SECOND PRECEDING AND CURRENT ROW)")


@query("reason_codes", WITH_D + f""", w AS (SELECT *,
    count(*) {_win('payer_id', 300)} AS n5, sum(amount) {_win('payer_id', 300)} AS s5,
    count(DISTINCT payer_id) {_win('device_id', 600)} AS nd,
    avg(amount) OVER (PARTITION BY payer_id) AS avg_amount FROM d),
r AS (SELECT transaction_id, risk_score, list_filter([
    CASE WHEN amount * 40 >= greatest(avg_amount * 3, 5000) THEN 'amount_deviation' END,
    CASE WHEN n5 >= 5 OR s5 >= 10000 THEN 'high_frequency_user_window' END,
    CASE WHEN nd >= 3 OR u % 13 >= 10 THEN 'shared_device' END,
    CASE WHEN k % 10 = 1 OR k % 7 = 1 THEN 'risky_ip' END,
    CASE WHEN k / 1000 >= 0.05 THEN 'merchant_concentration' END,
    CASE WHEN u / 200 >= 0.2 OR k % 5 >= 3 THEN 'graph_fraud_neighborhood' END,
    CASE WHEN risk_score >= 0.70 THEN 'fraud_ring_detected' END,
    CASE WHEN k % 4 >= 2 THEN 'shared_device_ring' END,
    CASE WHEN k % 6 >= 2 THEN 'shared_ip_cluster' END], lambda x: x IS NOT NULL)[1:5] AS codes FROM w)
SELECT transaction_id, CASE WHEN risk_score >= 0.05 AND len(codes) = 0 THEN 'model_high_score'
    ELSE array_to_string(codes, ',') END AS reason_codes FROM r""")
def _reasons(spark, sf):
    base = d(spark, sf)
    for key in ("payer_id", "device_id"):
        base = sliding_features(base, key, BY_KEY[key], prefix="w_")
    means = base.groupBy(F.col("payer_id").alias("_p")).agg(F.avg("amount").alias("avg_amount"))
    base = base.join(means, F.col("payer_id") == F.col("_p"))
    event = base.select(
        "transaction_id", "risk_score", (F.col("amount") * 40).alias("amount"),
        F.struct(F.col("w_user_txn_count_5min").alias("user_txn_count_5min"),
                 F.col("w_user_amount_sum_5min").alias("user_amount_sum_5min"),
                 F.col("w_device_unique_user_count_10min").alias("device_unique_user_count_10min"))
        .alias("window_features"),
        F.struct("avg_amount").alias("user_profile"),
        F.struct((F.col("u") % 13).alias("bind_user_count")).alias("device_profile"),
        F.struct((F.col("k") % 10 == 1).cast("int").alias("is_proxy"),
                 (F.col("k") % 7 == 1).cast("int").alias("is_vpn")).alias("ip_profile"),
        F.struct((F.col("k") / 1000).alias("complaint_rate")).alias("merchant_profile"),
        F.struct((F.col("u") / 200).alias("payer_graph_fraud_edge_ratio"),
                 (F.col("k") % 5).alias("payer_graph_fraud_edge_count"),
                 F.col("risk_score").alias("payer_graph_mining_group_risk_score"),
                 (F.col("k") % 4).alias("payer_graph_mining_shared_device_count"),
                 (F.col("k") % 6).alias("payer_graph_mining_shared_ip_count"))
        .alias("graph_features"))
    codes = D.reason_codes(event, "risk_score", D.Thresholds(0.02, 0.05))
    return event.select("transaction_id", F.array_join(codes, ",").alias("reason_codes"))


@query("group_risk_level", WITH_TX + """
SELECT transaction_id, CASE WHEN risk_score >= 0.75 THEN 'high' WHEN risk_score >= 0.65
    THEN 'medium' ELSE 'watch' END AS risk_level FROM tx""")
def _group_level(spark, sf):
    return tx(spark, sf).select("transaction_id", D.group_risk_level("risk_score").alias("risk_level"))


@query("entity_type_from_prefix", WITH_TX + """, ids AS (
    SELECT DISTINCT unnest([payer_id, payee_id, merchant_id, device_id, ip_id,
        'inj_m:' || CAST(u AS VARCHAR), 'banksim_m:' || CAST(k AS VARCHAR)]) AS id FROM tx)
SELECT id, CASE WHEN starts_with(id, 'D_') THEN 'device' WHEN starts_with(id, 'IP_') THEN 'ip'
    WHEN starts_with(id, 'banksim_m:') OR starts_with(id, 'amlsim_branch:') OR starts_with(id, 'M_')
    THEN 'merchant' WHEN starts_with(id, 'payee:') THEN 'payee' ELSE 'user' END AS entity_type
FROM ids WHERE id IS NOT NULL""")
def _entity_type(spark, sf):
    ids = F.array("payer_id", "payee_id", "merchant_id", "device_id", "ip_id",
                  F.concat(F.lit("inj_m:"), F.col("u").cast("string")),
                  F.concat(F.lit("banksim_m:"), F.col("k").cast("string")))
    return (tx(spark, sf).select(F.explode(ids).alias("id")).where(F.col("id").isNotNull()).distinct()
            .select("id", D.entity_type_from_prefix("id").alias("entity_type")))


def _axis(value: str) -> str:
    return f"round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {value})), 6)"


@query("profile_axes", USER_SQL + f"""
SELECT user_id, {_axis('ln(1 + txn_count) / ln(201)')} AS axis_activity,
    {_axis('ln(1 + total_amount) / ln(200001)')} AS axis_amount,
    {_axis('common_device_count / 15')} AS axis_devices, {_axis('common_ip_count / 15')} AS axis_ips,
    {_axis('observed_fraud_rate')} AS axis_fraud_history, {_axis('risk_history_score')}
    AS axis_ring_risk FROM user_profile""")
def _axes(spark, sf):
    axes = ("axis_activity", "axis_amount", "axis_devices", "axis_ips", "axis_fraud_history",
            "axis_ring_risk")
    return rounded(D.profile_axes(profiles.user_profile(d(spark, sf))).select("user_id", *axes), *axes)


@query("cross_country", WITH_D + """
SELECT transaction_id, CAST(payer_country <> payee_country AS TINYINT) AS cross_country FROM d""")
def _cross(spark, sf):
    return d(spark, sf).select("transaction_id", D.cross_country().alias("cross_country"))


@query("high_risk_type", WITH_D + f"""
SELECT transaction_id, CAST(regexp_matches(txn_type, '{HIGH_RISK}') AS TINYINT) AS high_risk_type
FROM d""")
def _high_risk(spark, sf):
    return d(spark, sf).select("transaction_id", D.high_risk_type().alias("high_risk_type"))


@query("account_age", WITH_TX + f"""
SELECT DISTINCT payer_id AS user_id, CAST({sql_hash('payer_id', 'account_age')} % 1800 + 1 AS INT)
    AS account_age_days FROM tx""")
def _age(spark, sf):
    return tx(spark, sf).select(F.col("payer_id").alias("user_id")).distinct().withColumn(
        "account_age_days", D.account_age("user_id"))


@query("labelled_only", WITH_TX + "SELECT transaction_id, is_fraud FROM tx WHERE is_fraud IN (0, 1)")
def _labelled(spark, sf):
    return D.labelled_only(tx(spark, sf)).select("transaction_id", "is_fraud")


@query("scan_splits", WITH_TX + """
SELECT transaction_id, source, timestamp, amount, payer_id, payee_id, merchant_id, device_id, ip_id,
    is_fraud, is_injected, fraud_group_id, injection_scenario, scenario_step,
    CAST(NULL AS VARCHAR) AS absent, split AS part FROM tx WHERE split IN ('train', 'valid')""")
def _scan(spark, sf):
    from ledgerlens.sources.tables import MINING_COLUMNS

    return scan_splits(tx(spark, sf), ("train", "valid"), (*MINING_COLUMNS, "absent"))
