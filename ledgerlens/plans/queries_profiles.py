"""Queries of profiles and the joins that use them (survey sections 2.3 and 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.operators import aggregates as A
from ledgerlens.operators import joins as J
from ledgerlens.operators import profiles as P
from ledgerlens.plans.registry import (
    WITH_D, WITH_TX, d, query, rounded, sql_hash, sql_pct_rank, sql_pick, tx,
)


def _mode_sql(table: str, key: str, value: str, out: str) -> str:
    return (f"(SELECT {key}, {value} AS {out} FROM (SELECT {key}, {value}, row_number() OVER "
            f"(PARTITION BY {key} ORDER BY count(*) DESC, {value}) AS place FROM {table} "
            f"WHERE {value} IS NOT NULL GROUP BY {key}, {value}) AS q WHERE place = 1)")


_CLIP = "round_even(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {0})), {1})"

USER_CTE = f""", ev AS (
    SELECT payer_id AS user_id, timestamp, amount, is_fraud, device_id, ip_id, source,
        payer_country AS country FROM d
    UNION ALL SELECT payee_id, timestamp, amount, is_fraud, device_id, ip_id, source, payee_country
        FROM d WHERE merchant_id IS NULL),
user_agg AS (SELECT user_id, min(timestamp) AS first_seen_time, max(timestamp) AS last_seen_time,
    count(*) AS txn_count, sum(amount) AS total_amount, avg(amount) AS avg_amount,
    count(*) FILTER (is_fraud = 1) AS fraud_txn_count,
    count(DISTINCT device_id) AS common_device_count, count(DISTINCT ip_id) AS common_ip_count
    FROM ev GROUP BY user_id),
user_rate AS (SELECT user_agg.*, source_hint, home_country,
    round_even(fraud_txn_count / txn_count, 6) AS observed_fraud_rate,
    CAST({sql_hash('user_agg.user_id', 'account_age')} % 1800 + 1 AS INT) AS account_age_days
    FROM user_agg LEFT JOIN {_mode_sql('ev', 'user_id', 'source', 'source_hint')} AS m1 USING (user_id)
    LEFT JOIN {_mode_sql('ev', 'user_id', 'country', 'home_country')} AS m2 USING (user_id)),
user_score AS (SELECT *, {_CLIP.format(
    f"0.75::DOUBLE * observed_fraud_rate + 0.25::DOUBLE * {sql_pct_rank('avg_amount')}", 4)}
    AS risk_history_score FROM user_rate),
user_profile AS (SELECT *, CAST(fraud_txn_count > 0 AND risk_history_score >= 0.20 AS TINYINT)
    AS is_black_user FROM user_score)"""
USER_SQL = WITH_D + USER_CTE

MERCHANT_CTE = f""", mtx AS (SELECT * FROM d WHERE merchant_id IS NOT NULL),
merchant_agg AS (SELECT merchant_id, min(timestamp) AS first_seen_time,
    max(timestamp) AS last_seen_time, count(*) AS txn_count,
    count(DISTINCT payer_id) AS unique_user_count, sum(amount) AS total_amount,
    avg(amount) AS avg_amount, count(*) FILTER (is_fraud = 1) AS fraud_txn_count,
    {sql_hash('merchant_id', 'merchant_noise')} AS h FROM mtx GROUP BY merchant_id),
merchant_rate AS (SELECT merchant_agg.*, merchant_category, merchant_country,
    round_even(fraud_txn_count / txn_count, 6) AS observed_fraud_rate FROM merchant_agg
    LEFT JOIN {_mode_sql('mtx', 'merchant_id', 'merchant_category', 'merchant_category')} AS m1
        USING (merchant_id)
    LEFT JOIN {_mode_sql('mtx', 'merchant_id', 'payee_country', 'merchant_country')} AS m2
        USING (merchant_id)),
merchant_noise AS (SELECT *,
    {_CLIP.format("observed_fraud_rate * 0.6::DOUBLE + (h % 100) / 10000", 5)} AS chargeback_rate,
    {_CLIP.format("observed_fraud_rate * 0.4::DOUBLE + ((h // 100) % 100) / 12000", 5)}
        AS complaint_rate FROM merchant_rate),
merchant_profile AS (SELECT * EXCLUDE (h), {_CLIP.format(
    "0.55::DOUBLE * observed_fraud_rate + 0.20::DOUBLE * chargeback_rate + 0.15::DOUBLE * "
    f"complaint_rate + 0.10::DOUBLE * {sql_pct_rank('avg_amount')}", 4)} AS merchant_risk_score
    FROM merchant_noise)"""

DEVICE_CTE = f""", device_agg AS (SELECT device_id, min(timestamp) AS first_seen_time,
    max(timestamp) AS last_seen_time, count(DISTINCT payer_id) AS bind_user_count,
    count(*) AS txn_count, count(*) FILTER (is_fraud = 1) AS fraud_txn_count,
    {sql_hash('device_id', 'device_profile')} AS h FROM d WHERE device_id IS NOT NULL
    GROUP BY device_id),
device_flags AS (SELECT *, {sql_pick('h', S.DEVICE_TYPES)} AS device_type,
    {sql_pick('(h // 7)', S.OS_TYPES)} AS os, {sql_pick('(h // 13)', S.BROWSERS)} AS browser,
    fraud_txn_count / txn_count AS observed_fraud_rate, CAST(h % 97 < 3 AS TINYINT) AS is_emulator,
    CAST(bind_user_count >= 8 OR h % 211 = 0 AS TINYINT) AS is_proxy_device FROM device_agg),
device_profile AS (SELECT * EXCLUDE (h), {_CLIP.format(
    f"{sql_pct_rank('bind_user_count')} * 0.45::DOUBLE + 0.45::DOUBLE * observed_fraud_rate "
    "+ 0.05::DOUBLE * is_emulator + 0.05::DOUBLE * is_proxy_device", 4)} AS device_risk_score
    FROM device_flags)"""

_CITY = "CASE country " + " ".join(
    f"WHEN '{c}' THEN '{city}'" for c, city in S.CITY_BY_COUNTRY.items()) + " ELSE 'Unknown' END"
IP_CTE = f""", ip_agg AS (SELECT ip_id, min(timestamp) AS first_seen_time,
    max(timestamp) AS last_seen_time, count(DISTINCT payer_id) AS bind_user_count,
    count(*) AS txn_count, count(*) FILTER (is_fraud = 1) AS fraud_txn_count,
    {sql_hash('ip_id', 'ip_profile')} AS h FROM d WHERE ip_id IS NOT NULL GROUP BY ip_id),
ip_flags AS (SELECT ip_agg.*, country,
    concat(10 + h % 210, '.', (h // 210) % 256, '.', (h // 53760) % 256, '.',
        (h // 13762560) % 254 + 1) AS ip_address, {_CITY} AS city, {sql_pick('h', S.ISPS)} AS isp,
    CAST(bind_user_count >= 10 OR h % 101 < 4 AS TINYINT) AS is_proxy,
    CAST(h % 127 < 5 AS TINYINT) AS is_vpn, fraud_txn_count / txn_count AS observed_fraud_rate
    FROM ip_agg LEFT JOIN {_mode_sql('d', 'ip_id', 'payer_country', 'country')} AS m USING (ip_id)),
ip_profile AS (SELECT * EXCLUDE (h), {_CLIP.format(
    f"{sql_pct_rank('bind_user_count')} * 0.35::DOUBLE + 0.45::DOUBLE * observed_fraud_rate "
    "+ 0.10::DOUBLE * is_proxy + 0.10::DOUBLE * is_vpn", 4)} AS ip_risk_score FROM ip_flags)"""


@query("user_profile", USER_SQL + """
SELECT * REPLACE (round(total_amount, 4) AS total_amount, round(avg_amount, 9) AS avg_amount)
FROM user_profile""")
def _user(spark, sf):
    return rounded(rounded(P.user_profile(d(spark, sf)), "total_amount", digits=4), "avg_amount", digits=9)


@query("merchant_profile", WITH_D + MERCHANT_CTE + """
SELECT * REPLACE (round(total_amount, 4) AS total_amount, round(avg_amount, 9) AS avg_amount),
    CAST(merchant_risk_score >= 0.25 AS TINYINT) AS is_high_risk_merchant FROM merchant_profile""")
def _merchant(spark, sf):
    return rounded(rounded(P.merchant_profile(d(spark, sf)), "total_amount", digits=4), "avg_amount", digits=9)


@query("device_profile", WITH_D + DEVICE_CTE + """
SELECT * REPLACE (round(observed_fraud_rate, 6) AS observed_fraud_rate) FROM device_profile""")
def _device(spark, sf):
    return rounded(P.device_profile(d(spark, sf)), "observed_fraud_rate")


@query("ip_profile", WITH_D + IP_CTE + """
SELECT * REPLACE (round(observed_fraud_rate, 6) AS observed_fraud_rate) FROM ip_profile""")
def _ip(spark, sf):
    return rounded(P.ip_profile(d(spark, sf)), "observed_fraud_rate")


@query("enrich_profiles", USER_SQL + MERCHANT_CTE + DEVICE_CTE + IP_CTE + """
SELECT t.transaction_id, p.user_id, p.txn_count, round(p.avg_amount, 9) AS avg_amount,
    p.risk_history_score, p.first_seen_time AS user_first_seen_time,
    dv.txn_count AS txn_count_device, dv.bind_user_count, dv.device_risk_score,
    dv.first_seen_time AS device_first_seen_time, i.bind_user_count AS bind_user_count_ip,
    i.txn_count AS txn_count_ip, i.city, i.ip_risk_score,
    m.merchant_category AS merchant_category_merchant, m.txn_count AS txn_count_merchant,
    round(m.avg_amount, 9) AS avg_amount_merchant, m.merchant_risk_score,
    m.last_seen_time AS merchant_last_seen_time
FROM d AS t LEFT JOIN user_profile AS p ON t.payer_id = p.user_id
LEFT JOIN device_profile AS dv ON t.device_id = dv.device_id
LEFT JOIN ip_profile AS i ON t.ip_id = i.ip_id
LEFT JOIN merchant_profile AS m ON t.merchant_id = m.merchant_id""")
def _enrich(spark, sf):
    base = d(spark, sf)
    wide = J.enrich_profiles(base, P.all_profiles(base))
    return rounded(wide.select(
        "transaction_id", "user_id", "txn_count", "avg_amount", "risk_history_score",
        "user_first_seen_time", "txn_count_device", "bind_user_count", "device_risk_score",
        "device_first_seen_time", "bind_user_count_ip", "txn_count_ip", "city", "ip_risk_score",
        "merchant_category_merchant", "txn_count_merchant", "avg_amount_merchant",
        "merchant_risk_score", "merchant_last_seen_time"), "avg_amount", "avg_amount_merchant",
        digits=9)


@query("enrich_stream_profiles", USER_SQL + DEVICE_CTE + """
SELECT t.transaction_id, p.txn_count AS user_txn_count, p.risk_history_score,
    dv.bind_user_count AS device_users, dv.is_proxy_device
FROM d AS t LEFT JOIN user_profile AS p ON t.payer_id = p.user_id
LEFT JOIN device_profile AS dv ON t.device_id = dv.device_id""")
def _enrich_stream(spark, sf):
    from ledgerlens.streaming.scoring import enrich_stream_profiles

    base = d(spark, sf)
    profiles = {"user": P.user_profile(base), "device": P.device_profile(base)}
    return enrich_stream_profiles(base, profiles).select(
        "transaction_id", F.col("user_profile.txn_count").alias("user_txn_count"),
        F.col("user_profile.risk_history_score").alias("risk_history_score"),
        F.col("device_profile.bind_user_count").alias("device_users"),
        F.col("device_profile.is_proxy_device").alias("is_proxy_device"))


@query("alert_account_flag", WITH_TX + """, alerts AS (
    SELECT DISTINCT payer_id AS account_id FROM tx WHERE amount >= 250)
SELECT transaction_id, CAST(payer_id IN (SELECT account_id FROM alerts)
    OR coalesce(payee_id IN (SELECT account_id FROM alerts), FALSE) AS TINYINT) AS is_alert FROM tx""")
def _alert(spark, sf):
    base = tx(spark, sf)
    alerts = base.where(F.col("amount") >= 250).select(F.col("payer_id").alias("account_id"))
    return J.alert_account_flag(base, alerts, ["payer_id", "payee_id"]).select(
        "transaction_id", "is_alert")


@query("payee_is_payer", WITH_TX + """
SELECT transaction_id, payee_id FROM tx WHERE payee_id IN (SELECT payer_id FROM tx)""")
def _payee_payer(spark, sf):
    return J.payee_is_payer(tx(spark, sf)).select("transaction_id", "payee_id")


@query("coverage_check", WITH_TX + """
SELECT 'payer' AS name, count(*) AS missing FROM tx WHERE payer_id IS NOT NULL AND payer_id NOT IN
    (SELECT payer_id FROM tx WHERE split = 'valid')
UNION ALL SELECT 'merchant', count(*) FROM tx WHERE merchant_id IS NOT NULL AND merchant_id NOT IN
    (SELECT merchant_id FROM tx WHERE split = 'test' AND merchant_id IS NOT NULL)""")
def _coverage(spark, sf):
    from ledgerlens.operators.quality import coverage_check

    base = tx(spark, sf)
    valid, test = (base.where(F.col("split") == s) for s in ("valid", "test"))
    return coverage_check(base, [("payer", "payer_id", valid, "payer_id"),
                                 ("merchant", "merchant_id", test, "merchant_id")])


@query("sent_received_join", WITH_TX + """
SELECT s.transaction_id, s.sent_at, s.sent_at + (k % 17) / 100 AS received_at,
    round(s.sent_at + (k % 17) / 100 - s.sent_at, 6) AS latency_sec
FROM (SELECT transaction_id, event_id / 1000 AS sent_at, k FROM tx) AS s WHERE k % 19 <> 0""")
def _sent_received(spark, sf):
    sent = tx(spark, sf).select("transaction_id", "k", (F.col("event_id") / 1000).alias("sent_at"))
    received = sent.where(F.col("k") % 19 != 0).select(
        "transaction_id", (F.col("sent_at") + (F.col("k") % 17) / 100).alias("received_at"))
    return rounded(J.sent_received_join(sent, received), "latency_sec")


@query("source_counts", WITH_TX + """
SELECT source, count(*) AS rows, count(*) FILTER (is_fraud = 1) AS fraud,
    count(*) FILTER (is_fraud < 0) AS unlabeled FROM tx GROUP BY source""")
def _source_counts(spark, sf):
    return A.source_counts(tx(spark, sf))


@query("value_counts", WITH_TX + """
SELECT injection_scenario, count(*) AS rows FROM tx WHERE injection_scenario IS NOT NULL GROUP BY 1""")
def _value_counts(spark, sf):
    return A.value_counts(tx(spark, sf), "injection_scenario")


_SUMMARY = """count(*) AS rows, count(*) FILTER (is_fraud = 1) AS fraud,
    count(*) FILTER (is_fraud = 0) AS normal, count(*) FILTER (is_fraud < 0) AS unlabeled,
    min(timestamp) AS min_time, max(timestamp) AS max_time, round(count(*) FILTER (is_fraud = 1)
    / greatest(count(*) FILTER (is_fraud IN (0, 1)), 1), 6) AS fraud_rate_labeled FROM tx"""


@query("dataset_summary", WITH_TX + f"""
SELECT 'source' AS section, source AS name, {_SUMMARY} GROUP BY source
UNION ALL SELECT 'split', split, {_SUMMARY} GROUP BY split
UNION ALL SELECT 'all', 'all', {_SUMMARY}""")
def _summary(spark, sf):
    return rounded(A.dataset_summary(tx(spark, sf)), "fraud_rate_labeled")


@query("numeric_medians", WITH_TX + """
SELECT 'amount' AS "column", round(quantile_cont(amount, 0.5), 6) AS median FROM tx
UNION ALL SELECT 'k', quantile_cont(k, 0.5) FROM tx UNION ALL SELECT 'text', 0.0
UNION ALL SELECT 'half', round(quantile_cont(CASE WHEN k % 2 = 0 THEN amount END, 0.5), 6) FROM tx""")
def _medians(spark, sf):
    base = tx(spark, sf).select("amount", "k", F.lit("x").alias("text"),
                                F.when(F.col("k") % 2 == 0, F.col("amount")).alias("half"))
    return rounded(A.numeric_medians(base, ["amount", "k", "text", "half"]), "median")


@query("window_span_stats", WITH_TX + """, r AS (
    SELECT source, CASE WHEN k % 10 = 0 THEN NULL ELSE timestamp END AS timestamp FROM tx)
SELECT source, min(timestamp) AS first_time, max(timestamp) AS last_time,
    round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6, 6) AS span_seconds,
    count(*) FILTER (timestamp IS NULL) AS missing_times FROM r GROUP BY source""")
def _span(spark, sf):
    ragged = tx(spark, sf).withColumn("timestamp", F.when(F.col("k") % 10 != 0, F.col("timestamp")))
    return rounded(A.window_span_stats(ragged), "span_seconds")


@query("latency_percentiles", WITH_TX + """, l AS (
    SELECT amount AS latency, row_number() OVER (ORDER BY amount, transaction_id) - 1 AS idx,
        count(*) OVER () AS n FROM tx)
SELECT count(*) AS received, round(avg(latency), 6) AS latency_avg,
    max(latency) FILTER (idx = floor(n * 0.95::DOUBLE) - 1) AS latency_p95,
    max(latency) FILTER (idx = floor(n * 0.99::DOUBLE) - 1) AS latency_p99,
    max(latency) FILTER (idx = round_even(0.50::DOUBLE * (n - 1), 0)) AS nearest_p50,
    max(latency) FILTER (idx = round_even(0.95::DOUBLE * (n - 1), 0)) AS nearest_p95,
    max(latency) FILTER (idx = round_even(0.99::DOUBLE * (n - 1), 0)) AS nearest_p99 FROM l""")
def _latency(spark, sf):
    base = tx(spark, sf).select("transaction_id", F.col("amount").alias("latency_sec"))
    return rounded(A.latency_percentiles(base), "latency_avg")
