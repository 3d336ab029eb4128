"""The driver tables read as transactions.

``transactions`` maps each event to one payment; ``trades`` maps each order line to a payment
from customer to supplier. Both use integer arithmetic only, so the same view can be written in
any SQL dialect (``TX_SQL`` and ``TRADES_SQL``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TX_COLUMNS = """
    concat('e:', CAST(event_id AS STRING)) AS transaction_id,
    CASE event_type WHEN 'view' THEN 'paysim' WHEN 'purchase' THEN 'banksim'
         WHEN 'signup' THEN 'ieee_cis' WHEN 'click' THEN 'creditcard' ELSE 'saml_d' END AS source,
    ts AS timestamp,
    value AS amount,
    CASE WHEN k % 11 = 0 THEN NULL ELSE 'USD' END AS currency,
    CASE k % 7 WHEN 0 THEN 'TRANSFER' WHEN 1 THEN 'payment' WHEN 2 THEN 'cash_out'
         WHEN 3 THEN 'cross_border' WHEN 4 THEN 'debit' WHEN 5 THEN 'Online_Topup'
         ELSE NULL END AS txn_type,
    concat('U_', CAST(u AS STRING)) AS payer_id,
    CASE WHEN k % 5 = 0 THEN concat('U_', CAST((u {div} 12) * 12 + k % 12 AS STRING))
         ELSE concat('payee:', CAST(u {div} 12 AS STRING)) END AS payee_id,
    CASE WHEN event_type = 'purchase' THEN concat('M_', CAST(u {div} 24 AS STRING)) END
        AS merchant_id,
    CASE WHEN event_type = 'purchase' THEN concat('cat_', CAST(k % 4 AS STRING)) END
        AS merchant_category,
    CASE u % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'UK' WHEN 2 THEN 'UAE' WHEN 3 THEN 'SG' ELSE NULL END
        AS payer_country,
    CASE k % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'UK' WHEN 2 THEN 'UAE' WHEN 3 THEN 'SG' ELSE NULL END
        AS payee_country,
    CAST(label AS TINYINT) AS is_fraud,
    CASE WHEN label = 1 THEN CASE k % 3 WHEN 0 THEN 'Fan Out' WHEN 1 THEN 'Structuring'
         ELSE 'Smurfing  Ring' END END AS fraud_subtype,
    CASE WHEN k % 13 = 0 THEN NULL ELSE concat('D_', CAST(u {div} 4 AS STRING)) END AS device_id,
    CASE WHEN k % 17 = 0 THEN NULL ELSE concat('IP_', CAST(u {div} 12 AS STRING)) END AS ip_id,
    CASE WHEN label < 0 THEN 'unlabeled' WHEN ts < TIMESTAMP '2024-01-22 00:00:00' THEN 'train'
         WHEN ts < TIMESTAMP '2024-01-26 12:00:00' THEN 'valid' ELSE 'test' END AS split,
    CAST(CASE WHEN label = 1 THEN k % 2 ELSE 0 END AS TINYINT) AS is_injected,
    CASE WHEN label = 1 AND k % 2 = 1 THEN concat('FG_', CAST(u % 12 AS STRING)) END
        AS fraud_group_id,
    CASE WHEN label = 1 AND k % 2 = 1 THEN CASE k % 3 WHEN 0 THEN 'mule_account'
         WHEN 1 THEN 'money_laundering' ELSE 'bonus_abuse' END END AS injection_scenario,
    CASE WHEN label = 1 AND k % 2 = 1 THEN concat('step_', CAST(k % 4 AS STRING)) END
        AS scenario_step,
    least(1.0, value / 200) AS risk_score,
    event_id, u, k
"""

_TX_BASE = """
    SELECT event_id, ts, event_type, value, u, k,
           CASE WHEN event_type = 'signup' AND k < 20 THEN -1 WHEN value >= 150 THEN 1 ELSE 0 END
               AS label
    FROM (SELECT event_id, ts, event_type, value, user_id AS u, {k} AS k FROM {events}) AS raw
"""

_TRADE_COLUMNS = """
    concat('l:', CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING), ':',
           CAST(l_partkey AS STRING), ':', CAST(l_suppkey AS STRING)) AS transaction_id,
    CASE l_returnflag WHEN 'A' THEN 'paysim' WHEN 'N' THEN 'banksim' ELSE 'saml_d' END AS source,
    CAST(l_shipdate AS TIMESTAMP{ntz}) AS timestamp,
    l_extendedprice AS amount,
    concat('C_', CAST(o_custkey AS STRING)) AS payer_id,
    concat('S_', CAST(l_suppkey AS STRING)) AS payee_id,
    concat('M_', CAST(l_suppkey {div} 10 AS STRING)) AS merchant_id,
    concat('D_', CAST(o_custkey {div} 4 AS STRING)) AS device_id,
    concat('IP_', CAST(o_custkey {div} 12 AS STRING)) AS ip_id,
    CAST(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.08 THEN 1 ELSE 0 END AS TINYINT)
        AS is_fraud
"""

TX_SQL = (
    "SELECT " + _TX_COLUMNS.format(div="//").replace("AS STRING", "AS VARCHAR") + " FROM ("
    + _TX_BASE.format(k="CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)", events="events")
    + ") AS base"
)
TRADES_SQL = (
    "SELECT " + _TRADE_COLUMNS.format(div="//", ntz="").replace("AS STRING", "AS VARCHAR")
    + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    base = _TX_BASE.format(k="CAST(get_json_object(props, '$.k') AS BIGINT)", events="{events}")
    columns = _TX_COLUMNS.format(div="div").replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
    return spark.sql(f"SELECT {columns} FROM ({base}) AS base", events=events)


def trades(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(
        "SELECT " + _TRADE_COLUMNS.format(div="div", ntz="_NTZ")
        + " FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
        lineitem=table(spark, folder, "lineitem"), orders=table(spark, folder, "orders"))
