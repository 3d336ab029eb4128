"""Named queries over the driver tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.derive import default_fields
from ledgerlens.plans import adapter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The adapter view, and the view with the null handling of the core columns.
WITH_TX = f"WITH tx AS ({adapter.TX_SQL})"
WITH_D = WITH_TX + """, d AS (SELECT * REPLACE (
    coalesce(currency, 'UNKNOWN') AS currency, lower(coalesce(txn_type, 'unknown')) AS txn_type,
    greatest(coalesce(amount, 0.0), 0.0) AS amount,
    coalesce(payer_id, source || ':unknown_payer') AS payer_id,
    coalesce(payee_id, source || ':unknown_payee') AS payee_id,
    coalesce(merchant_category, 'unknown') AS merchant_category,
    coalesce(payer_country, 'unknown') AS payer_country,
    coalesce(payee_country, 'unknown') AS payee_country,
    coalesce(is_fraud, -1)::TINYINT AS is_fraud) FROM tx)"""
HIGH_RISK = "cash_out|withdrawal|cross_border|transfer|wire|ach"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build
    return register


def tx(spark: SparkSession, folder: str) -> DataFrame:
    return adapter.transactions(spark, folder)


def d(spark: SparkSession, folder: str) -> DataFrame:
    return default_fields(tx(spark, folder))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round measured columns, whose last digits depend on the order of addition."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def sql_hash(value: str, salt: str = "") -> str:
    text = f"'{salt}:' || {value}" if salt else value
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def sql_pick(hashed: str, choices) -> str:
    options = ", ".join(f"'{c}'" for c in choices)
    return f"list_extract([{options}], CAST({hashed} % {len(choices)} + 1 AS BIGINT))"


def sql_pct_rank(value: str, over: str = "") -> str:
    part = f"PARTITION BY {over}" if over else ""
    peers = f"PARTITION BY {over + ', ' if over else ''}{value}"
    return (f"((rank() OVER ({part} ORDER BY {value}) + (count(*) OVER ({peers}) - 1) / 2.0)"
            f" / count(*) OVER ({part}))")
