"""Lookups of dimension tables by transaction ids."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import schema as S

NULL_SPREAD = 1024


def spread_key(key: Column | str, row_id: Column | str) -> Column:
    """Join key in which missing values are spread over many keys that match nothing.

    A left join otherwise sends every row without a key to one task.
    """
    key = F.col(key) if isinstance(key, str) else key
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    slot = F.pmod(F.xxhash64(row_id), F.lit(NULL_SPREAD)).cast("string")
    return F.coalesce(key.cast("string"), F.concat(F.lit("\x00none:"), slot))


def lookup(fact: DataFrame, dim: DataFrame, key: str, dim_key: str,
           row_id: str = "transaction_id") -> DataFrame:
    """Left join on one id; the dimension's key column is dropped."""
    right = dim.withColumnRenamed(dim_key, "_dim_key")
    on = spread_key(F.col(key), F.col(row_id)) == F.col("_dim_key")
    return fact.join(right, on, "left").drop("_dim_key")


# Table, key in transactions, key in the profile.
PROFILE_JOINS = (
    ("user", "payer_id", "user_id"),
    ("device", "device_id", "device_id"),
    ("ip", "ip_id", "ip_id"),
    ("merchant", "merchant_id", "merchant_id"),
)


def enrich_profiles(tx: DataFrame, profiles: Mapping[str, DataFrame],
                    step: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Left joins of the four profiles; a name already present gets the profile's suffix.

    The table passes ``step`` after each join.
    """
    out = tx
    for kind, key, dim_key in PROFILE_JOINS:
        profile = profiles[kind]
        names = {}
        for name in profile.columns:
            if name == dim_key:
                continue
            new = f"{kind}_{name}" if name.endswith("_time") else name
            names[name] = f"{new}_{kind}" if new in out.columns else new
        dim = profile.select(
            F.col(dim_key).alias("_id"),
            *([F.col(dim_key)] if dim_key not in out.columns else []),
            *[F.col(old).alias(new) for old, new in names.items()],
        )
        out = step(lookup(out, dim, key, "_id"))
    return out


# Which entity features are attached under which prefix.
DEGREE_COLUMNS = ("graph_degree", "graph_fraud_edge_count", "graph_fraud_edge_ratio")


def graph_feature_plan(with_rings: bool) -> dict[str, tuple[str, ...]]:
    shared = ("graph_degree", *(("graph_mining_group_risk_score",) if with_rings else ()))
    return {
        "payer": (*DEGREE_COLUMNS, *(S.RING_FEATURE_COLUMNS if with_rings else ())),
        "payee": shared, "merchant": shared, "device": shared, "ip": shared,
    }


def attach_graph_features(tx: DataFrame, entities: DataFrame, with_rings: bool = False,
                          step: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Five left joins of one entity table under role prefixes; gaps become 0.

    The table passes ``step`` after each join.
    """
    out = tx
    for role, wanted in graph_feature_plan(with_rings).items():
        if f"{role}_id" not in tx.columns:
            for name in wanted:
                out = out.withColumn(f"{role}_{name}", F.lit(0.0))
            continue
        present = [c for c in wanted if c in entities.columns]
        dim = entities.select(F.col("entity_id").alias("_id"),
                              *[F.col(c).alias(f"{role}_{c}") for c in present])
        out = lookup(out, dim, f"{role}_id", "_id")
        fills = {}
        for name in wanted:
            column = f"{role}_{name}"
            value = F.col(column) if name in present else F.lit(None)
            if name == "fraud_group_mining_id":
                fills[column] = value.cast("string")
            else:
                fills[column] = F.coalesce(value.try_cast("double"), F.lit(0.0))
        out = step(out.withColumns(fills))
    return out


def outer_feature_merge(degrees: DataFrame, rings: DataFrame) -> DataFrame:
    """Degree and ring features of every entity known to either table; gaps become 0."""
    merged = degrees.join(rings, "entity_id", "full_outer")
    numbers = [c for c in (*DEGREE_COLUMNS, *S.RING_FEATURE_COLUMNS)
               if c != "fraud_group_mining_id"]
    return merged.select(
        "entity_id", "fraud_group_mining_id",
        *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in numbers],
    )


def alert_account_flag(tx: DataFrame, alerts: DataFrame, keys: Sequence[str],
                       account: str = "account_id", out: str = "is_alert") -> DataFrame:
    """1 where any of ``keys`` is an alert account."""
    accounts = alerts.select(F.col(account).cast("string").alias("_account")).distinct()
    hit = F.lit(False)
    for i, key in enumerate(keys):
        dim = accounts.select(F.col("_account").alias(f"_a{i}"), F.lit(True).alias(f"_hit{i}"))
        tx = tx.join(dim, spread_key(F.col(key), F.col(key)) == F.col(f"_a{i}"), "left")
        hit = hit | F.coalesce(F.col(f"_hit{i}"), F.lit(False))
    drop = [f"_{part}{i}" for i in range(len(keys)) for part in ("a", "hit")]
    return tx.withColumn(out, hit.cast("tinyint")).drop(*drop)


def payee_is_payer(tx: DataFrame) -> DataFrame:
    payers = tx.where(F.col("payer_id").isNotNull()).select(F.col("payer_id").alias("_p")).distinct()
    return tx.join(payers, F.col("payee_id") == F.col("_p"), "left_semi")


def resource_membership(tx: DataFrame, candidates: DataFrame, resource_col: str) -> DataFrame:
    """Transactions that touch a candidate resource of one kind."""
    ids = (candidates.where(F.col("resource_col") == resource_col)
           .select(F.col("entity_id").alias("_r")).distinct())
    kept = tx.where(F.col("payer_id").isNotNull())
    return kept.join(ids, F.col(resource_col) == F.col("_r"), "left_semi")


def missing_keys(fact: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """One row: how many fact rows have a key that ``dim`` does not know.

    Keys are counted first, so a key shared by many rows is joined once.
    """
    keys = (fact.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("_k"))
            .agg(F.count(F.lit(1)).alias("_rows")))
    known = dim.select(F.col(dim_key).cast("string").alias("_d")).distinct()
    return (keys.join(known, F.col("_k") == F.col("_d"), "left_anti")
            .agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("missing")))


def node_timestamp_lookup(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the time of their source node."""
    times = nodes.select(F.col("node_id").alias("_n"), F.col("timestamp").alias("_ts"))
    kept = [c for c in edges.columns if c != "timestamp"]
    return (edges.join(times, F.col("src_id") == F.col("_n"), "left")
            .select(*kept, F.col("_ts").alias("timestamp")))


def sent_received_join(sent: DataFrame, received: DataFrame, key: str = "transaction_id",
                       sent_at: str = "sent_at", received_at: str = "received_at") -> DataFrame:
    """Latency in seconds of every event that came back."""
    return (sent.select(key, sent_at).join(received.select(key, received_at), key, "inner")
            .withColumn("latency_sec", F.col(received_at) - F.col(sent_at)))
