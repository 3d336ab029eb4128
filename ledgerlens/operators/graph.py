"""Edges and nodes of the transaction graph, and features of its nodes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.operators.merge import dedupe_priority

# Edge sets in the order in which they are put together.
EDGE_ORDER = (
    "make_transaction", "transfer_to", "uses_device", "login_ip", "paid_to_merchant",
    "banksim_payment_network", "amlsim_transfer", "elliptic_money_flow", "dgraph_relation",
)
NODE_KINDS = ("user", "transaction", "merchant", "device", "ip")
NODE_TYPES = (
    "account", "crypto_transaction", "device", "fraud_group", "ip", "merchant", "transaction",
    "user",
)


def _edge(src: str, dst: str, src_type: str, dst_type: str, edge_type: Column | str,
          weight: Column, when: Column | None = None) -> Column:
    kind = F.lit(edge_type) if isinstance(edge_type, str) else edge_type
    target = F.col(dst).cast("string")
    return F.struct(
        F.col(src).cast("string").alias("src_id"),
        (target if when is None else F.when(when, target)).alias("dst_id"),
        F.lit(src_type).alias("src_type"), F.lit(dst_type).alias("dst_type"),
        kind.alias("edge_type"), weight.cast("double").alias("weight"),
    )


def _explode_edges(tx: DataFrame, edges: Sequence[Column], source: str, label: Column) -> DataFrame:
    every = F.filter(F.array(*edges), lambda e: e["src_id"].isNotNull() & e["dst_id"].isNotNull())
    return (tx.select("timestamp", label.cast("tinyint").alias("label"), F.explode(every).alias("_e"))
            .select("_e.*", "timestamp", F.lit(source).alias("source"), "label")
            .select(*S.EDGE_COLUMNS))


def _payment_edges() -> list[Column]:
    one = F.lit(1.0)
    return [
        _edge("payer_id", "transaction_id", "user", "transaction", "make_transaction", one),
        _edge("transaction_id", "payee_id", "transaction", "account", "transfer_to", F.col("amount")),
        _edge("payer_id", "device_id", "user", "device", "uses_device", one),
        _edge("payer_id", "ip_id", "user", "ip", "login_ip", one),
        _edge("transaction_id", "merchant_id", "transaction", "merchant", "paid_to_merchant",
              F.col("amount")),
    ]


def tx_edges(tx: DataFrame) -> DataFrame:
    """Four or five edges per transaction from one scan; an unlabelled row counts as normal."""
    return _explode_edges(tx, _payment_edges(), "transaction_log",
                          F.greatest(F.col("is_fraud"), F.lit(0)))


def augmented_edges(injected: DataFrame) -> DataFrame:
    """Edges of injected rows: payment edges, direct transfers and group membership."""
    one = F.lit(1.0)
    direct = F.col("payee_id").isNotNull() & (F.col("payee_id") != "") & (
        F.col("merchant_id").isNull() | (F.col("merchant_id") == ""))
    edges = [
        *_payment_edges(),
        _edge("payer_id", "payee_id", "user", "user",
              F.concat(F.col("fraud_type"), F.lit("_transfer")), F.col("amount"), direct),
        _edge("payer_id", "fraud_group_id", "user", "fraud_group", "member_of_fraud_group", one),
        _edge("device_id", "fraud_group_id", "device", "fraud_group",
              "device_used_by_fraud_group", one),
        _edge("ip_id", "fraud_group_id", "ip", "fraud_group", "ip_used_by_fraud_group", one),
        _edge("merchant_id", "fraud_group_id", "merchant", "fraud_group",
              "merchant_used_by_fraud_group", one),
    ]
    return _explode_edges(injected, edges, "fraud_injection", F.lit(1))


def transfer_edges(tx: DataFrame, edge_type: str = "amlsim_transfer",
                   source: str = "amlsim_sample") -> DataFrame:
    """One payer to payee edge per row, with the row's own label."""
    edge = _edge("payer_id", "payee_id", "user", "account", edge_type, F.col("amount"))
    return _explode_edges(tx, [edge], source, F.col("is_fraud"))


def graph_union(parts: Sequence[DataFrame]) -> DataFrame:
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    subtype = F.col("edge_subtype") if "edge_subtype" in out.columns else F.lit(None)
    return out.withColumn("edge_subtype", subtype.cast("smallint"))


def _node(kind: str, id_: Column, label: int, raw_label: Column, time: Column, source: str,
          rank: int) -> Column:
    return F.struct(
        id_.cast("string").alias("node_id"), F.lit(kind).alias("node_type"),
        F.lit(source).alias("source"), F.lit(label).cast("tinyint").alias("label"),
        raw_label.alias("raw_label"), F.lit(None).cast("smallint").alias("time_step"),
        time.cast("timestamp_ntz").alias("timestamp"), F.lit(rank).alias("_rank"),
    )


def entity_nodes(tx: DataFrame, source: str = "unified") -> DataFrame:
    """(id, kind) once each; ``_rank`` is the kind's place, for choosing the first kind of an id."""
    raw, none = F.lit("entity"), F.lit(None)
    user_payee = F.when(F.col("merchant_id").isNull(), F.col("payee_id"))
    ids = [("user", F.col("payer_id")), ("user", user_payee),
           ("transaction", F.col("transaction_id")), ("merchant", F.col("merchant_id")),
           ("device", F.col("device_id")), ("ip", F.col("ip_id"))]
    nodes = F.array(*[_node(kind, id_, -1, raw, none, source, NODE_KINDS.index(kind))
                      for kind, id_ in ids])
    return (tx.select(F.explode(nodes).alias("_n")).select("_n.*")
            .where(F.col("node_id").isNotNull()).distinct())


def edge_rank(edge_type: Column | str = "edge_type") -> Column:
    kind = F.col(edge_type) if isinstance(edge_type, str) else edge_type
    place = F.array_position(F.array(*[F.lit(n) for n in EDGE_ORDER]), kind)
    return F.when(place > 0, place - 1).otherwise(len(EDGE_ORDER)).cast("int")


def endpoint_nodes(edges: DataFrame) -> DataFrame:
    """First-seen type and source of every endpoint: source side first, then edge-set order."""
    side = lambda i, end: F.struct(
        F.lit(i).alias("side"), edge_rank().alias("rank"), F.col("edge_type"),
        F.col(f"{end}_type").alias("node_type"), F.col("source"))
    ends = F.array(
        F.struct(F.col("src_id").alias("node_id"), side(0, "src").alias("seen")),
        F.struct(F.col("dst_id").alias("node_id"), side(1, "dst").alias("seen")))
    first = (edges.select(F.explode(ends).alias("_e")).select("_e.*")
             .where(F.col("node_id").isNotNull()).groupBy("node_id").agg(F.min("seen").alias("_s")))
    return first.select(
        "node_id", F.col("_s.node_type").alias("node_type"), F.col("_s.source").alias("source"),
        F.lit(-1).cast("tinyint").alias("label"), F.lit("edge_endpoint").alias("raw_label"),
        F.lit(None).cast("smallint").alias("time_step"),
        F.lit(None).cast("timestamp_ntz").alias("timestamp"))


def explicit_nodes(injected: DataFrame) -> DataFrame:
    """Nodes of injected rows, one per id: the first row in time that names it.

    ``_rank`` keeps the place inside the row: transaction, group, payer, payee, merchant,
    device, ip.
    """
    raw, time = F.col("fraud_type"), F.col("timestamp")
    other_payee = F.when(~F.col("payee_id").eqNullSafe(F.col("merchant_id")), F.col("payee_id"))
    ids = [("transaction", F.col("transaction_id")), ("fraud_group", F.col("fraud_group_id")),
           ("user", F.col("payer_id")), ("user", other_payee),
           ("merchant", F.col("merchant_id")), ("device", F.col("device_id")),
           ("ip", F.col("ip_id"))]
    nodes = F.array(*[_node(kind, id_, 1, raw, time, "fraud_injection", i)
                      for i, (kind, id_) in enumerate(ids)])
    seen = F.struct(F.col("timestamp").alias("t"), F.col("transaction_id").alias("x"),
                    F.col("_n._rank").alias("r"))
    return (injected.select("timestamp", "transaction_id", F.explode(nodes).alias("_n"))
            .where(F.col("_n.node_id").isNotNull() & (F.col("_n.node_id") != ""))
            .groupBy(F.col("_n.node_id").alias("_id")).agg(F.min_by("_n", seen).alias("_n"))
            .select("_n.*"))


def graph_nodes(parts: Sequence[DataFrame]) -> DataFrame:
    """All node tables, one row per id: earlier tables win, then the earlier kind."""
    ranked = [p if "_rank" in p.columns else p.withColumn("_rank", F.lit(0)) for p in parts]
    return dedupe_priority(ranked, "node_id", ["_rank", "node_type"]).select(*S.NODE_COLUMNS)


def node_features(edges: DataFrame, types: Sequence[str] = NODE_TYPES) -> DataFrame:
    """One-hot type, log degree and relative degree of every endpoint, and its fraud label."""
    side = lambda i, end: F.struct(
        F.lit(i).alias("side"), edge_rank().alias("rank"), F.col(f"{end}_type").alias("kind"))
    ends = F.array(
        F.struct(F.col("src_id").alias("node_id"), side(0, "src").alias("seen")),
        F.struct(F.col("dst_id").alias("node_id"), side(1, "dst").alias("seen")))
    nodes = (edges.select("label", F.explode(ends).alias("_e")).select("label", "_e.*")
             .groupBy("node_id").agg(
                 F.max("seen").alias("_seen"), F.count(F.lit(1)).alias("degree"),
                 F.max(F.when(F.col("label") == 1, 1).otherwise(0)).alias("node_label")))
    top = nodes.agg(F.max("degree").alias("m")).scalar()
    return nodes.select(
        "node_id", F.col("_seen.kind").alias("node_type"), "degree",
        *[F.when(F.col("_seen.kind") == t, 1.0).otherwise(0.0).alias(f"type_{t}") for t in types],
        F.log1p(F.col("degree").cast("double")).alias("log_degree"),
        (F.col("degree") / F.greatest(top.cast("double"), F.lit(1.0))).alias("relative_degree"),
        "node_label")


def feature_names(types: Sequence[str] = NODE_TYPES) -> list[str]:
    return [*[f"type_{t}" for t in types], "log_degree", "relative_degree"]


def neighbor_mean(nodes: DataFrame, edges: DataFrame, columns: Sequence[str],
                  prefix: str = "nbr_") -> DataFrame:
    """Mean of the neighbours' features next to the node's own (one propagation hop)."""
    both = F.array(
        F.struct(F.col("src_id").alias("_node"), F.col("dst_id").alias("_other")),
        F.struct(F.col("dst_id").alias("_node"), F.col("src_id").alias("_other")))
    pairs = edges.select(F.explode(both).alias("_p")).select("_p.*")
    # Parallel edges between two nodes weigh as often as they occur, but travel as one row.
    pairs = pairs.groupBy("_node", "_other").agg(F.count(F.lit(1)).alias("_times"))
    values = nodes.select(F.col("node_id").alias("_id"), *columns)
    means = (pairs.join(values, F.col("_other") == F.col("_id"), "inner").groupBy("_node").agg(*[
        (F.sum(F.col(c) * F.col("_times")) / F.sum("_times")).alias(f"{prefix}{c}")
        for c in columns]))
    joined = nodes.join(means, F.col("node_id") == F.col("_node"), "left").drop("_node")
    return joined.withColumns({f"{prefix}{c}": F.coalesce(F.col(f"{prefix}{c}"), F.lit(0.0))
                               for c in columns})
