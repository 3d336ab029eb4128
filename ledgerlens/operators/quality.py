"""Data-quality checks; each returns rows of (name, ok, detail)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.joins import missing_keys

# Columns and keys that must be present.
TRANSACTION_COLUMNS = (
    "transaction_id", "source", "timestamp", "amount", "currency", "txn_type", "channel",
    "payment_method", "payer_id", "payee_id", "merchant_id", "device_id", "ip_id", "is_fraud",
    "fraud_type", "risk_level", "rule_score", "split",
)
EDGE_COLUMNS = (
    "src_id", "dst_id", "src_type", "dst_type", "edge_type", "weight", "timestamp", "source",
    "label",
)
STREAM_KEYS = ("transaction_id", "source", "payer_id", "payee_id", "amount", "txn_type",
               "risk_level")


def _rows(one: DataFrame, checks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """A one-row table of measures as one row per check."""
    entries = F.array(*[F.struct(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"),
                                 detail.cast("string").alias("detail"))
                        for name, (ok, detail) in checks.items()])
    return one.select(F.explode(entries).alias("_c")).select("_c.*")


def required_columns(df: DataFrame, required: Sequence[str], name: str) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    return df.sparkSession.createDataFrame(
        [(name, not missing, ",".join(missing))], "name string, ok boolean, detail string")


def dq_transactions(tx: DataFrame, expected_rows: int | None = None, min_sources: int = 6) -> DataFrame:
    label = F.col("is_fraud").try_cast("int")
    ids = tx.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("transaction_id").alias("unique_ids"))
    one = tx.agg(
        F.count_if(F.col("timestamp").isNull()).alias("null_times"),
        F.count_if(label.isNotNull() & ~label.isin(-1, 0, 1)).alias("bad_labels"),
        F.count_if(~F.coalesce(F.col("amount") >= 0, F.lit(False))).alias("negative"),
        F.countDistinct("source").alias("sources"))
    n = lambda c: F.col(c)
    checks = {
        "timestamp_not_null": (n("null_times") == 0, n("null_times")),
        "is_fraud_values": (n("bad_labels") == 0, n("bad_labels")),
        "amount_non_negative": (n("negative") == 0, n("negative")),
        "transaction_sources_present": (n("sources") >= min_sources, n("sources")),
    }
    unique = {"transaction_id_unique": (n("rows") == n("unique_ids"), n("rows") - n("unique_ids"))}
    if expected_rows is not None:
        unique["manifest_transaction_count"] = (n("rows") == expected_rows, n("rows"))
    return (required_columns(tx, TRANSACTION_COLUMNS, "transaction_required_columns")
            .unionByName(_rows(ids, unique)).unionByName(_rows(one, checks)))


def dq_splits(parts: DataFrame, log_rows: DataFrame | None = None) -> DataFrame:
    """``parts`` carries the row's own ``split`` and, in ``part``, the table it was found in."""
    m = lambda part, value, fn: fn(F.when(F.col("part") == part, value))
    ts = F.col("timestamp")
    bad = {p: F.count_if((F.col("part") == p) & ~F.col("split").eqNullSafe(p)).alias(f"bad_{p}")
           for p in ("train", "valid", "test", "unlabeled")}
    one = parts.agg(
        *bad.values(), F.count(F.lit(1)).alias("total"),
        m("train", ts, F.max).alias("train_max"), m("valid", ts, F.min).alias("valid_min"),
        m("valid", ts, F.max).alias("valid_max"), m("test", ts, F.min).alias("test_min"),
        F.count_if((F.col("part") == "unlabeled") & (F.col("is_fraud") != -1)).alias("labelled"))
    n = lambda c: F.col(c)
    checks = {f"split_column:{p}": (n(f"bad_{p}") == 0, n(f"bad_{p}")) for p in bad}
    if log_rows is not None:
        total = log_rows.agg(F.count(F.lit(1)).alias("n")).scalar()
        checks["split_total_matches_transaction_log"] = (n("total") == total, n("total"))
    ordered = (n("train_max") <= n("valid_min")) & (n("valid_max") <= n("test_min"))
    checks["labeled_time_order"] = (ordered, F.lit(""))
    checks["unlabeled_labels"] = (n("labelled") == 0, n("labelled"))
    return _rows(one, checks)


def coverage_check(fact: DataFrame, pairs: Sequence[tuple[str, str, DataFrame, str]]) -> DataFrame:
    """(check, missing rows) for (name, fact key, dimension, dimension key)."""
    parts = [missing_keys(fact, key, dim, dim_key).select(F.lit(name).alias("name"), "missing")
             for name, key, dim, dim_key in pairs]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _as_checks(coverage: DataFrame) -> DataFrame:
    return coverage.select("name", (F.col("missing") == 0).alias("ok"),
                           F.col("missing").cast("string").alias("detail"))


def dq_profiles(tx: DataFrame, profiles: Mapping[str, DataFrame]) -> DataFrame:
    pairs = [
        ("payer_profile_coverage", "payer_id", profiles["user"], "user_id"),
        ("merchant_profile_coverage", "merchant_id", profiles["merchant"], "merchant_id"),
        ("device_profile_coverage", "device_id", profiles["device"], "device_id"),
        ("ip_profile_coverage", "ip_id", profiles["ip"], "ip_id"),
    ]
    return _as_checks(coverage_check(tx, pairs))


def dq_graph(nodes: DataFrame, edges: DataFrame, expected_nodes: int | None = None,
             expected_edges: int | None = None, min_edge_types: int = 5) -> DataFrame:
    unique = nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("node_id").alias("ids"))
    shape = edges.agg(F.countDistinct("edge_type").alias("types"), F.count(F.lit(1)).alias("rows"))
    n = F.col
    node_checks = {"graph_node_id_unique": (n("rows") == n("ids"), n("rows") - n("ids"))}
    edge_checks = {"graph_edge_types_present": (n("types") >= min_edge_types, n("types"))}
    if expected_nodes is not None:
        node_checks["manifest_graph_nodes"] = (n("rows") == expected_nodes, n("rows"))
    if expected_edges is not None:
        edge_checks["manifest_graph_edges"] = (n("rows") == expected_edges, n("rows"))
    coverage = coverage_check(edges, [("graph_edge_src_coverage", "src_id", nodes, "node_id"),
                                      ("graph_edge_dst_coverage", "dst_id", nodes, "node_id")])
    return (required_columns(edges, EDGE_COLUMNS, "graph_edge_required_columns")
            .unionByName(_rows(unique, node_checks)).unionByName(_rows(shape, edge_checks))
            .unionByName(_as_checks(coverage)))


def dq_stream(lines: DataFrame, value: str = "value") -> DataFrame:
    """Whether all JSON lines parse and have the required keys."""
    keys = F.json_object_keys(value)
    good = F.size(F.array_intersect(keys, F.array(*map(F.lit, STREAM_KEYS)))) == len(STREAM_KEYS)
    parsed = F.try_parse_json(value).isNotNull()
    one = lines.agg(F.count(F.lit(1)).alias("rows"),
                   F.count_if(~(parsed & F.coalesce(good, F.lit(False)))).alias("bad"))
    return _rows(one, {"transaction_stream_jsonl_sample":
                       ((F.col("rows") > 0) & (F.col("bad") == 0), F.col("bad"))})


def dq_manifest_counts(tables: Mapping[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """Recorded (table, rows) against the tables' row counts."""
    counted = reduce(lambda a, b: a.unionByName(b), [
        df.agg(F.count(F.lit(1)).alias("actual")).select(F.lit(name).alias("table"), "actual")
        for name, df in tables.items()])
    return manifest.join(counted, "table", "left").select(
        F.concat(F.lit("manifest_count:"), F.col("table")).alias("name"),
        F.coalesce(F.col("rows") == F.col("actual"), F.lit(False)).alias("ok"),
        F.col("actual").cast("string").alias("detail"))


def dq_report(parts: Sequence[DataFrame]) -> DataFrame:
    """All checks in one row: verdict, counts and the names that failed."""
    every = reduce(lambda a, b: a.unionByName(b), parts)
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name"))))
    return every.agg(F.min("ok").alias("ok"), F.count(F.lit(1)).alias("checks"),
                     F.count_if(~F.col("ok")).alias("failed"),
                     F.array_join(failed, ",").alias("failed_checks"))
