"""Column lists, types and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of the columns in each table, in table order.
CORE_COLUMNS = (
    "transaction_id", "source", "timestamp", "amount", "currency", "txn_type", "payer_id",
    "payee_id", "merchant_id", "merchant_category", "payer_country", "payee_country",
    "is_fraud", "fraud_subtype",
)
LOG_COLUMNS = (
    "row_id", "transaction_id", "source", "timestamp", "event_type", "amount", "amount_bucket",
    "currency", "txn_type", "channel", "payment_method", "payer_id", "payee_id", "merchant_id",
    "merchant_category", "device_id", "ip_id", "payer_country", "payee_country", "is_fraud",
    "fraud_type", "risk_level", "rule_score", "label_quality", "split", "hour", "day_of_week",
    "is_weekend", "is_night",
)
AUGMENTED_COLUMNS = (
    "is_injected", "fraud_group_id", "injection_scenario", "scenario_step", "injection_evidence",
)
STREAM_COLUMNS = (
    "timestamp", "transaction_id", "source", "payer_id", "payee_id", "merchant_id", "amount",
    "currency", "txn_type", "channel", "payment_method", "device_id", "ip_id", "is_fraud",
    "fraud_type", "risk_level", "rule_score",
)
EDGE_COLUMNS = (
    "src_id", "dst_id", "src_type", "dst_type", "edge_type", "weight", "timestamp", "source",
    "label",
)
NODE_COLUMNS = (
    "node_id", "node_type", "source", "label", "raw_label", "time_step", "timestamp",
)
RING_FEATURE_COLUMNS = (
    "fraud_group_mining_id", "graph_mining_group_risk_score", "graph_mining_group_entity_count",
    "graph_mining_group_user_count", "graph_mining_group_resource_count",
    "graph_mining_fraud_seed_count", "graph_mining_fraud_seed_ratio",
    "graph_mining_shared_device_count", "graph_mining_shared_ip_count",
    "graph_mining_shared_merchant_count", "graph_mining_shared_payee_count",
    "graph_mining_evidence_count", "graph_mining_scenario_count",
)
SPLITS = ("train", "valid", "test", "unlabeled")

# The 90-day window all sources are stretched onto.
WINDOW_START = "2026-01-01 00:00:00"
WINDOW_END = "2026-03-31 23:59:59"
WINDOW_SECONDS = 7775999

# Choices picked by hash.
CHANNELS = {
    "paysim": ("app", "web", "mini_program"),
    "banksim": ("pos", "qr_code", "app"),
    "ieee_cis": ("web", "app", "api"),
    "creditcard": ("pos", "web", "app"),
    "saml_d": ("bank_api", "web", "branch"),
    "amlsim_sample": ("core_banking", "branch", "batch"),
}
DEVICE_TYPES = ("mobile", "desktop", "tablet", "pos_terminal")
OS_TYPES = ("Android", "iOS", "Windows", "macOS", "Linux", "POS")
BROWSERS = ("Chrome", "Safari", "Edge", "Firefox", "WeChat WebView", "Bank Client")
ISPS = ("mobile", "telecom", "unicom", "cloud", "bank_network", "unknown")
CITY_BY_COUNTRY = {
    "SG": "Singapore", "ES": "Madrid", "EU": "Paris", "US": "New York", "UK": "London",
    "UAE": "Dubai", "unknown": "Unknown",
}

CORE_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("txn_type", T.StringType()),
    T.StructField("payer_id", T.StringType()),
    T.StructField("payee_id", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("payer_country", T.StringType()),
    T.StructField("payee_country", T.StringType()),
    T.StructField("is_fraud", T.ByteType()),
    T.StructField("fraud_subtype", T.StringType()),
])

STREAM_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("payer_id", T.StringType()),
    T.StructField("payee_id", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("txn_type", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("ip_id", T.StringType()),
    T.StructField("is_fraud", T.ByteType()),
    T.StructField("fraud_type", T.StringType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("rule_score", T.DoubleType()),
])
