"""Row-wise derivations of the transaction log and of scored events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import schema as S
from ledgerlens.functions.hashing import choose_by_hash, id_by_hash, stable_hash
from ledgerlens.functions.scalar import (
    _c, add_seconds, clip01, epoch_micros, first_reasons, flag, number_or,
    round_half_even,
)
from ledgerlens.operators.ordering import pct_rank_avg, running_position
from ledgerlens.session import cut

# Text patterns of the rules.
PAYMENT_PATTERNS = (  # the last pattern that matches decides
    ("card|product|w|c|h|r", "card"),
    ("cash|withdrawal|deposit", "cash"),
    ("cross_border|transfer|wire|ach", "bank_transfer"),
    ("payment|online|topup|top_up", "wallet"),
)
HIGH_RISK_PATTERN = "cash_out|withdrawal|cross_border|transfer|wire|ach"
LAUNDERING_PATTERN = "transfer|cross_border|wire|ach"
FRAUD_NAME_BY_SOURCE = {
    "creditcard": "card_fraud",
    "ieee_cis": "ecommerce_fraud",
    "banksim": "merchant_fraud",
    "paysim": "payment_fraud",
    "amlsim_sample": "amlsim_alert",
}


def with_columns(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(columns))


# ---------------------------------------------------------------- transaction log
def default_fields(df: DataFrame) -> DataFrame:
    """Null handling of the core columns."""
    unknown = lambda part: F.concat(F.col("source"), F.lit(f":unknown_{part}"))
    text = lambda name, default: F.coalesce(F.col(name).cast("string"), default)
    return df.withColumns({
        "currency": text("currency", F.lit("UNKNOWN")),
        "txn_type": F.lower(text("txn_type", F.lit("unknown"))),
        "amount": F.greatest(number_or("amount"), F.lit(0.0)),
        "payer_id": text("payer_id", unknown("payer")),
        "payee_id": text("payee_id", unknown("payee")),
        "merchant_category": text("merchant_category", F.lit("unknown")),
        "payer_country": text("payer_country", F.lit("unknown")),
        "payee_country": text("payee_country", F.lit("unknown")),
        "is_fraud": number_or("is_fraud", -1).cast("tinyint"),
    })


def rescale_time(df: DataFrame, order: Sequence[str] = ("transaction_id",)) -> DataFrame:
    """Stretch each source's timestamps onto the 90-day window, in whole seconds.

    A missing time counts as the source's first; a source with one single time is spread by
    position in ``order``; a source without any time starts at the window start.
    """
    micros = epoch_micros("timestamp")
    spans = cut(df.groupBy(F.col("source").alias("_source")).agg(
        F.min(micros).alias("_first"), F.max(micros).alias("_last"),
        F.count(F.lit(1)).alias("_rows")), "spans")
    flat = F.col("_first").isNotNull() & (F.col("_first") == F.col("_last"))
    joined = df.join(spans, F.col("source").eqNullSafe(F.col("_source")), "left")
    offset = F.coalesce(micros, F.col("_first")) - F.col("_first")
    share = F.coalesce((offset / 1e6) / ((F.col("_last") - F.col("_first")) / 1e6), F.lit(0.0))
    if spans.where(flat).isEmpty():
        shared = joined.withColumn("_share", share)
    else:
        spread = running_position(joined.where(flat), order, ["source"], out="_place").withColumn(
            "_share", F.col("_place") / F.greatest(F.col("_rows") - 1, F.lit(1)))
        moving = joined.where(~F.coalesce(flat, F.lit(False))).withColumn("_share", share)
        shared = spread.select(*df.columns, "_share").unionByName(
            moving.select(*df.columns, "_share"))
    seconds = round_half_even(F.col("_share") * S.WINDOW_SECONDS, 0).cast("bigint")
    return (shared.withColumn("timestamp", add_seconds(F.lit(S.WINDOW_START), seconds))
            .select(*df.columns))


def payment_method(txn_type: Column | str) -> Column:
    text = F.lower(_c(txn_type).cast("string"))
    chosen: Column | None = None
    for pattern, name in reversed(PAYMENT_PATTERNS):
        chosen = F.when(text.rlike(pattern), name) if chosen is None else \
            chosen.when(text.rlike(pattern), name)
    return chosen.otherwise("balance")


def calendar_fields(df: DataFrame, time: str = "timestamp") -> DataFrame:
    hour, day = F.hour(time), F.weekday(time)
    return df.withColumns({
        "hour": hour.cast("tinyint"),
        "day_of_week": day.cast("tinyint"),
        "is_weekend": flag(day.isin(5, 6)),
        "is_night": flag(hour.between(0, 5)),
    })


def label_quality(label: Column | str = "is_fraud") -> Column:
    return (F.when(_c(label) == 1, "labeled_fraud").when(_c(label) == 0, "labeled_normal")
            .otherwise("unlabeled"))


def hashed_fields(df: DataFrame) -> DataFrame:
    """Channel, device and ip derived by hash of the row's ids."""
    channel = F.lit(None).cast("string")
    for source, options in S.CHANNELS.items():
        channel = F.when(F.col("source") == source,
                         choose_by_hash("transaction_id", options, "channel")).otherwise(channel)
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    return df.withColumns({
        "channel": channel,
        "device_id": id_by_hash(F.concat("payer_id", "transaction_id"), "D_", 280_000, "device"),
        "ip_id": id_by_hash(F.concat(F.col("payer_id"), stamp), "IP_", 180_000, "ip"),
    })


def common_fields(df: DataFrame, assign_ids: bool = True) -> DataFrame:
    """All per-row fields of the log except the risk rules; ``assign_ids`` hashes device and ip."""
    out = default_fields(rescale_time(df))
    if assign_ids:
        out = hashed_fields(out)
    out = out.withColumns({
        "payment_method": payment_method("txn_type"),
        "event_type": F.lit("transaction"),
        "label_quality": label_quality(),
    })
    return calendar_fields(out)


def cross_country(payer: Column | str = "payer_country", payee: Column | str = "payee_country") -> Column:
    return flag(_c(payer).cast("string") != _c(payee).cast("string"))


def high_risk_type(txn_type: Column | str = "txn_type") -> Column:
    return flag(_c(txn_type).rlike(HIGH_RISK_PATTERN))


def infer_fraud_type() -> Column:
    """Fraud name from label, source, subtype and type; transfers read as laundering."""
    fraud = F.col("is_fraud") == 1
    source = F.col("source")
    named = F.when(source == "saml_d", F.regexp_replace(
        F.lower(F.coalesce(F.col("fraud_subtype"), F.lit(""))), r"\s+", "_"))
    for key, name in FRAUD_NAME_BY_SOURCE.items():
        named = named.when(source == key, name)
    named = named.otherwise("normal")
    moved = fraud & F.coalesce(F.col("txn_type").rlike(LAUNDERING_PATTERN), F.lit(False))
    return (F.when(moved & named.isin("payment_fraud", "normal"), "money_laundering")
            .when(fraud, named)
            .when(F.col("is_fraud") < 0, "unknown")
            .otherwise("normal"))


def rule_score(df: DataFrame) -> DataFrame:
    ranked = pct_rank_avg(df, "amount", "_amount_rank", ["source"])
    score = (F.lit(0.45) * F.col("_amount_rank")
             + F.lit(0.20) * F.col("is_night").cast("double")
             + F.lit(0.20) * cross_country().cast("double")
             + F.lit(0.15) * high_risk_type().cast("double"))
    return ranked.withColumn("rule_score", round_half_even(clip01(score), 4)).drop("_amount_rank")


def risk_level_rule(label: Column | str = "is_fraud", score: Column | str = "rule_score") -> Column:
    return (F.when(_c(label) == 1, "high").when(_c(label) < 0, "unknown")
            .when(_c(score) >= 0.70, "high").when(_c(score) >= 0.35, "medium").otherwise("low"))


def risk_fields(df: DataFrame) -> DataFrame:
    return rule_score(df).withColumns({
        "fraud_type": infer_fraud_type(), "risk_level": risk_level_rule(),
    })


def amount_bucket(amount: Column | str = "amount") -> Column:
    """Right-closed bins: the edge belongs to the lower bin."""
    a = _c(amount)
    return (F.when(a <= 10, "micro").when(a <= 100, "small").when(a <= 1000, "medium")
            .when(a <= 10000, "large").otherwise("xlarge"))


def amount_bucket_left(amount: Column | str = "amount") -> Column:
    """Left-closed bins: the edge belongs to the upper bin."""
    a = _c(amount)
    return (F.when(a < 10, "micro").when(a < 100, "small").when(a < 1000, "medium")
            .when(a < 10000, "large").otherwise("xlarge"))


def project_log_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("amount_bucket", amount_bucket()).select(*S.LOG_COLUMNS)


def split_by_bound(df: DataFrame, log: DataFrame, time: str = "timestamp") -> DataFrame:
    """Assign ``split`` by comparing with the last train and valid times of ``log``."""
    bounds = log.agg(
        F.max(F.when(F.col("split") == "train", F.col("timestamp"))).alias("train_end"),
        F.max(F.when(F.col("split") == "valid", F.col("timestamp"))).alias("valid_end"),
    )
    train_end = bounds.select("train_end").scalar()
    valid_end = bounds.select("valid_end").scalar()
    return df.withColumn("split", F.when(F.col(time) <= train_end, "train")
                         .when(F.col(time) <= valid_end, "valid").otherwise("test"))


def account_age(user: Column | str) -> Column:
    return (stable_hash(user, "account_age") % 1800 + 1).cast("int")


def labelled_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_fraud").isin(0, 1))


# ---------------------------------------------------------------- times as text
def ts_coerce(value: Column | str, ingest_ts: Column | str) -> Column:
    """Epoch seconds of a text time (ISO with or without zone, or plain); else of ``ingest_ts``.

    Text without a zone counts as UTC.
    """
    text = F.regexp_replace(_c(value).cast("string"), "Z$", "+00:00")
    zoned = text.rlike(r"[+-]\d\d:?\d\d$")
    with_zone = F.when(zoned, text.try_cast("timestamp"))
    plain = F.when(~zoned, F.concat(F.regexp_replace(text, "T", " "), F.lit("+00:00"))
                   .try_cast("timestamp"))
    micros = F.coalesce(F.unix_micros(with_zone), F.unix_micros(plain), epoch_micros(ingest_ts))
    return micros / 1e6


# ---------------------------------------------------------------- events and features
# How the keys of nested profiles are named in training tables.
RENAMED_KEYS = {
    "device_profile": ("device", ("txn_count", "fraud_txn_count", "observed_fraud_rate")),
    "ip_profile": ("ip", ("bind_user_count", "txn_count", "fraud_txn_count",
                          "observed_fraud_rate")),
    "merchant_profile": ("merchant", ("merchant_category", "total_amount", "avg_amount",
                                      "fraud_txn_count", "observed_fraud_rate", "txn_count")),
}
SEEN_TIMES = ("first_seen_time", "last_seen_time")


def flat_name(parent: str, key: str) -> str:
    """Training-table name of ``key`` inside the nested column ``parent``."""
    if parent in ("user_profile", "graph_features"):
        return key
    if parent in RENAMED_KEYS:
        short, suffixed = RENAMED_KEYS[parent]
        if key in suffixed:
            return f"{key}_{short}"
        return f"{short}_{key}" if key in SEEN_TIMES else key
    return f"{parent}_{key}"


def flat_columns(df: DataFrame, json_columns: Mapping[str, T.StructType] | None = None) -> dict[str, Column]:
    """Training name and expression of every column of ``df`` and of its nested columns; see ``flatten_event``."""
    json_columns = json_columns or {}
    flat: dict[str, Column] = {}
    for item in df.schema.fields:
        if isinstance(item.dataType, T.StructType):
            for sub in item.dataType.fieldNames():
                flat[flat_name(item.name, sub)] = F.col(item.name)[sub]
        elif item.name in json_columns and isinstance(item.dataType, T.StringType):
            decoded = F.from_json(item.name, json_columns[item.name])
            for sub in json_columns[item.name].fieldNames():
                flat[f"{item.name}_{sub}"] = decoded[sub]
            text = F.col(item.name)
            is_object = text.startswith("{") & F.try_parse_json(text).isNotNull()
            flat[item.name] = F.when(~F.coalesce(is_object, F.lit(False)), text)
        else:
            flat[item.name] = F.col(item.name)
    return flat


def flatten_event(df: DataFrame, json_columns: Mapping[str, T.StructType] | None = None) -> DataFrame:
    """Nested event columns as flat training-named columns; a later key replaces an earlier one.

    ``json_columns`` declares the keys of text columns that hold a JSON object; such a column is
    kept as text where it does not start like one.
    """
    return df.select(*[value.alias(name) for name, value in flat_columns(df, json_columns).items()])


@dataclass(frozen=True)
class FeatureContract:
    """Columns a model was trained with, and what fills their gaps."""

    feature_columns: tuple[str, ...]
    categorical_columns: tuple[str, ...] = ()
    numeric_fill_values: Mapping[str, float] = field(default_factory=dict)
    categorical_fill_value: str = "__missing__"
    target_col: str = "is_fraud"

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: Mapping) -> FeatureContract:
        return cls(**{**data, "feature_columns": tuple(data["feature_columns"]),
                      "categorical_columns": tuple(data["categorical_columns"])})

    @property
    def numeric_columns(self) -> tuple[str, ...]:
        return tuple(c for c in self.feature_columns if c not in self.categorical_columns)


def apply_feature_contract(df: DataFrame, contract: FeatureContract,
                           keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the contract's columns, in order, without nulls; ``keep`` passes ids through."""
    out = []
    for name in contract.feature_columns:
        present = F.col(f"`{name}`") if name in df.columns else F.lit(None)
        if name in contract.categorical_columns:
            filled = F.coalesce(present.cast("string"), F.lit(contract.categorical_fill_value))
        else:
            filled = number_or(present, contract.numeric_fill_values.get(name, 0.0))
        out.append(filled.alias(name))
    return df.select(*keep, *out)


# ---------------------------------------------------------------- decisions
@dataclass(frozen=True)
class Thresholds:
    medium: float = 0.50
    high: float = 0.80


def risk_decision(score: Column | str, thresholds: Thresholds = Thresholds()) -> tuple[Column, Column]:
    """(risk level, action) of a score."""
    s = _c(score)
    level = F.when(s >= thresholds.high, "high").when(s >= thresholds.medium, "medium").otherwise("low")
    action = F.when(s >= thresholds.high, "reject").when(s >= thresholds.medium, "review").otherwise("pass")
    return level, action


def effective_thresholds(calibration: DataFrame, fallback: Thresholds = Thresholds()) -> DataFrame:
    """Thresholds in force, from a one-row calibration table of the five threshold columns.

    Columns read: ``precision_at_least_0_95``, ``recall_at_least_0_90``, ``default_medium``,
    ``default_high`` (each a threshold or null), where present.
    """
    def pick(*names: str, default: float) -> Column:
        present = [F.col(n).cast("double") for n in names if n in calibration.columns]
        return F.coalesce(*present, F.lit(default))

    high = pick("precision_at_least_0_95", "default_high", default=fallback.high)
    medium = pick("recall_at_least_0_90", "default_medium", default=fallback.medium)
    return calibration.select(
        F.when(medium >= high, F.lit(fallback.medium)).otherwise(medium).alias("medium"),
        high.alias("high"),
    )


def _nested(df: DataFrame, path: str) -> Column:
    parent, _, key = path.partition(".")
    if parent not in df.columns:
        return F.lit(0.0)
    if not key:
        return number_or(parent)
    kind = df.schema[parent].dataType
    if isinstance(kind, T.StructType) and key in kind.fieldNames():
        return number_or(F.col(parent)[key])
    return F.lit(0.0)


def reason_codes(df: DataFrame, score: Column | str, thresholds: Thresholds = Thresholds(),
                 limit: int = 5) -> Column:
    """The first five rules that hold for an enriched event."""
    n = lambda path: _nested(df, path)
    w, g = "window_features.", "graph_features."
    rules = [
        ("amount_deviation",
         n("amount") >= F.greatest(n("user_profile.avg_amount") * 3, F.lit(5000.0))),
        ("high_frequency_user_window",
         (n(w + "user_txn_count_5min") >= 5) | (n(w + "user_amount_sum_5min") >= 10000)),
        ("shared_device", (n(w + "device_unique_user_count_10min") >= 3)
         | (n("device_profile.bind_user_count") >= 10)),
        ("risky_ip", (n(w + "ip_unique_user_count_10min") >= 5)
         | (n("ip_profile.is_proxy") != 0) | (n("ip_profile.is_vpn") != 0)),
        ("merchant_concentration", (n(w + "merchant_unique_user_count_1h") >= 20)
         | (n("merchant_profile.complaint_rate") >= 0.05)),
        ("graph_fraud_neighborhood", (n(g + "payer_graph_fraud_edge_ratio") >= 0.2)
         | (n(g + "payer_graph_fraud_edge_count") >= 3)),
        ("fraud_ring_detected", n(g + "payer_graph_mining_group_risk_score") >= 0.70),
        ("shared_device_ring", n(g + "payer_graph_mining_shared_device_count") >= 2),
        ("shared_ip_cluster", n(g + "payer_graph_mining_shared_ip_count") >= 2),
        ("merchant_fraud_community", n(g + "merchant_graph_mining_group_risk_score") >= 0.60),
    ]
    held = first_reasons(rules, limit)
    high = _c(score) >= thresholds.high
    return F.when(high & (F.size(held) == 0), F.array(F.lit("model_high_score"))).otherwise(held)


def group_risk_level(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s >= 0.75, "high").when(s >= 0.65, "medium").otherwise("watch")


def entity_type_from_prefix(entity: Column | str) -> Column:
    e = _c(entity)
    return (F.when(e.startswith("D_"), "device").when(e.startswith("IP_"), "ip")
            .when(e.startswith("banksim_m:") | e.startswith("amlsim_branch:")
                  | e.startswith("M_"), "merchant")
            .when(e.startswith("payee:"), "payee").otherwise("user"))


def profile_axes(df: DataFrame, ring_score: str = "graph_mining_group_risk_score") -> DataFrame:
    """Six 0-1 axes of a user profile."""
    ring = number_or(ring_score) if ring_score in df.columns else F.lit(0.0)
    strongest = F.when(ring != 0, ring).otherwise(number_or("risk_history_score"))
    axes = {
        "axis_activity": F.log1p(number_or("txn_count")) / F.log1p(F.lit(200.0)),
        "axis_amount": F.log1p(number_or("total_amount")) / F.log1p(F.lit(200000.0)),
        "axis_devices": number_or("common_device_count") / 15,
        "axis_ips": number_or("common_ip_count") / 15,
        "axis_fraud_history": number_or("observed_fraud_rate"),
        "axis_ring_risk": strongest,
    }
    return df.withColumns({name: clip01(value) for name, value in axes.items()})
