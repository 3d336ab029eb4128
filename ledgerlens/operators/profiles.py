"""Entity profiles, one row per user, merchant, device or ip address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions.hashing import fake_ip, int_div, pick, stable_hash
from ledgerlens.functions.scalar import clip01, flag, round_half_even
from ledgerlens.operators.derive import account_age
from ledgerlens.operators.ordering import pct_rank_avg
from ledgerlens.session import cut


def _fraud_count() -> Column:
    return F.count_if(F.col("is_fraud") == 1).alias("fraud_txn_count")


def _rate(digits: int | None = None) -> Column:
    rate = F.col("fraud_txn_count") / F.col("txn_count")
    return rate if digits is None else round_half_even(rate, digits)


def _most_common(name: str) -> Column:
    """Most frequent value, the smallest on a tie."""
    return F.coalesce(F.mode(name, True), F.lit("unknown"))


def _seen() -> list[Column]:
    return [F.min("timestamp").alias("first_seen_time"), F.max("timestamp").alias("last_seen_time")]


def user_profile(tx: DataFrame) -> DataFrame:
    """Payers, and payees of payments without a merchant."""
    sides = F.array(
        F.struct(F.col("payer_id").alias("user_id"), F.col("payer_country").alias("country")),
        F.struct(F.when(F.col("merchant_id").isNull(), F.col("payee_id")).alias("user_id"),
                 F.col("payee_country").alias("country")),
    )
    base = (tx.select("timestamp", "amount", "is_fraud", "device_id", "ip_id", "source",
                      F.explode(sides).alias("_side"))
            .select("*", "_side.user_id", "_side.country").where(F.col("user_id").isNotNull()))
    agg = base.groupBy("user_id").agg(
        *_seen(),
        F.count(F.lit(1)).alias("txn_count"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_amount"),
        _fraud_count(),
        F.countDistinct("device_id").alias("common_device_count"),
        F.countDistinct("ip_id").alias("common_ip_count"),
        _most_common("source").alias("source_hint"),
        _most_common("country").alias("home_country"),
    ).withColumns({"observed_fraud_rate": _rate(6), "account_age_days": account_age("user_id")})
    ranked = pct_rank_avg(cut(agg, "profile"), "avg_amount", "_rank")
    score = round_half_even(clip01(F.lit(0.75) * F.col("observed_fraud_rate")
                            + F.lit(0.25) * F.col("_rank")), 4)
    return (ranked.withColumn("risk_history_score", score)
            .withColumn("is_black_user", flag((F.col("fraud_txn_count") > 0)
                                              & (F.col("risk_history_score") >= 0.20)))
            .drop("_rank"))


def merchant_profile(tx: DataFrame) -> DataFrame:
    agg = tx.where(F.col("merchant_id").isNotNull()).groupBy("merchant_id").agg(
        _most_common("merchant_category").alias("merchant_category"),
        _most_common("payee_country").alias("merchant_country"),
        *_seen(),
        F.count(F.lit(1)).alias("txn_count"),
        F.countDistinct("payer_id").alias("unique_user_count"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_amount"),
        _fraud_count(),
    ).withColumn("observed_fraud_rate", _rate(6))
    h = stable_hash("merchant_id", "merchant_noise")
    rate = F.col("observed_fraud_rate")
    agg = agg.withColumns({
        "chargeback_rate": round_half_even(clip01(
            rate * F.lit(0.6) + (h % 100) / F.lit(10000)), 5),
        "complaint_rate": round_half_even(clip01(
            rate * F.lit(0.4) + (int_div(h, 100) % 100) / F.lit(12000)), 5),
    })
    ranked = pct_rank_avg(cut(agg, "profile"), "avg_amount", "_rank")
    score = round_half_even(clip01(
        F.lit(0.55) * rate + F.lit(0.20) * F.col("chargeback_rate")
        + F.lit(0.15) * F.col("complaint_rate") + F.lit(0.10) * F.col("_rank")), 4)
    return (ranked.withColumn("merchant_risk_score", score)
            .withColumn("is_high_risk_merchant", flag(F.col("merchant_risk_score") >= 0.25))
            .drop("_rank"))


def device_profile(tx: DataFrame) -> DataFrame:
    agg = tx.where(F.col("device_id").isNotNull()).groupBy("device_id").agg(
        *_seen(),
        F.countDistinct("payer_id").alias("bind_user_count"),
        F.count(F.lit(1)).alias("txn_count"),
        _fraud_count(),
    )
    h = stable_hash("device_id", "device_profile")
    agg = agg.withColumns({
        "device_type": pick(h, S.DEVICE_TYPES),
        "os": pick(int_div(h, 7), S.OS_TYPES),
        "browser": pick(int_div(h, 13), S.BROWSERS),
        "observed_fraud_rate": _rate(),
        "is_emulator": flag(h % 97 < 3),
        "is_proxy_device": flag((F.col("bind_user_count") >= 8) | (h % 211 == 0)),
    })
    ranked = pct_rank_avg(cut(agg, "profile"), "bind_user_count", "_rank")
    score = round_half_even(clip01(
        F.col("_rank") * F.lit(0.45) + F.lit(0.45) * F.col("observed_fraud_rate")
        + F.lit(0.05) * F.col("is_emulator") + F.lit(0.05) * F.col("is_proxy_device")), 4)
    return ranked.withColumn("device_risk_score", score).drop("_rank")


def ip_profile(tx: DataFrame) -> DataFrame:
    agg = tx.where(F.col("ip_id").isNotNull()).groupBy("ip_id").agg(
        *_seen(),
        _most_common("payer_country").alias("country"),
        F.countDistinct("payer_id").alias("bind_user_count"),
        F.count(F.lit(1)).alias("txn_count"),
        _fraud_count(),
    )
    h = stable_hash("ip_id", "ip_profile")
    cities = F.create_map(*[F.lit(x) for pair in S.CITY_BY_COUNTRY.items() for x in pair])
    agg = agg.withColumns({
        "ip_address": fake_ip(h),
        "city": F.coalesce(F.try_element_at(cities, F.col("country")), F.lit("Unknown")),
        "isp": pick(h, S.ISPS),
        "is_proxy": flag((F.col("bind_user_count") >= 10) | (h % 101 < 4)),
        "is_vpn": flag(h % 127 < 5),
        "observed_fraud_rate": _rate(),
    })
    ranked = pct_rank_avg(cut(agg, "profile"), "bind_user_count", "_rank")
    score = round_half_even(clip01(
        F.col("_rank") * F.lit(0.35) + F.lit(0.45) * F.col("observed_fraud_rate")
        + F.lit(0.10) * F.col("is_proxy") + F.lit(0.10) * F.col("is_vpn")), 4)
    return ranked.withColumn("ip_risk_score", score).drop("_rank")


PROFILES = {
    "user": user_profile, "merchant": merchant_profile,
    "device": device_profile, "ip": ip_profile,
}


def all_profiles(tx: DataFrame) -> dict[str, DataFrame]:
    return {kind: build(tx) for kind, build in PROFILES.items()}
