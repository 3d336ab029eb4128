"""Unions, deduplication and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions.scalar import _c
from ledgerlens.operators.ordering import top_per_group


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def union_widen(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Union of different schemas; base rows count as not injected."""
    marked = base.drop("is_injected").withColumn("is_injected", F.lit(0).cast("tinyint"))
    out = marked.unionByName(extra, allowMissingColumns=True)
    for name in S.AUGMENTED_COLUMNS:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
    return out


def dedupe_priority(parts: Sequence[DataFrame], key: str, order: Sequence[Column | str] = ()) -> DataFrame:
    """First row per key: earlier tables win, then the lowest ``order``."""
    tagged = [p.withColumn("_priority", F.lit(i)) for i, p in enumerate(parts)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    every = every.where(F.col(key).isNotNull())
    return top_per_group(every, [key], ["_priority", *order], 1, "_place").drop("_place", "_priority")


def dedupe_last(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Latest row per key in ``order``."""
    rows = df.where(F.col(key).isNotNull())
    return top_per_group(rows, [key], [F.desc_nulls_last(o) for o in order], 1, "_place").drop("_place")


def distinct_ids(tx: DataFrame) -> DataFrame:
    """(kind, id) of every entity; payees count as users where no merchant is involved."""
    ids = F.array(
        F.struct(F.lit("user").alias("kind"), F.col("payer_id").alias("id")),
        F.struct(F.lit("user").alias("kind"),
                 F.when(F.col("merchant_id").isNull(), F.col("payee_id")).alias("id")),
        F.struct(F.lit("transaction").alias("kind"), F.col("transaction_id").alias("id")),
        F.struct(F.lit("merchant").alias("kind"), F.col("merchant_id").alias("id")),
        F.struct(F.lit("device").alias("kind"), F.col("device_id").alias("id")),
        F.struct(F.lit("ip").alias("kind"), F.col("ip_id").alias("id")),
    )
    return (tx.select(F.explode(ids).alias("_e")).select("_e.*")
            .where(F.col("id").isNotNull()).distinct())


def member_intersect(members: DataFrame, payers: DataFrame, member: str = "node",
                     payer: str = "payer_id") -> DataFrame:
    known = payers.select(F.col(payer).alias("_p")).distinct()
    return members.join(known, _c(member) == F.col("_p"), "left_semi")


def member_minus(members: DataFrame, payers: DataFrame, member: str = "node",
                 payer: str = "payer_id") -> DataFrame:
    known = payers.select(F.col(payer).alias("_p")).distinct()
    return members.join(known, _c(member) == F.col("_p"), "left_anti")
