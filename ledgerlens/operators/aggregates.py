"""Counts, summaries, medians and latency percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalar import epoch_micros, round_half_even
from ledgerlens.operators.ordering import exact_quantiles, running_position


def entity_degree(edges: DataFrame) -> DataFrame:
    """Degree and fraud edges of every endpoint; a self-loop counts twice."""
    ends = edges.select("label", F.explode(F.array("src_id", "dst_id")).alias("entity_id"))
    degrees = ends.where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("graph_degree"),
        F.count_if(F.col("label") == 1).alias("graph_fraud_edge_count"),
    )
    share = (F.col("graph_fraud_edge_count") / F.col("graph_degree")).cast("float")
    return degrees.withColumn("graph_fraud_edge_ratio", share)


def _label_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("is_fraud") == 1).alias("fraud"),
        F.count_if(F.col("is_fraud") < 0).alias("unlabeled"),
    ]


def source_counts(tx: DataFrame) -> DataFrame:
    return tx.groupBy("source").agg(*_label_counts())


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def dataset_summary(tx: DataFrame) -> DataFrame:
    """Rows, labels, time range and labelled fraud rate: per source, per split and in all.

    The log is reduced once to (source, split); the three sections are sums of that.
    """
    base = tx.groupBy("source", "split").agg(
        *_label_counts(), F.count_if(F.col("is_fraud") == 0).alias("normal"),
        F.min("timestamp").alias("min_time"), F.max("timestamp").alias("max_time"))
    section = F.array(
        F.struct(F.lit("source").alias("section"), F.col("source").alias("name")),
        F.struct(F.lit("split").alias("section"), F.col("split").alias("name")),
        F.struct(F.lit("all").alias("section"), F.lit("all").alias("name")),
    )
    return (base.withColumn("_s", F.explode(section))
            .groupBy(F.col("_s.section").alias("section"), F.col("_s.name").alias("name")).agg(
                *[F.sum(c).alias(c) for c in ("rows", "fraud", "normal", "unlabeled")],
                F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"))
            .withColumn("fraud_rate_labeled", F.col("fraud")
                        / F.greatest(F.col("fraud") + F.col("normal"), F.lit(1))))


def numeric_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, median) of each column; 0 where a column has no number."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).try_cast("double").alias("value"))
                      for c in columns])
    long = df.select(F.explode(pairs).alias("_p")).select("_p.*")
    found = exact_quantiles(long, "value", {"median": 0.5}, ["column"])
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return (names.join(found, "column", "left")
            .select("column", F.coalesce("median", F.lit(0.0)).alias("median")))


def window_span_stats(tx: DataFrame) -> DataFrame:
    micros = epoch_micros("timestamp")
    return tx.groupBy("source").agg(
        F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"),
        ((F.max(micros) - F.min(micros)) / 1e6).alias("span_seconds"),
        F.count_if(F.col("timestamp").isNull()).alias("missing_times"))


def latency_percentiles(df: DataFrame, latency: str = "latency_sec", key: str = "transaction_id") -> DataFrame:
    """Mean, p95 and p99 by truncated index, and p50, p95 and p99 by nearest rank."""
    placed = running_position(df.where(F.col(latency).isNotNull()).select(key, latency),
                              [latency, key], out="_at", total="_n")
    n = F.col("_n")

    def at(index: Column) -> Column:
        return F.max(F.when(F.col("_at") == index, F.col(latency)))

    def truncated(p: float) -> Column:
        index = F.floor(n * F.lit(p)) - 1
        return at(F.when(index < 0, n + index).otherwise(index))

    def nearest(p: float) -> Column:
        return at(round_half_even(F.lit(p) * (n - 1), 0).cast("bigint"))

    return placed.agg(
        F.count(F.lit(1)).alias("received"), F.avg(latency).alias("latency_avg"),
        truncated(0.95).alias("latency_p95"), truncated(0.99).alias("latency_p99"),
        nearest(0.50).alias("nearest_p50"), nearest(0.95).alias("nearest_p95"),
        nearest(0.99).alias("nearest_p99"),
    )
