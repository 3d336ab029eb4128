"""Reviewer feedback: reading, merging into labels, retraining data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.merge import dedupe_last


def feedback_normalize(feedback: DataFrame) -> DataFrame:
    """``is_fraud`` from the first of is_fraud, reviewed_is_fraud, label; only 0 and 1 are kept.

    Which column counts is decided per table, as a table carries one kind of label.
    """
    names = [c for c in ("is_fraud", "reviewed_is_fraud", "label") if c in feedback.columns]
    if not names:
        return feedback
    label = F.col(names[0]).try_cast("double")
    return (feedback.withColumn("is_fraud", F.when(label.isin(0.0, 1.0), label).cast("tinyint"))
            .where(F.col("is_fraud").isNotNull()))


def feedback_events(events: DataFrame) -> DataFrame:
    """Feedback messages: ``reviewed_is_fraud`` filled from is_fraud or label, with ingest time."""
    names = [c for c in ("reviewed_is_fraud", "is_fraud", "label") if c in events.columns]
    return events.withColumns({
        "reviewed_is_fraud": F.coalesce(*[F.col(n).try_cast("int") for n in names]),
        "feedback_ingested_at": F.current_timestamp(),
    })


def anti_known_feedback(feedback: DataFrame, tx: DataFrame, key: str = "transaction_id") -> DataFrame:
    known = tx.select(F.col(key).alias("_k")).distinct()
    return feedback.join(known, F.col(key) == F.col("_k"), "left_anti")


def feedback_apply(tx: DataFrame, feedback: DataFrame, order: Sequence[str],
                   split: str = "split") -> DataFrame:
    """Overwrite labels of known transactions (the last review counts) and append unknown ones.

    ``order`` says which review is later. Appended rows join the train split with null features.
    """
    reviews = feedback_normalize(feedback)
    last = dedupe_last(reviews, "transaction_id", order).select(
        F.col("transaction_id").alias("_id"), F.col("is_fraud").alias("_reviewed"))
    known = tx.join(last, F.col("transaction_id") == F.col("_id"), "left")
    relabelled = known.withColumn(
        "is_fraud", F.coalesce("_reviewed", "is_fraud").cast("tinyint")).select(*tx.columns)
    unknown = anti_known_feedback(reviews, tx).withColumn(split, F.lit("train"))
    kept = [c for c in tx.columns if c in unknown.columns]
    return relabelled.unionByName(unknown.select(*kept), allowMissingColumns=True)
