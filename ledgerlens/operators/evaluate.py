"""Metrics of scored rows, thresholds and model bookkeeping.

Scores are collapsed to counted distinct values or to threshold bins before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalar import ratio
from ledgerlens.operators.ordering import running_position, running_totals

# The 99 candidate thresholds .01 ... .99.
CANDIDATES = tuple(i * ((0.99 - 0.01) / 98) + 0.01 for i in range(99))


def _score_counts(scored: DataFrame, label: str, score: str) -> DataFrame:
    return scored.groupBy(F.col(score).cast("double").alias("_score")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(label) == 1).alias("_pos"))


def average_precision(scored: DataFrame, label: str = "is_fraud", score: str = "risk_score") -> DataFrame:
    """Step-wise area under precision and recall; equal scores are one step."""
    steps = running_totals(_score_counts(scored, label, score), [F.desc("_score")],
                           {"_n0": "_n", "_p0": "_pos"}, whole={"_all": "_p0"})
    precision = (F.col("_p0") + F.col("_pos")) / (F.col("_n0") + F.col("_n"))
    return steps.agg(F.coalesce(
        F.sum(precision * F.col("_pos")) / F.nullif(F.max("_all"), F.lit(0)), F.lit(0.0))
        .alias("average_precision"))


def roc_auc(scored: DataFrame, label: str = "is_fraud", score: str = "risk_score") -> DataFrame:
    """Rank statistic with average ranks; 0 when only one class is present."""
    ranked = running_totals(_score_counts(scored, label, score), ["_score"], {"_n0": "_n"})
    rank = F.col("_n0") + (F.col("_n") + 1) / F.lit(2.0)
    sums = ranked.agg(F.sum(rank * F.col("_pos")).alias("r"),
                      F.sum("_pos").cast("double").alias("p"),
                      F.sum(F.col("_n") - F.col("_pos")).cast("double").alias("n"))
    p, n = F.col("p"), F.col("n")
    auc = (F.col("r") - p * (p + 1) / 2) / F.nullif(p * n, F.lit(0.0))
    return sums.select(F.coalesce(auc, F.lit(0.0)).alias("roc_auc"))


def recall_at_top_k(scored: DataFrame, share: float = 0.01, label: str = "is_fraud",
                    score: str = "risk_score", key: str = "transaction_id") -> DataFrame:
    """Share of the positives among the best-scored rows (at least one row)."""
    placed = running_position(scored.select(key, label, score), [F.desc(score), key],
                              out="_at", total="_n")
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share)))
    found = F.count_if((F.col("_at") < k) & (F.col(label) == 1))
    return placed.agg(ratio(found, F.count_if(F.col(label) == 1)).alias("recall_at_top_k"))


def _confusion(tp: Column, fp: Column, pos: Column, neg: Column) -> dict[str, Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, pos)
    return {
        "precision": precision, "recall": recall, "f1": ratio(2 * tp, tp + fp + pos),
        "false_positive_rate": ratio(fp, neg), "predicted_positive": tp + fp,
    }


def confusion_metrics(scored: DataFrame, thresholds: Sequence[float] = (0.5, 0.8),
                      label: str = "is_fraud", score: str = "risk_score") -> DataFrame:
    """Precision, recall, f1, false-positive rate and predicted positives per threshold."""
    steps = F.array(*[F.struct(
        F.lit(float(t)).alias("threshold"),
        F.count_if((F.col(score) >= t) & (F.col(label) == 1)).alias("tp"),
        F.count_if((F.col(score) >= t) & (F.col(label) == 0)).alias("fp")) for t in thresholds])
    base = scored.agg(steps.alias("_s"), F.count_if(F.col(label) == 1).alias("pos"),
                      F.count_if(F.col(label) == 0).alias("neg"))
    rows = base.select(F.explode("_s").alias("_s"), "pos", "neg").select("_s.*", "pos", "neg")
    out = _confusion(*[F.col(c) for c in ("tp", "fp", "pos", "neg")])
    return rows.select("threshold", *[v.alias(k) for k, v in out.items()])


def threshold_bin(score: Column) -> Column:
    """How many of the 99 candidate thresholds are at or below ``score``."""
    steps = F.array(*[F.lit(t) for t in CANDIDATES])
    guess = F.greatest(F.lit(0), F.least(F.lit(99), F.floor(score * 100).cast("int")))
    above = F.when((guess < 99) & (F.get(steps, guess) <= score), 1).otherwise(0)
    below = F.when((guess > 0) & (F.get(steps, guess - 1) > score), 1).otherwise(0)
    return guess + above - below


def threshold_reports(scored: DataFrame, label: str = "is_fraud", score: str = "risk_score") -> DataFrame:
    """Confusion metrics at every candidate threshold from one histogram of at most 100 bins."""
    binned = scored.groupBy(threshold_bin(F.col(score)).alias("bin")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    spark = scored.sparkSession
    ladder = spark.range(0, 100, 1, 1).select(
        F.col("id").cast("int").alias("bin"),
        F.when(F.col("id") > 0, F.get(F.array(*[F.lit(t) for t in CANDIDATES]),
                                      (F.col("id") - 1).cast("int"))).alias("threshold"))
    full = ladder.join(F.broadcast(binned), "bin", "left").na.fill(0, ["p", "n"])
    upward = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding,
                                                      Window.unboundedFollowing)
    sums = full.select("threshold", F.sum("p").over(upward).alias("tp"),
                       F.sum("n").over(upward).alias("fp"), F.sum("p").over(whole).alias("pos"),
                       F.sum("n").over(whole).alias("neg")).where(F.col("threshold").isNotNull())
    out = _confusion(*[F.col(c) for c in ("tp", "fp", "pos", "neg")])
    return sums.select("threshold", *[v.alias(k) for k, v in out.items()])


def calibrate_thresholds(scored: DataFrame, label: str = "is_fraud", score: str = "risk_score") -> DataFrame:
    """Named threshold rows: best f1, high precision, high recall, and the two defaults.

    The lowest threshold wins a tie; a named row is absent when no threshold qualifies.
    """
    reports = threshold_reports(scored, label, score)
    row = F.struct("threshold", "precision", "recall", "f1", "false_positive_rate",
                   "predicted_positive")
    best = lambda value, where=F.lit(True): F.min_by(
        F.when(where, row), F.when(where, F.struct((-F.col(value)).alias("v"), F.col("threshold"))))
    picked = reports.agg(
        best("f1").alias("best_f1"),
        best("recall", F.col("precision") >= 0.95).alias("precision_at_least_0_95"),
        best("precision", F.col("recall") >= 0.90).alias("recall_at_least_0_90"))
    names = ("best_f1", "precision_at_least_0_95", "recall_at_least_0_90")
    long = picked.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).alias("r")) for n in names])).alias("_x")).select(
        "_x.name", "_x.r.*").where(F.col("threshold").isNotNull())
    defaults = confusion_metrics(scored, (0.50, 0.80), label, score).select(
        F.when(F.col("threshold") == 0.50, "default_medium").otherwise("default_high").alias("name"),
        "threshold", "precision", "recall", "f1", "false_positive_rate", "predicted_positive")
    return long.unionByName(defaults)


def calibration_row(calibration: DataFrame) -> DataFrame:
    """The named thresholds as one row, for ``effective_thresholds``."""
    names = ("best_f1", "precision_at_least_0_95", "recall_at_least_0_90", "default_medium",
             "default_high")
    return calibration.agg(*[
        F.max(F.when(F.col("name") == n, F.col("threshold"))).alias(n) for n in names])


def threshold_sandbox(scored: DataFrame, medium: float, high: float, label: str = "is_fraud",
                      score: str = "risk_score") -> DataFrame:
    """What a pair of thresholds would do: decisions, high-risk metrics and workload."""
    if not 0.0 <= medium < high <= 1.0:
        raise ValueError("thresholds must satisfy 0 <= medium < high <= 1")
    s, fraud, normal = F.col(score), F.col(label) == 1, F.col(label) == 0
    reject, kept = s >= high, s >= medium
    n = scored.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(fraud).alias("fraud_rows"),
        F.count_if(normal).alias("normal_rows"), F.count_if(~kept).alias("pass_rows"),
        F.count_if(kept & ~reject).alias("review_rows"), F.count_if(reject).alias("reject_rows"),
        F.count_if(reject & fraud).alias("true_positive"),
        F.count_if(reject & normal).alias("false_positive"),
        F.count_if(~reject & fraud).alias("missed_fraud"), F.count_if(kept).alias("_kept"))
    c = F.col
    out = _confusion(c("true_positive"), c("false_positive"), c("fraud_rows"), c("normal_rows"))
    del out["predicted_positive"]
    return n.select(
        F.lit(float(medium)).alias("medium"), F.lit(float(high)).alias("high"), "rows",
        "fraud_rows", "normal_rows", "pass_rows", "review_rows", "reject_rows",
        *[v.alias(k) for k, v in out.items()], "true_positive", "false_positive", "missed_fraud",
        ratio(c("review_rows"), c("rows")).alias("review_rate"),
        ratio(c("reject_rows"), c("rows")).alias("reject_rate"),
        ratio(c("_kept"), c("rows")).alias("intervention_rate"))


def metrics_row(scored: DataFrame, model_name: str, dataset: str, train_rows: int, valid_rows: int,
                threshold: float = 0.80, feedback_rows: int = 0, with_window_features: bool = True,
                with_graph_features: bool = True, with_graph_mining_features: bool = False,
                feature_count: int = 0, model_dir: str | None = None, label: str = "is_fraud",
                score: str = "risk_score", key: str = "transaction_id") -> DataFrame:
    """One row per training run."""
    at = confusion_metrics(scored, (threshold,), label, score)
    return at.select(
        F.lit(model_name).alias("model_name"), F.lit(model_dir or model_name).alias("model_dir"),
        F.lit(dataset).alias("dataset"), F.lit(train_rows).cast("bigint").alias("train_rows"),
        F.lit(valid_rows).cast("bigint").alias("valid_rows"),
        scored.agg(F.count(F.lit(1)).alias("n")).scalar().alias("test_rows"),
        average_precision(scored, label, score).scalar().alias("pr_auc"),
        roc_auc(scored, label, score).scalar().alias("roc_auc"), F.col("f1"),
        recall_at_top_k(scored, 0.01, label, score, key).scalar().alias("recall_at_top_1pct"),
        F.col("false_positive_rate").alias("false_positive_rate_at_threshold"),
        F.lit(0.50).alias("threshold_medium"), F.lit(float(threshold)).alias("threshold_high"),
        F.lit(feature_count).cast("bigint").alias("feature_count"),
        F.lit(with_window_features).alias("with_window_features"),
        F.lit(with_graph_features).alias("with_graph_features"),
        F.lit(with_graph_mining_features).alias("with_graph_mining_features"),
        F.lit(feedback_rows).cast("bigint").alias("feedback_rows"))


def scorecard(scored: DataFrame, label: str = "is_fraud", score: str = "risk_score") -> DataFrame:
    return scored.where(F.col(label).isin(0, 1)).select(
        F.col(label).cast("tinyint").alias("is_fraud"), F.col(score).cast("float").alias("risk_score"))


def class_weight(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Negatives per positive; 1 without positives."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(ratio(neg, pos, 1.0).alias("scale_pos_weight"))


CATALOG_COLUMNS = {
    "model_name": "string", "model_version": "string", "dataset": "string",
    "feature_count": "bigint", "pr_auc": "double", "roc_auc": "double", "f1": "double",
    "with_window_features": "boolean", "with_graph_features": "boolean",
    "with_graph_mining_features": "boolean",
}


def model_catalog(spark, pattern: str, active: str | None = None) -> DataFrame:
    """All metric files under ``pattern`` (…/<name>/latest/metrics.json); the active one first."""
    schema = ", ".join(f"{c} {t}" for c, t in CATALOG_COLUMNS.items())
    raw = spark.read.schema(schema).option("multiLine", True).json(pattern)
    parts = F.split(F.col("_metadata.file_path"), "/")
    rows = raw.select(F.element_at(parts, -3).alias("name"), *CATALOG_COLUMNS,
                      F.col("_metadata.file_modification_time").alias("updated_at"))
    loaded = F.lit(False) if active is None else F.col("name") == active
    return rows.withColumn("loaded", loaded).orderBy(F.desc("loaded"), "name")


def leaderboard_upsert(board: DataFrame, entry: DataFrame) -> DataFrame:
    """Replace the rows of the same model folder and dataset, best area first."""
    name = F.coalesce("model_dir", "model_name")
    new = entry.select(name.alias("_name"), F.col("dataset").alias("_dataset")).distinct()
    kept = board.join(new, [name == F.col("_name"), F.col("dataset") == F.col("_dataset")],
                      "left_anti")
    return kept.unionByName(entry, allowMissingColumns=True).orderBy(
        F.desc(F.coalesce("pr_auc", F.lit(0.0))), "model_name")


def release_gate(candidate: DataFrame, latest: DataFrame, max_fpr_rise: float = 0.01,
                 min_feedback: int = 100) -> DataFrame:
    """Whether each candidate may replace the latest model of the same name."""
    new, old = candidate.alias("new"), latest.alias("old")
    c = F.col
    checks = {
        "pr_auc_ok": c("new.pr_auc") >= c("old.pr_auc"),
        "f1_ok": c("new.f1") >= c("old.f1"),
        "fpr_ok": c("new.false_positive_rate_at_threshold")
        <= c("old.false_positive_rate_at_threshold") + max_fpr_rise,
        "feedback_ok": c("new.feedback_rows") > min_feedback,
    }
    every = checks["pr_auc_ok"] & checks["f1_ok"] & checks["fpr_ok"] & checks["feedback_ok"]
    return new.join(old, c("new.model_name") == c("old.model_name")).select(
        c("new.model_name").alias("model_name"), *[v.alias(k) for k, v in checks.items()],
        every.alias("may_release"))
