"""Enrichment, scoring and routing of a stream."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.derive import Thresholds, flat_columns, reason_codes, risk_decision
from ledgerlens.operators.joins import PROFILE_JOINS, graph_feature_plan, lookup
from ledgerlens.operators.models import RiskModel, score_batch
from ledgerlens.session import LEAN, forget_shuffles, settings
from ledgerlens.sources import model_store as M
from ledgerlens.streaming.windows import join_back, window_state


def enrich_stream_profiles(events: DataFrame, profiles: Mapping[str, DataFrame],
                           entities: DataFrame | None = None) -> DataFrame:
    """Events with nested profiles and graph features; a missing profile is a null struct."""
    out = events
    for kind, key, dim_key in PROFILE_JOINS:
        if kind not in profiles:
            continue
        nested = profiles[kind].select(F.col(dim_key).alias("_id"),
                                       F.struct(*profiles[kind].columns).alias(f"{kind}_profile"))
        out = lookup(out, nested, key, "_id")
    if entities is None:
        return out
    fields = []
    for role, wanted in graph_feature_plan(True).items():
        present = [c for c in wanted if c in entities.columns]
        dim = entities.select(F.col("entity_id").alias("_id"), F.struct(*present).alias(f"_g_{role}"))
        out = lookup(out, dim, f"{role}_id", "_id")
        for name in present:
            value = F.col(f"_g_{role}")[name]
            filled = value if name == "fraud_group_mining_id" else F.coalesce(
                value.cast("double"), F.lit(0.0))
            fields.append(filled.alias(f"{role}_{name}"))
    return (out.withColumn("graph_features", F.struct(*fields))
            .drop(*[f"_g_{role}" for role in graph_feature_plan(True)]))


def score_events(enriched: DataFrame, model: Callable[[DataFrame], DataFrame], model_name: str,
                 model_version: str, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Scored events; ``model`` adds ``risk_score`` to a table."""
    scored = model(enriched)
    level, action = risk_decision("risk_score", thresholds)
    return scored.withColumns({
        "risk_level": level, "decision": action,
        "reason_codes": reason_codes(scored, "risk_score", thresholds),
        "model_name": F.lit(model_name), "model_version": F.lit(model_version),
        "thresholds": F.struct(F.lit(thresholds.medium).alias("medium"),
                               F.lit(thresholds.high).alias("high")),
        "scored_at": F.current_timestamp(),
    })


def score_nested(model: RiskModel, enriched: DataFrame, json_columns: Mapping | None = None) -> DataFrame:
    """Enriched events with the model's ``risk_score``; nested values are read by their training names."""
    flat = flat_columns(enriched, json_columns)
    known = [flat[c].alias(c) for c in model.contract.feature_columns if c in flat]
    wide = enriched.select(F.struct("*").alias("_event"), *known)
    return score_batch(model, wide).select("_event.*", "risk_score")


def published_scorer(spark: SparkSession, folder: str,
                     json_columns: Mapping | None = None) -> Callable[[DataFrame], DataFrame]:
    """Scores a micro-batch by what is published in ``folder`` when the batch begins.

    The publication is read anew for each batch; a model is loaded once per version. Profiles and graph
    features come from the snapshots of the same publication, so a score never mixes two of them.
    """
    loaded: dict[tuple[str, str], RiskModel] = {}

    def score(batch: DataFrame) -> DataFrame:
        now = M.published(spark, folder)
        version = now.model_name, now.model_version
        if version not in loaded:
            loaded.clear()
            loaded[version] = M.load_model(spark, folder, *version)
        profiles, entities = M.snapshots(spark, now)
        enriched = enrich_stream_profiles(batch, profiles, entities)
        return score_events(enriched, lambda df: score_nested(loaded[version], df, json_columns), *version,
                            thresholds=now.thresholds)

    return score


def route(scored: DataFrame, folder: str, batch_id: int) -> None:
    """One micro-batch to the risk, alert and late tables.

    A repeated batch overwrites its own folder, so a restart writes nothing twice. The key is
    what a message sink would partition by.
    """
    keyed = scored.withColumn("key", F.coalesce("payer_id", "transaction_id", F.lit("")))
    spark = keyed.sparkSession
    path = lambda name: f"{folder}/{name}/batch={batch_id}"
    with settings(spark, LEAN):
        keyed.write.mode("overwrite").parquet(path("risk_results"))
        rows = spark.read.schema(keyed.schema).parquet(path("risk_results"))  # scored once
        alert = (F.col("risk_level") == "high") | (F.col("decision") == "reject")
        for name, part in (("alert_events", rows.where(alert)), ("late_events", rows.where("is_late_event"))):
            part.write.mode("overwrite").parquet(path(name))


def scoring_stream(events: DataFrame, folder: str, checkpoint: str,
                   score: Callable[[DataFrame], DataFrame], trigger: Mapping | None = None):
    """Windows in state, then per micro-batch: join back, score, route.

    ``trigger`` is passed on, e.g. ``{"processingTime": "300 milliseconds"}``; by default all
    available input is processed and the query ends.
    """
    schema = events.schema
    partials = window_state(events)

    def handle(batch: DataFrame, batch_id: int) -> None:
        forget_shuffles(batch.sparkSession)  # those of the batch before
        route(score(join_back(batch, schema)), folder, batch_id)

    return (partials.writeStream.outputMode("append").foreachBatch(handle)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def feedback_append(events: DataFrame, path: str, checkpoint: str, trigger: Mapping | None = None):
    """Append normalised feedback to the pool; nothing already written is read again."""
    from ledgerlens.operators.feedback import feedback_events

    return (feedback_events(events).writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


