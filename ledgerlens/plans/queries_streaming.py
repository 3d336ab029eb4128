"""Queries of the stream operators (survey section 2.10): whole tables replayed as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ledgerlens import schema as S
from ledgerlens.functions.scalar import epoch_micros
from ledgerlens.operators import windows as W
from ledgerlens.operators.aggregates import entity_degree
from ledgerlens.operators.derive import FeatureContract, Thresholds
from ledgerlens.operators.graph import tx_edges
from ledgerlens.operators.models import linear_model
from ledgerlens.operators.ordering import running_position
from ledgerlens.operators.profiles import all_profiles, device_profile
from ledgerlens.plans.queries_order import window_sql
from ledgerlens.plans.queries_rings import WITH_EDGES
from ledgerlens.plans.registry import WITH_D, WITH_TX, d, query, rounded, sql_hash, tx
from ledgerlens.session import LEAN, cut, drop, remove, scratch_path, settings, settled
from ledgerlens.sources import model_store as M
from ledgerlens.sources.tables import source_stream_events
from ledgerlens.streaming import events as V
from ledgerlens.streaming import scoring as Z
from ledgerlens.streaming import windows as K

EVENT = ST.StructType([f for f in S.STREAM_SCHEMA if f.name not in (
    "channel", "payment_method", "fraud_type", "risk_level", "rule_score", "currency", "txn_type")])
CONSUMERS = 8
_PART = f"{sql_hash('payer_id')} % {CONSUMERS}"
_EVENTS = [f.name for f in EVENT]
_ALL = [f for group in W.BY_KEY.values() for f in group]
_SUMS = [W.PREFIX + f.name for f in _ALL if f.kind == "sum"]


BATCH_ROWS = 2_000_000  # messages of a micro-batch, about


def messages(spark, sf, late: bool = False, marker_every: int | None = None, batches: int = 1) -> str:
    """The transactions as message files in arrival order; returns the folder.

    They are written in ``batches`` spans of arrival time, one after another, with ``CONSUMERS`` files each;
    in more spans if these would hold more than ``BATCH_ROWS`` messages on average.
    """
    base = d(spark, sf)
    delay = F.make_dt_interval(secs=F.when(F.col("k") % 4 == 0, 120).otherwise(0))
    arrives = F.col("timestamp") + delay if late else F.col("timestamp")
    text = F.to_json(F.struct(*_EVENTS), {
        "ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    if marker_every:
        text = F.when(F.col("offset") % marker_every == 0, F.lit('{"__flush": true}')).when(
            F.col("offset") % marker_every == 1, F.lit("not json")).otherwise(text)
    path = scratch_path(spark, "messages")

    def lines() -> DataFrame:
        placed = running_position(
            base.select(*_EVENTS, "event_id", "k", arrives.alias("arrived"),
                        V.consumer_of("payer_id", CONSUMERS).alias("partition")),
            ["arrived", "event_id"], ["partition"], out="offset")
        return placed.select(text.alias("value"), "partition", "offset", "arrived")

    def write(part: DataFrame) -> None:
        (part.write.mode("append").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
         .option("compression", "gzip").json(path))

    if batches == 1:
        write(lines())
        return path
    lines = settled(spark, lines, "lines")
    ends = lines.agg(F.min(epoch_micros("arrived")).alias("low"), F.max(epoch_micros("arrived")).alias("high"),
                     F.count(F.lit(1)).alias("n")).first()
    batches = max(batches, -(-ends.n // BATCH_ROWS))
    span = F.floor((epoch_micros("arrived") - F.lit(ends.low)) * batches / F.lit(ends.high - ends.low + 1))
    with settings(spark, LEAN):
        for i in range(batches):
            write(lines.where(span == i).repartition(CONSUMERS))
    drop(lines)
    return path


def collected(stream: DataFrame) -> DataFrame:
    """Run a stream over all available input into a table and read it back."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")
    run = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def parsed(spark, sf, path: str | None = None, **how) -> DataFrame:
    """The parsed stream, of the messages in ``path`` if there are any yet; with ``batches`` in as many micro-batches."""
    V.use_state_store(spark)
    files = CONSUMERS if how.get("batches", 1) > 1 else None
    return V.parse_events(source_stream_events(spark, path or messages(spark, sf, **how), max_files=files), EVENT)


@query("source_stream_events", WITH_TX + f"""
SELECT transaction_id AS key, {_PART} AS partition, row_number() OVER (PARTITION BY {_PART}
    ORDER BY timestamp, event_id) - 1 AS "offset" FROM tx""")
def _source(spark, sf):
    raw = source_stream_events(spark, messages(spark, sf))
    return collected(raw).select(F.get_json_object("value", "$.transaction_id").alias("key"),
                                  "partition", "offset")


@query("st_parse_filter", WITH_D + f""", a AS (SELECT *, row_number() OVER (PARTITION BY {_PART}
    ORDER BY timestamp, event_id) - 1 AS place FROM d)
SELECT transaction_id, timestamp, amount, merchant_id FROM a WHERE place % 50 > 1""")
def _parse(spark, sf):
    return collected(parsed(spark, sf, marker_every=50)).select(
        "transaction_id", "timestamp", "amount", "merchant_id")


@query("st_dead_letters", WITH_D + f""", a AS (SELECT {_PART} AS part, row_number() OVER (
    PARTITION BY {_PART} ORDER BY timestamp, event_id) - 1 AS place FROM d)
SELECT part AS partition, place AS "offset", 'not json' AS reason FROM a WHERE place % 50 = 1""")
def _dead(spark, sf):
    raw = source_stream_events(spark, messages(spark, sf, marker_every=50))
    return collected(V.dead_letters(raw, EVENT)).select("partition", "offset", "reason")


_ARRIVAL = f""", a AS (SELECT *, {_PART} AS part, row_number() OVER (ORDER BY timestamp + INTERVAL 1 SECOND
    * (CASE WHEN k % 4 = 0 THEN 120 ELSE 0 END), event_id) AS arrival FROM d),
late AS (SELECT transaction_id, amount, timestamp < max(timestamp) OVER (PARTITION BY part ORDER BY arrival)
    - INTERVAL 60 SECOND AS is_late_event FROM a)"""


@query("st_late_tag", WITH_D + _ARRIVAL + "SELECT transaction_id, is_late_event FROM late")
def _late(spark, sf):
    return collected(V.late_tag(parsed(spark, sf, late=True, batches=3))).select("transaction_id", "is_late_event")


@query("st_window_state", WITH_D + f" SELECT transaction_id, {window_sql(_ALL)} FROM d")
def _windows(spark, sf):
    stream = parsed(spark, sf, batches=3)
    partials = collected(K.window_state(stream))
    out = K.join_back(partials, stream.schema).select(
        "transaction_id", *[F.col(f"window_features.{f.name}").alias(W.PREFIX + f.name) for f in _ALL])
    return rounded(out, *_SUMS, digits=4)


@query("st_replay", WITH_D + f"""
SELECT transaction_id, {_PART} AS partition, row_number() OVER (PARTITION BY {_PART}
    ORDER BY timestamp, transaction_id) - 1 AS "offset" FROM d""")
def _replay(spark, sf):
    path = scratch_path(spark, "replay")
    V.replay(d(spark, sf).select(*_EVENTS), path, chunks=3, consumers=CONSUMERS)
    raw = source_stream_events(spark, path, max_files=CONSUMERS)
    return collected(V.parse_events(raw, EVENT)).select("transaction_id", "partition", "offset")


def _by_amount(df: DataFrame) -> DataFrame:
    return df.withColumn("risk_score", F.least(F.lit(1.0), F.col("amount") / 200))


def _scored_tables(spark, sf) -> tuple[DataFrame, ...]:
    """The whole scoring stream; returns the risk, alert and late tables."""
    folder, checkpoint = scratch_path(spark, "routed"), scratch_path(spark, "checkpoint")
    profiles = {"device": settled(spark, lambda: device_profile(d(spark, sf)), "device_profile")}  # each batch reads it
    path = messages(spark, sf, late=True, batches=3)
    stream = V.late_tag(parsed(spark, sf, path, batches=3))

    def score(batch: DataFrame) -> DataFrame:
        enriched = Z.enrich_stream_profiles(batch, profiles)
        return Z.score_events(enriched, _by_amount, "by_amount", "1")

    Z.scoring_stream(stream, folder, checkpoint, score).awaitTermination()
    for passed in (path, checkpoint):
        remove(spark, passed)
    drop(profiles["device"])
    return tuple(spark.read.parquet(f"{folder}/{n}")
                 for n in ("risk_results", "alert_events", "late_events"))


@query("st_score", WITH_D + """
SELECT transaction_id, round(risk_score, 6) AS risk_score, CASE WHEN risk_score >= 0.8 THEN 'high'
    WHEN risk_score >= 0.5 THEN 'medium' ELSE 'low' END AS risk_level,
    CASE WHEN risk_score >= 0.8 THEN 'reject' WHEN risk_score >= 0.5 THEN 'review' ELSE 'pass' END
    AS decision FROM d""")
def _score(spark, sf):
    risk, _, _ = _scored_tables(spark, sf)
    return rounded(risk.select("transaction_id", "risk_score", "risk_level", "decision"), "risk_score")


@query("sink_stream_route", WITH_D + _ARRIVAL + """
SELECT 'risk' AS sink, transaction_id FROM late
UNION ALL SELECT 'alert', transaction_id FROM late WHERE least(1.0, amount / 200) >= 0.8
UNION ALL SELECT 'late', transaction_id FROM late WHERE is_late_event""")
def _route(spark, sf):
    parts = zip(("risk", "alert", "late"), _scored_tables(spark, sf))
    risk, alert, late = (df.select(F.lit(name).alias("sink"), "transaction_id") for name, df in parts)
    return risk.unionByName(alert).unionByName(late)


@query("st_batch_worker", WITH_D + """
SELECT payer_id AS key, transaction_id, least(1.0, amount / 200) >= 0.8 AS alert FROM d""")
def _worker(spark, sf):
    """Scoring without event-time state: micro-batches scored, keyed by payer and written."""
    folder, checkpoint = scratch_path(spark, "worker"), scratch_path(spark, "checkpoint")
    stream = parsed(spark, sf).withColumn("is_late_event", F.lit(False))

    def handle(batch: DataFrame, batch_id: int) -> None:
        Z.route(Z.score_events(batch, _by_amount, "by_amount", "1"), folder, batch_id)

    (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    risk = spark.read.parquet(f"{folder}/risk_results")
    return risk.select("key", "transaction_id", (F.col("risk_level") == "high").alias("alert"))


# Weights, intercept and thresholds of the two published versions; fills of the contract.
SERVED = {
    "1": ({"amount": 0.01, "txn_count": -0.03, "txn_count_device": 0.04, "txn_count_ip": 0.02,
           "txn_count_merchant": -0.01, "payer_graph_degree": 0.005}, -1.0, (0.5, 0.8)),
    "2": ({"amount": 0.004, "txn_count": 0.02, "txn_count_device": -0.05, "txn_count_ip": 0.03,
           "txn_count_merchant": 0.01, "payer_graph_degree": -0.004}, 0.5, (0.4, 0.7)),
}
SERVED_FILLS = {"amount": 0.0, "txn_count": 1.0, "txn_count_device": 2.0, "txn_count_ip": 3.0,
                "txn_count_merchant": 4.0, "payer_graph_degree": 0.0}


def _served_sql(version: str) -> str:
    weights, intercept, (medium, high) = SERVED[version]
    total = " + ".join(f"{w} * coalesce(CAST({c} AS DOUBLE), {SERVED_FILLS[c]})" for c, w in weights.items())
    kept = "TRUE" if version == "1" else "split = 'train'"
    count = lambda key: f"(SELECT {key}, count(*) AS n FROM d WHERE {kept} GROUP BY {key})"
    return f"""SELECT transaction_id, '{version}' AS model_version, 1 / (1 + exp(-({intercept} + {total})))
    AS risk_score, {medium} AS medium, {high} AS high
FROM (SELECT t.transaction_id, t.amount, p.n AS txn_count, v.n AS txn_count_device, i.n AS txn_count_ip,
        m.n AS txn_count_merchant, g.n AS payer_graph_degree
    FROM placed AS t LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT payer_id AS id FROM d WHERE {kept}
        UNION ALL SELECT payee_id FROM d WHERE {kept} AND merchant_id IS NULL) AS u GROUP BY id) AS p
        ON t.payer_id = p.id
    LEFT JOIN {count('device_id')} AS v ON t.device_id = v.device_id
    LEFT JOIN {count('ip_id')} AS i ON t.ip_id = i.ip_id
    LEFT JOIN {count('merchant_id')} AS m ON t.merchant_id = m.merchant_id
    LEFT JOIN (SELECT entity_id, count(*) AS n FROM (SELECT src_id AS entity_id FROM edges
        UNION ALL SELECT dst_id FROM edges) AS e GROUP BY entity_id) AS g ON t.payer_id = g.entity_id
    WHERE t.span {'= 0' if version == '1' else '> 0'}) AS f"""


@query("st_score_published", WITH_EDGES + f""", placed AS (SELECT *, floor((epoch_us(timestamp)
    - min(epoch_us(timestamp)) OVER ()) * 3.0 / (max(epoch_us(timestamp)) OVER () - min(epoch_us(timestamp))
    OVER () + 1)) AS span FROM d)
SELECT transaction_id, model_version, round(risk_score, 6) AS risk_score,
    CASE WHEN risk_score >= high THEN 'high' WHEN risk_score >= medium THEN 'medium' ELSE 'low' END AS risk_level,
    CASE WHEN risk_score >= high THEN 'reject' WHEN risk_score >= medium THEN 'review' ELSE 'pass' END AS decision
FROM ({_served_sql('1')} UNION ALL {_served_sql('2')}) AS s""")
def _score_published(spark, sf):
    """Stored models with four profiles and graph features; a second version, with other snapshots, is
    published after the first of three micro-batches."""
    base = cut(d(spark, sf), "log")
    folder, out, checkpoint = (scratch_path(spark, n) for n in ("served", "routed", "checkpoint"))
    contract = FeatureContract(tuple(SERVED_FILLS), (), SERVED_FILLS)
    degrees = cut(entity_degree(tx_edges(base)), "degrees")  # the same for both versions

    def put_in_force(version: str, rows: DataFrame) -> None:
        weights, intercept, cuts = SERVED[version]
        M.save_model(spark, linear_model(contract, weights, intercept), folder, version)
        tables = {}
        for kind, table in (all_profiles(rows) | {"entities": degrees}).items():
            tables[kind] = f"{folder}/snapshots/{version}/{kind}"
            table.write.parquet(tables[kind])
        M.publish(spark, folder, M.Publication("linear", version, Thresholds(*cuts), tables))

    put_in_force("1", base)
    score = Z.published_scorer(spark, folder)

    def handle(batch: DataFrame, batch_id: int) -> None:
        Z.route(score(batch), out, batch_id)
        if batch_id == 0:
            put_in_force("2", base.where(F.col("split") == "train"))

    stream = parsed(spark, sf, batches=3).withColumn("is_late_event", F.lit(False))
    (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return rounded(spark.read.parquet(f"{out}/risk_results").select(
        "transaction_id", "model_version", "risk_score", "risk_level", "decision"), "risk_score")


@query("sink_feedback_append", WITH_TX + """
SELECT transaction_id, CAST(k % 2 AS INT) AS reviewed_is_fraud FROM tx WHERE k % 6 = 0""")
def _feedback(spark, sf):
    source, pool, checkpoint = (scratch_path(spark, n) for n in ("reviews", "pool", "checkpoint"))
    (tx(spark, sf).where(F.col("k") % 6 == 0)
     .select("transaction_id", (F.col("k") % 2).alias("label")).write.json(source))
    events = spark.readStream.schema("transaction_id string, label int, is_fraud int").json(source)
    Z.feedback_append(events, pool, checkpoint).awaitTermination()
    return spark.read.parquet(pool).select("transaction_id", "reviewed_is_fraud")
