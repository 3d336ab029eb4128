"""Readers and writers of the pipeline's own tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import schema as S
from ledgerlens.functions.scalar import number_or
from ledgerlens.operators.ordering import running_position, top_per_group

# Columns that ring mining reads, and those read as numbers.
MINING_COLUMNS = (
    "transaction_id", "source", "timestamp", "amount", "payer_id", "payee_id", "merchant_id",
    "device_id", "ip_id", "is_fraud", "is_injected", "fraud_group_id", "injection_scenario",
    "scenario_step",
)
MINING_NUMBERS = {"amount": "double", "is_fraud": "tinyint", "is_injected": "tinyint"}


def scan_splits(log: DataFrame, splits: Sequence[str], columns: Sequence[str] = MINING_COLUMNS,
                numbers: Mapping[str, str] = MINING_NUMBERS, tag: str = "part") -> DataFrame:
    """Chosen splits of a table partitioned by ``split``, tagged, with missing columns as null."""
    out = []
    for name in columns:
        value = F.col(name) if name in log.columns else F.lit(None).cast("string")
        if name in numbers:
            value = number_or(value, 0).cast(numbers[name])
        out.append(value.alias(name))
    return log.where(F.col("split").isin(*splits)).select(*out, F.col("split").alias(tag))


def scan_jsonl_events(spark: SparkSession, path: str, schema: T.StructType = S.STREAM_SCHEMA,
                      limit: int | None = None) -> DataFrame:
    """JSON-lines events; blank lines are skipped."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return rows if limit is None else rows.limit(limit)


def sink_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def sink_splits(df: DataFrame, path: str) -> None:
    """One folder per split, so that readers of one split touch nothing else."""
    (df.write.mode("overwrite").option("compression", "snappy").partitionBy("split").parquet(path))


def first_by_time(tx: DataFrame, limit: int) -> DataFrame:
    placed = running_position(tx, ("timestamp", "transaction_id"), out="_at")
    return placed.where(F.col("_at") < limit).drop("_at")


def event_stream_rows(tx: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows by time (None: all), as stream columns."""
    rows = tx.select(*S.STREAM_COLUMNS)
    return rows if limit is None else first_by_time(rows, limit)


def event_stream_rows_mixed(tx: DataFrame, limit: int | None) -> DataFrame:
    """Injected rows claim the limit first; the earliest other rows fill what is left."""
    rows = tx.select(*S.STREAM_COLUMNS, *S.AUGMENTED_COLUMNS).withColumn(
        "_injected", F.coalesce(F.col("is_injected") == 1, F.lit(False)))
    if limit is None:
        return rows.drop("_injected")
    claimed = rows.agg(F.count_if("_injected").alias("n")).scalar()
    placed = running_position(rows, ("timestamp", "transaction_id"), ["_injected"], out="_at")
    room = F.greatest(F.lit(limit) - claimed, F.lit(0))
    keep = F.when(F.col("_injected"), F.col("_at") < limit).otherwise(F.col("_at") < room)
    return placed.where(keep).drop("_at", "_injected")


def sink_event_stream(rows: DataFrame, path: str) -> None:
    """JSON lines in time order with ISO times; null fields are written."""
    (rows.orderBy("timestamp", "transaction_id").write.mode("overwrite")
     .option("ignoreNullFields", False)
     .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS").json(path))


def iso_time(value: Column) -> Column:
    """ISO text with microseconds only where there are any."""
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    fine = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(fine.endswith(".000000"), whole).otherwise(fine)


def profile_kv(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """(``prefix:id``, JSON payload) per row with an id; nulls stay JSON null, times are ISO."""
    if key not in df.columns:
        raise ValueError(f"missing key column {key!r} for prefix {prefix!r}")
    is_time = (T.TimestampType, T.TimestampNTZType)
    fields = [(iso_time(F.col(f.name)) if isinstance(f.dataType, is_time) else F.col(f.name))
              .alias(f.name) for f in df.schema.fields]
    payload = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.where(F.col(key).isNotNull()).select(
        F.concat(F.lit(f"{prefix}:"), F.col(key)).alias("key"), payload.alias("value"))


# Key column and prefix of each projected table.
KV_TABLES = {
    "user": ("user_id", "profile:user"), "merchant": ("merchant_id", "profile:merchant"),
    "device": ("device_id", "profile:device"), "ip": ("ip_id", "profile:ip"),
    "graph": ("entity_id", "profile:graph"),
}


def sink_profile_kv(tables: Mapping[str, DataFrame], path: str) -> None:
    for kind, df in tables.items():
        key, prefix = KV_TABLES[kind]
        profile_kv(df, key, prefix).write.mode("overwrite").parquet(f"{path}/kind={kind}")


def tail_topic(messages: DataFrame, limit: int = 20) -> DataFrame:
    """Last ``limit`` messages by (partition, offset).

    ``messages``: partition, offset, key, value (text), as a batch read of a topic returns them.
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    tails = top_per_group(messages, ["partition"], [F.desc("offset")], limit, "_place").drop("_place")
    last = tails.orderBy(F.desc("partition"), F.desc("offset")).limit(limit)
    return last.withColumn("is_json", F.try_parse_json("value").isNotNull())


def source_stream_events(spark: SparkSession, path: str | None = None,
                         bootstrap: str | None = None, topic: str = "transaction_events",
                         max_files: int | None = None, max_offsets: int = 1_000_000) -> DataFrame:
    """Raw messages (value, partition, offset, arrived) from a topic, or from files in tests.

    A micro-batch takes at most ``max_offsets`` messages of a topic, or ``max_files`` files.
    """
    if bootstrap:
        raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
               .option("subscribe", topic).option("startingOffsets", "earliest")
               .option("maxOffsetsPerTrigger", max_offsets).load())
        return raw.select(F.col("value").cast("string").alias("value"), "partition", "offset",
                          F.col("timestamp").cast("timestamp_ntz").alias("arrived"))
    reader = spark.readStream.schema(
        "value string, partition int, offset bigint, arrived timestamp_ntz")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def feature_store_lookup(df: DataFrame, index: DataFrame, table: str, root: str = "") -> DataFrame:
    """Left join of a listed feature table; ``index``: table, path, join_key, description."""
    entry = index.where(F.col("table") == table).select("path", "join_key").first()
    if entry is None:
        raise KeyError(table)
    path = f"{root.rstrip('/')}/{entry.path}" if root else entry.path
    features = df.sparkSession.read.parquet(path)
    return df.join(features, entry.join_key, "left")


def rewrite_index(index: DataFrame, table: str, path: str) -> DataFrame:
    """The index with another path for one table."""
    return index.withColumn("path", F.when(F.col("table") == table, F.lit(path))
                            .otherwise(F.col("path")))
