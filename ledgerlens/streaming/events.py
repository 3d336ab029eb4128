"""Parsing, late tagging and replay of event streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlens import schema as S
from ledgerlens.functions.hashing import stable_hash
from ledgerlens.functions.scalar import add_micros, epoch_micros
from ledgerlens.operators.derive import ts_coerce
from ledgerlens.operators.ordering import running_totals
from ledgerlens.session import cut
from ledgerlens.streaming import bundles

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MARKER = "__flush"  # key of a control message


def use_state_store(spark) -> None:
    """State of the keyed processors lives in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _readable(event: Column) -> Column:
    return F.try_parse_json("value").isNotNull() & event["transaction_id"].isNotNull()


def parse_events(raw: DataFrame, schema: T.StructType = S.STREAM_SCHEMA, marker: str = MARKER) -> DataFrame:
    """Events of raw messages; control markers are left out, unreadable lines go to ``dead_letters``.

    A time may be ISO text with or without a zone; one that is missing or unreadable is the time of
    arrival.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType() if f.name == "timestamp" else f.dataType)
                            for f in schema])
    arrived = F.col("arrived") if "arrived" in raw.columns else F.lit(None).cast("timestamp_ntz")
    parsed = raw.withColumn("_e", F.from_json("value", as_text)).where(
        F.get_json_object("value", f"$.{marker}").isNull() & _readable(F.col("_e")))
    others = [c for c in raw.columns if c != "value"]
    micros = F.round(ts_coerce(F.col("_e.timestamp"), arrived) * 1e6).cast("bigint")
    fields = [add_micros(F.lit("1970-01-01 00:00:00"), micros).alias(f.name) if f.name == "timestamp"
              else F.col("_e")[f.name].alias(f.name) for f in schema]
    return parsed.select(*others, *fields)


def dead_letters(raw: DataFrame, schema: T.StructType = S.STREAM_SCHEMA, marker: str = MARKER) -> DataFrame:
    """Messages that are neither events nor control markers, as they came, with the reason."""
    reason = F.when(F.try_parse_json("value").isNull(), "not json").otherwise("no transaction_id")
    event = F.from_json("value", schema)
    return raw.where(F.coalesce(F.get_json_object("value", f"$.{marker}").isNull(), F.lit(True))
                     & ~F.coalesce(_readable(event), F.lit(False))).withColumn("reason", reason)


class _LateTagger(StatefulProcessor):
    """Highest event time seen by one consumer."""

    def __init__(self, allowed_us: int):
        self.allowed_us = allowed_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = bundles.read(rows)
        order = np.argsort(batch["offset"].to_numpy(), kind="stable")
        us = pd.Series(batch["event_us"].to_numpy()[order])
        seen = self.top.get()[0] if self.top.exists() else None
        high = us.cummax().ffill()  # an event without a time is not late
        if seen is not None:
            high = high.fillna(seen).clip(lower=seen)
        if high.notna().iloc[-1]:
            self.top.update((int(high.iloc[-1]),))
        late = np.empty(len(us), dtype=bool)
        late[order] = us < high - self.allowed_us
        yield from bundles.written(batch.append_column("is_late_event", pa.array(late)))

    def close(self) -> None:
        pass


def consumer_of(key: str, consumers: int) -> Column:
    """The partition a topic keyed by ``key`` would put a message in."""
    return (stable_hash(F.coalesce(F.col(key), F.lit(""))) % consumers).cast("int")


def late_tag(events: DataFrame, allowed_seconds: int = 60, consumer: str = "partition") -> DataFrame:
    """Tag events older than their consumer's latest time minus the allowance; none is dropped.

    Needs ``offset`` for arrival order. One consumer is one source partition, so the parallelism
    is that of the topic.
    """
    timed = events.withColumn("event_us", epoch_micros("timestamp"))
    out = T.StructType([*timed.schema.fields, T.StructField("is_late_event", T.BooleanType())])
    tagged = (bundles.bundled(timed.withColumn("_consumer", F.col(consumer)), "_consumer")
              .groupBy("_consumer").transformWithStateInPandas(
        statefulProcessor=_LateTagger(allowed_seconds * 1_000_000), outputStructType="rows binary",
        outputMode="Append", timeMode="None"))
    spread = tagged.repartition(F.xxhash64("rows"))  # few consumers, but what follows needs all tasks
    return bundles.opened(spread, out).withColumn("event_time_unix", F.col("event_us") / 1e6)


def replay(df: DataFrame, path: str, chunks: int = 4, consumers: int = 8,
           order=("timestamp", "transaction_id")) -> None:
    """Write ``df`` as message files in arrival order, to be read as a stream.

    Messages go to consumers by payer, as a topic keyed by payer would send them. Each chunk is a
    later write with one file per consumer, so a file source takes the chunks in order.
    """
    keyed = df.withColumn("partition", consumer_of("payer_id", consumers))
    placed = running_totals(keyed, order, {"offset": None}, ["partition"], whole={"_n": "offset"})
    message = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    messages = cut(placed.select(
        message.alias("value"), "partition", "offset", F.col(order[0]).alias("arrived"),
        F.floor(F.col("offset") * chunks / F.col("_n")).cast("int").alias("chunk")), "replay")
    for i in range(chunks):
        (messages.where(F.col("chunk") == i).drop("chunk").repartition(consumers, "partition")
         .sortWithinPartitions("partition", "offset").write.mode("append").json(path))
