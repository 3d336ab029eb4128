"""Event-time window features: counts, sums and distinct counts over the last W seconds.

Each row becomes an arrival at its own time and an expiry W seconds later, so a sliding count or
sum is a running total of +v and -v. A distinct count is the number of values whose presence has
begun and not yet run out: a row begins a presence when the same value was not seen in the W
seconds before it, and its expiry ends one when the value does not come again within W seconds.

Work is partitioned by (key, time bucket of the longest window), so a busy key is spread over its
buckets; the expiries of a bucket's rows fall into the same or the next bucket, which is all the
history a bucket needs. Everything is one shuffle per key and linear in the rows.

A bucket that is too large for one task, such as an hour of all rows without a key, is sorted into
slices of equal size over many tasks. A slice hands over its total to the later ones, and the last
time it saw of a value to the next one, so figures are the same and no task reads a whole bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalar import epoch_micros
from ledgerlens.operators.ordering import neighbours, running_totals
from ledgerlens.session import cut

PREFIX = "window_features_"
HOT_RECORDS = 2_000_000  # arrivals and expiries that one task takes of one key and bucket
MOST_LARGE = 100_000  # buckets that are sliced, at most; each holds more than this part of all records


@dataclass(frozen=True)
class Feature:
    """One output column: ``kind`` is count, sum or distinct over ``seconds`` of ``column``."""

    name: str
    kind: str
    seconds: int
    column: str | None = None


# Names and spans of the ten features.
USER_5MIN = (
    Feature("user_txn_count_5min", "count", 300),
    Feature("user_amount_sum_5min", "sum", 300, "amount"),
)
USER_1H = (
    Feature("user_txn_count_1h", "count", 3600),
    Feature("user_amount_sum_1h", "sum", 3600, "amount"),
    Feature("user_unique_payee_count_1h", "distinct", 3600, "payee_id"),
)
DEVICE_10MIN = (Feature("device_unique_user_count_10min", "distinct", 600, "payer_id"),)
IP_10MIN = (Feature("ip_unique_user_count_10min", "distinct", 600, "payer_id"),)
MERCHANT_1H = (
    Feature("merchant_txn_count_1h", "count", 3600),
    Feature("merchant_amount_sum_1h", "sum", 3600, "amount"),
    Feature("merchant_unique_user_count_1h", "distinct", 3600, "payer_id"),
)
BY_KEY = {
    "payer_id": USER_5MIN + USER_1H,
    "device_id": DEVICE_10MIN,
    "ip_id": IP_10MIN,
    "merchant_id": MERCHANT_1H,
}
FEATURE_COLUMNS = tuple(PREFIX + f.name for group in BY_KEY.values() for f in group)


def sliding_features(
    df: DataFrame,
    key: str,
    features: Sequence[Feature],
    time: str = "timestamp",
    order: Sequence[str] = ("transaction_id",),
    ties: str = "exact",
    prefix: str = PREFIX,
    hot_records: int = HOT_RECORDS,
    large: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Add ``features`` over rows sharing ``key`` (missing keys form one group).

    ``ties="exact"`` lets a row see only the equal-time rows that precede it in ``order``;
    ``ties="peers"`` lets it see all of them. Buckets of more than ``hot_records`` arrivals and
    expiries are sliced over several tasks; ``large`` names them if they are known already.
    """
    spans = sorted({f.seconds for f in features}, reverse=True)
    width = spans[0] * 1_000_000
    for f in features:
        if f.kind == "distinct" and f.seconds != spans[0]:
            raise ValueError("distinct counts must use the longest span of the call")
    columns = sorted({f.column for f in features if f.column})
    shifts = F.array(*[F.lit(s * 1_000_000).cast("bigint") for s in (0, *spans)])
    records = (
        df.select(
            "*", F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"),
            epoch_micros(time).alias("_us"), F.struct(*order).alias("_seq"),
            *[F.col(c).alias(f"_c_{c}") for c in columns], F.explode(shifts).alias("_after"))
        .withColumn("_at", F.col("_us") + F.col("_after"))
        .withColumn("_start", F.col("_at") - F.pmod(F.col("_at"), F.lit(width)))
        # Expiries carry no payload.
        .withColumns({c: F.when(F.col("_after") == 0, F.col(c)) for c in df.columns})
    )
    names = [prefix + f.name for f in features]
    if large is None:
        large = _large_buckets(df, {key: features}, time, hot_records)
    if key not in large:
        return _in_tasks(records, features, width, ties, prefix).select(*df.columns, *names)
    large = large[key]
    cold = records.join(large, _BUCKET, "left_anti")
    hot = records.join(large, _BUCKET, "left_semi")
    return (_in_tasks(cold, features, width, ties, prefix).select(*df.columns, *names)
            .unionAll(_in_slices(hot, features, width, ties, prefix).select(*df.columns, *names)))


_BUCKET = ["_key", "_start"]


def _large_buckets(df: DataFrame, features: Mapping[str, Sequence[Feature]], time: str,
                   hot_records: int) -> dict[str, DataFrame]:
    """(_key, _start) of the buckets that may hold more than ``hot_records`` records, by key column.

    One pass counts the rows of all keys; a row's expiries fall into its bucket and the next, so
    both count as large. At most ``MOST_LARGE`` buckets of a key, so the tables may be broadcast:
    among more of them, only those that hold more than that part of all rows.
    """
    rows = df.count()
    if rows * max(1 + len({f.seconds for f in wanted}) for wanted in features.values()) <= hot_records:
        return {}  # no bucket can hold more than all there is
    us = epoch_micros(time)
    entries = []
    for key, wanted in features.items():
        width = max(f.seconds for f in wanted) * 1_000_000
        per_row = 1 + len({f.seconds for f in wanted})
        entries.append(F.struct(
            F.lit(key).alias("name"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"),
            (us - F.pmod(us, F.lit(width))).alias("at"), F.lit(width).cast("bigint").alias("width"),
            F.lit(hot_records / (2 * per_row)).alias("most")))
    sizes = cut(df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").groupBy("name", "_key", "at", "width", "most")
                .agg(F.count(F.lit(1)).alias("n")).where("n > most"), "large")
    out = {}
    for row in sizes.groupBy("name").count().collect():  # one row per key column
        table = sizes.where(F.col("name") == row["name"])
        if 2 * row["count"] > MOST_LARGE:
            table = table.where(F.col("n") > 2 * rows / MOST_LARGE)
        out[row["name"]] = F.broadcast(table.select(
            "_key", F.explode(F.array("at", F.col("at") + F.col("width"))).alias("_start")).distinct())
    return out


def _presence(records: DataFrame, column: str, width: int) -> DataFrame:
    """Steps and carry of the distinct count of a column, from its neighbours of the same value."""
    value = F.col(f"_c_{column}").cast("string")
    arrival, longest = F.col("_after") == 0, F.col("_after") == width
    held = (arrival | longest) & value.isNotNull() & (value != "")
    return records.withColumns({
        f"_step_{column}": F.when(held & arrival & (F.col("_earlier").isNull()
                                  | (F.col("_earlier") < F.col("_us") - width)), F.lit(1))
        .when(held & longest & (F.col("_later").isNull() | (F.col("_later") > F.col("_at"))), F.lit(-1)).otherwise(F.lit(0)),
        f"_carry_{column}": F.when(held & longest & (F.col("_later").isNull()
                                   | (F.col("_later") >= F.col("_start"))), F.lit(1)).otherwise(F.lit(0)),
    }).drop("_earlier", "_later")


def _distinct_columns(features: Sequence[Feature]) -> list[str]:
    return sorted({f.column for f in features if f.kind == "distinct"})


def _step(f: Feature) -> tuple[Column, Column]:
    """What a record adds to a feature, and what it has added before its bucket began."""
    if f.kind == "distinct":
        return F.col(f"_step_{f.column}"), F.col(f"_carry_{f.column}")
    if f.kind == "count":
        amount, none = F.lit(1), F.lit(0)
    else:
        amount, none = F.coalesce(F.col(f"_c_{f.column}"), F.lit(0.0)), F.lit(0.0)
    expires = F.col("_after") == f.seconds * 1_000_000
    step = F.when(F.col("_after") == 0, amount).when(expires, -amount).otherwise(none)
    return step, F.when(expires & (F.col("_us") < F.col("_start")), amount).otherwise(none)


def _in_tasks(records: DataFrame, features: Sequence[Feature], width: int, ties: str, prefix: str) -> DataFrame:
    """Features of buckets that fit a task: one shuffle, and the sorts work inside it."""
    records = records.repartition(*_BUCKET)
    distinct = _distinct_columns(features)
    if distinct:
        records = records.withColumn("_brief", (F.col("_after") != 0) & (F.col("_after") != width))
    for c in distinct:
        same = Window.partitionBy(*_BUCKET, f"_c_{c}", "_brief").orderBy("_us", "_seq", "_after")
        records = _presence(records.withColumns({"_earlier": F.lag("_us").over(same), "_later": F.lead("_us").over(same)}), c, width)
    ordered = Window.partitionBy(*_BUCKET).orderBy("_at", "_after", "_seq")
    if ties == "peers":
        running = (Window.partitionBy(*_BUCKET).orderBy("_at", "_after")
                   .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    else:
        running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    outputs = []
    for f in features:
        step, carry = _step(f)
        outputs.append((F.sum(step).over(running) + F.sum(carry).over(whole)).alias(prefix + f.name))
    return records.select("*", *outputs).where(F.col("_after") == 0)


def _in_slices(records: DataFrame, features: Sequence[Feature], width: int, ties: str, prefix: str) -> DataFrame:
    """The same figures for buckets of any size, by slices that hand over to one another."""
    distinct = _distinct_columns(features)
    if distinct:
        records = records.withColumn("_brief", (F.col("_after") != 0) & (F.col("_after") != width))
    for c in distinct:
        near = neighbours(records, [*_BUCKET, f"_c_{c}", "_brief"], ["_us", "_seq", "_after"], "_us", "_earlier", "_later")
        records = _presence(near, c, width)
    steps = {f"_s{i}": _step(f)[0] for i, f in enumerate(features)}
    carries = {f"_c{i}": _step(f)[1] for i, f in enumerate(features)}
    rows = records.withColumns(steps | carries)
    moments = [*_BUCKET, "_at", "_after"]
    order = ["_at", "_after", "_seq"]
    if ties == "peers":  # rows of one time see all of them: one row per time is placed, then joined back
        order = ["_at", "_after"]
        rows = rows.groupBy(*moments).agg(*[F.sum(c).alias(c) for c in (*steps, *carries)])
    totals = {f"_t{i}": f"_s{i}" for i in range(len(features))} | {f"_u{i}": f"_c{i}" for i in range(len(features))}
    placed = running_totals(rows, order, totals, _BUCKET, {f"_w{i}": f"_u{i}" for i in range(len(features))},
                            few_groups=True)
    outputs = [(F.col(f"_t{i}") + F.col(f"_s{i}") + F.col(f"_w{i}")).alias(prefix + f.name) for i, f in enumerate(features)]
    placed = placed.where(F.col("_after") == 0)
    if ties == "peers":
        return records.where(F.col("_after") == 0).join(placed.select(*moments, *outputs), moments)
    return placed.select("*", *outputs)


def window_features(
    df: DataFrame,
    keys: Sequence[str] = tuple(BY_KEY),
    time: str = "timestamp",
    order: Sequence[str] = ("transaction_id",),
    ties: str = "exact",
    step: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """The ten features of a transaction table, prefixed ``window_features_``; zeros without time.

    The table passes ``step`` after the features of each key.
    """
    if time not in df.columns:
        return df.select("*", *[F.lit(0.0).alias(PREFIX + f.name) for k in keys for f in BY_KEY[k]])
    large = _large_buckets(df, {key: BY_KEY[key] for key in keys}, time, HOT_RECORDS)
    for key in keys:
        df = step(sliding_features(df, key, BY_KEY[key], time, order, ties, large=large))
    return df


def late_flag(df: DataFrame, time: str, consumer: Sequence[str], arrival: str,
              allowed_seconds: int = 60, out: str = "is_late_event") -> DataFrame:
    """Tag rows older than the running maximum time of their consumer minus the allowance.

    The running maximum is taken inside fixed slices of ``arrival`` and combined with the
    maximum of the earlier slices, so one consumer's log is not read by a single task.
    """
    sliced = df.withColumn("_slice", F.shiftright(F.col(arrival).cast("bigint"), 20))
    sliced = sliced.withColumn("_us", epoch_micros(time))
    tops = sliced.groupBy(*consumer, "_slice").agg(F.max("_us").alias("_top"))
    before = (Window.partitionBy(*consumer).orderBy("_slice")
              .rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(*[F.col(c).alias(f"_k_{c}") for c in consumer],
                       F.col("_slice").alias("_k_slice"), F.max("_top").over(before).alias("_seen"))
    match = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in consumer]
    match.append(F.col("_slice") == F.col("_k_slice"))
    inside = (Window.partitionBy(*consumer, "_slice").orderBy(arrival)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    high = F.greatest(F.max("_us").over(inside), F.col("_seen"))
    return (sliced.join(tops, match, "inner")
            .withColumn(out, F.col("_us") < high - allowed_seconds * 1_000_000)
            .select(*df.columns, out))
