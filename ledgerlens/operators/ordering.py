"""Positions, ranks, quantiles and top-k without a single-task window.

A bare window over a table, or over a group holding a third of it, runs in one task. Here the
table is range-sorted once, written, and each row's position is its offset inside its partition
plus the number of rows in earlier partitions; the table of partition sizes has one row per
partition (and group), so hot groups are split wherever the sort splits them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import cut

SLICES_PER_TASK = 8
_PARTITION_SHIFT = 33  # fixed value: bits below the partition number in monotonically_increasing_id


def _as_columns(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _sliced(df: DataFrame, by: Sequence[Column]) -> DataFrame:
    """``df`` sorted into more slices than there are tasks, so that tasks can take equal numbers."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(SLICES_PER_TASK * tasks, *by).sortWithinPartitions(*by)


def running_totals(
    df: DataFrame,
    order: Sequence[Column | str],
    totals: Mapping[str, str | None],
    group: Sequence[str] = (),
    whole: Mapping[str, str] | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """Totals over the rows before each row of its group in ``order``; 0 for the first.

    ``totals`` maps each output to the column it adds up, or to None to count rows; ``whole``
    maps further outputs to entries of ``totals`` whose complete group total is wanted.
    ``order`` should end in a unique column. ``few_groups`` says that the number of groups is
    bounded: totals of slices are then broadcast, and slices dealt evenly over the tasks.
    """
    group, whole = list(group), dict(whole or {})
    by = [*[F.col(g) for g in group], *_as_columns(order)]
    stored = cut(
        (_sliced(df, by) if few_groups else df.orderBy(*by)).withColumn("_rt_slot", F.monotonically_increasing_id()),
        "sorted",
    ).withColumn("_rt_part", F.shiftright("_rt_slot", _PARTITION_SHIFT))
    piece = ["_rt_part", *group]
    sizes = stored.groupBy(*piece).agg(F.min("_rt_slot").alias("_rt_first"), *[
        (F.count(F.lit(1)) if column is None else F.sum(column)).alias(f"_rt_size_{name}")
        for name, column in totals.items()])
    by_group = Window.partitionBy(*group)
    earlier = by_group.orderBy("_rt_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *[F.col(c).alias(f"_rt_k_{c}") for c in piece], "_rt_first",
        *[F.coalesce(F.sum(f"_rt_size_{name}").over(earlier), F.lit(0)).alias(f"_rt_before_{name}")
          for name in totals],
        *[F.sum(f"_rt_size_{name}").over(by_group).alias(out) for out, name in whole.items()],
    )
    if few_groups or not group:
        sizes = F.broadcast(sizes)  # one row per partition of the sort, and per group
    if few_groups:
        stored = stored.repartitionByRange("_rt_part")
    match = [F.col(c).eqNullSafe(F.col(f"_rt_k_{c}")) for c in piece]
    local = (Window.partitionBy(*piece).orderBy("_rt_slot")
             .rowsBetween(Window.unboundedPreceding, -1))
    results = []
    for name, column in totals.items():
        inside = (F.col("_rt_slot") - F.col("_rt_first") if column is None
                  else F.coalesce(F.sum(column).over(local), F.lit(0)))
        results.append((F.col(f"_rt_before_{name}") + inside).alias(name))
    return (stored.join(sizes, match, "inner")
            .select(*df.columns, *results, *whole))


def running_position(
    df: DataFrame,
    order: Sequence[Column | str],
    group: Sequence[str] = (),
    weight: str | None = None,
    out: str = "position",
    total: str | None = None,
) -> DataFrame:
    """Rows (or total ``weight``) before each row; ``total`` also adds the group's whole."""
    return running_totals(df, order, {out: weight}, group, {total: out} if total else None)


def neighbours(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], value: str,
               before: str, after: str) -> DataFrame:
    """Add the ``value`` of the previous and of the next row of the same group; null at its ends.

    The table is range-sorted into slices and written. Inside a slice a row looks at its neighbour;
    at its edges it gets what the adjoining slice passes on, through a table of one row per slice.
    So a group is cut wherever the sort cuts it, and no task holds more than a slice. ``order``
    should end in a unique column.
    """
    stored = cut(
        _sliced(df, [*[F.col(g) for g in group], *_as_columns(order)]).withColumn("_nb_slot", F.monotonically_increasing_id()),
        "sorted",
    ).withColumn("_nb_part", F.shiftright("_nb_slot", _PARTITION_SHIFT))
    own = F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], F.col(value).alias("v"))
    slices = Window.orderBy("_nb_part")  # one row per slice
    edges = F.broadcast(stored.groupBy("_nb_part").agg(F.min_by(own, "_nb_slot").alias("first"), F.max_by(own, "_nb_slot").alias("last"))
                        .select(F.col("_nb_part").alias("_nb_key"), F.lag("last").over(slices).alias("_nb_left"),
                                F.lead("first").over(slices).alias("_nb_right")))
    inside = Window.partitionBy("_nb_part").orderBy("_nb_slot")
    seen = stored.repartitionByRange("_nb_part").join(edges, F.col("_nb_part") == F.col("_nb_key")).withColumns({
        "_nb_left": F.coalesce(F.lag(own).over(inside), F.col("_nb_left")),
        "_nb_right": F.coalesce(F.lead(own).over(inside), F.col("_nb_right"))})

    def same(side: str) -> Column:
        alike = F.col(side).isNotNull()
        for i, g in enumerate(group):
            alike &= F.col(g).eqNullSafe(F.col(f"{side}.g{i}"))
        return F.when(alike, F.col(f"{side}.v"))

    return seen.select(*df.columns, same("_nb_left").alias(before), same("_nb_right").alias(after))


def _value_counts(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    return (df.where(F.col(value).isNotNull()).groupBy(*group, value)
            .agg(F.count(F.lit(1)).alias("_weight")))


def pct_rank_avg(df: DataFrame, value: str, out: str, group: Sequence[str] = ()) -> DataFrame:
    """Average-tie percent rank in (0, 1]; null values rank 0.

    Equal values collapse to one counted row first, so a value shared by many rows costs one row.
    ``df`` is read twice: write it first (``cut``) if ``value`` is a sum or mean of floating-point
    numbers, whose last digits vary between runs.
    """
    group = list(group)
    placed = running_position(_value_counts(df, value, group), [value], group, "_weight",
                              out="_below", total="_all")
    ranks = placed.select(
        *[F.col(g).alias(f"_r_{g}") for g in group], F.col(value).alias("_r_value"),
        ((F.col("_below") + (F.col("_weight") + 1) / F.lit(2.0)) / F.col("_all")).alias(out),
    )
    match = [F.col(g).eqNullSafe(F.col(f"_r_{g}")) for g in group]
    match.append(F.col(value) == F.col("_r_value"))
    return (df.join(ranks, match, "left")
            .select(*df.columns, F.coalesce(F.col(out), F.lit(0.0)).alias(out)))


def exact_quantiles(
    df: DataFrame, value: str, quantiles: dict[str, float], group: Sequence[str] = (),
) -> DataFrame:
    """Linear-interpolation quantiles per group; one output column per entry of ``quantiles``."""
    group = list(group)
    placed = running_position(_value_counts(df, value, group), [value], group, "_weight",
                              out="_below", total="_all")
    upto = F.col("_below") + F.col("_weight")
    aggs = []
    for name, q in quantiles.items():
        at = F.lit(float(q)) * (F.col("_all") - 1)
        for side, spot in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("_below") <= spot) & (spot < upto)
            aggs.append(F.max(F.when(inside, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
    found = placed.groupBy(*group).agg(F.max("_all").alias("_all"), *aggs)
    outputs = []
    for name, q in quantiles.items():
        at = F.lit(float(q)) * (F.col("_all") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outputs.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select(*group, *outputs)


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int,
    out: str = "place",
) -> DataFrame:
    """First ``k`` rows of each group; ``out`` is the 1-based place.

    Spark keeps ``k`` rows per group in every map task before the shuffle (window group limit),
    so the task of a hot group receives ``k`` rows from each map task.
    """
    ranked = Window.partitionBy(*group).orderBy(*_as_columns(order))
    return df.withColumn(out, F.row_number().over(ranked)).where(F.col(out) <= k)
