"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

After Sanders, "Random permutations on distributed, external and hierarchical memory" (1998): how
many rows go from each partition to each shard is drawn first, with the law that a uniform
permutation would give; rows are then permuted inside their partition, sent by the drawn counts,
and permuted again inside their shard. The driver sees partition sizes only, at most ``PARTS`` of
them; every step on rows is a DataFrame operation on narrow rows.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.tables import cut
from ledgerlens.operators.ordering import running_position

PARTS = 4096


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` without replacement; inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    at_mode = math.exp(_log_choose(good, mode) + _log_choose(bad, draws - mode) - _log_choose(good + bad, draws))
    while True:
        left = rng.random() - at_mode
        if left < 0:
            return mode
        up, p_up, down, p_down = mode, at_mode, mode, at_mode
        while up < high or down > low:
            if up < high:
                p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
                up += 1
                left -= p_up
                if left < 0:
                    return up
            if down > low:
                p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
                down -= 1
                left -= p_down
                if left < 0:
                    return down
            if p_up < 1e-18 and p_down < 1e-18:
                break  # rounding left a sliver: draw again


def communication_matrix(sizes: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts from each partition to each shard; rows sum to ``sizes``, columns to ``shards``."""
    rng, room, matrix = random.Random(seed), list(shards), []
    for size in sizes:
        row, draws, rest = [], size, sum(room)
        for s, free in enumerate(room):
            rest -= free
            taken = hypergeometric(rng, free, rest, draws)
            row.append(taken)
            draws -= taken
            room[s] -= taken
        matrix.append(row)
    return matrix


def shuffle_to_shards(docs: DataFrame, shards: int = 16, seed: int = 17, id_col: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    Shard sizes differ by at most one and every assignment of rows to places is equally likely, so
    equal texts are spread like any others. ``slot`` counts from 0 without gaps. Null texts have
    size 1 and checksum 0, as empty ones have; null and repeated ids are ordinary rows. With fewer
    rows than shards the last shards stay empty.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text), F.lit(""))
    # Written once: partition numbers and row numbers are facts of one reading only.
    rows = cut(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw.cast("binary")).alias("crc"), F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part"),
        F.monotonically_increasing_id().alias("row")), "rows")
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    parts = sorted(sizes)
    bounds = []
    for part, row in zip(parts, communication_matrix([sizes[p] for p in parts], room, seed)):
        ends = [sum(row[:s + 1]) for s in range(shards)]
        bounds.append((part, ends))
    plan = spark.createDataFrame(bounds, "part int, ends array<bigint>")  # at most PARTS rows
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "row"), "row")
    sent = (rows.withColumn("place", F.row_number().over(local) - 1)
            .join(F.broadcast(plan), "part")
            .withColumn("shard", F.size(F.filter("ends", lambda end: end <= F.col("place"))))
            .withColumn("draw", F.xxhash64(F.lit(seed + 1), "row")))
    placed = running_position(sent.drop("ends", "part", "place"), ["draw", "row"], ["shard"], out="slot")
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
