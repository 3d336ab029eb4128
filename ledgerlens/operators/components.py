"""Connected components by alternating star contractions.

Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014. Each round is two
minimum aggregations and two joins on node ids; neighbours are never gathered into a list, so a
hub costs its edges, spread by partial aggregation and skew-join splitting. Every round is
written to the shared folder, which bounds lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import running_position
from ledgerlens.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("_e")).select("_e.*")
    low = both.groupBy("u").agg(F.min("v").alias("_m")).select(
        F.col("u").alias("_u"), F.least("u", "_m").alias("_low"))
    return (both.where(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("_u"))
            .select(F.col("v").alias("a"), F.col("_low").alias("b"))
            .where(F.col("a") != F.col("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    # Edges arrive with a > b: b is always the smaller end.
    low = edges.groupBy("a").agg(F.min("b").alias("_low")).withColumnRenamed("a", "_a")
    joined = edges.join(low, F.col("a") == F.col("_a"))
    moved = joined.select(F.explode(F.array(
        F.struct(F.col("b").alias("a"), F.col("_low").alias("b")),
        F.struct(F.col("a").alias("a"), F.col("_low").alias("b")))).alias("_e")).select("_e.*")
    return moved.where(F.col("a") != F.col("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node points at one root and no root points anywhere."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("points")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("points")))).alias("_e")).select("_e.*")
    nodes = ends.groupBy("node").agg(F.sum("points").alias("up"),
                                     F.count_if(F.col("points") == 0).alias("down"))
    return nodes.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst",
                         max_rounds: int = 60) -> DataFrame:
    """(node, component) for every endpoint; the component is its smallest node id.

    Ids are replaced by their position in sorted order, so rounds move and compare numbers, and
    the smallest number is still the smallest id.
    """
    pair = cut(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(
        F.col(src).alias("s"), F.col(dst).alias("t")).distinct(), "edges")
    names = pair.select(F.explode(F.array("s", "t")).alias("node")).distinct()
    ids = cut(running_position(names, ["node"], out="id"), "nodes")
    left = ids.select(F.col("node").alias("s"), F.col("id").alias("i"))
    right = ids.select(F.col("node").alias("t"), F.col("id").alias("j"))
    current = cut(pair.join(left, "s").join(right, "t").where(F.col("i") != F.col("j")).select(
        F.greatest("i", "j").alias("a"), F.least("i", "j").alias("b")).distinct(), "round")
    for _ in range(max_rounds):
        current = cut(_small_star(_large_star(current)), "round")
        if _settled(current):
            break
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    roots = ids.select(F.col("id").alias("_root"), F.col("node").alias("_name"))
    low = ids.join(current, F.col("id") == F.col("a"), "left").select(
        "node", F.coalesce("b", "id").alias("_low"))
    return low.join(roots, F.col("_low") == F.col("_root")).select(
        "node", F.col("_name").alias("component"))
