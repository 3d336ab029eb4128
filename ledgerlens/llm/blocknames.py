"""Exact deduplication by deterministic block naming (Karp, Miller and Rosenberg 1972).

A text's bytes are cut into blocks of ``BLOCK`` bytes. Distinct blocks are sorted and numbered;
then adjacent names are paired, distinct pairs sorted and numbered, and so on until each text has
one name. Texts are equal if and only if length and name are equal.

Blocks travel once: the distinct ones, combined before the shuffle, with a 128-bit digest. Texts
keep the digests of their blocks and look names up by them. A digest that two different blocks
share would join their names, so digests are checked against the blocks and drawn anew with other
seeds until none is shared. Copies of one block, however many, are one row after the first
combine; lookups by name are joins that adaptive execution splits where a name is frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import cut
from ledgerlens.operators.ordering import running_position

BLOCK = 1024


def _blocks(text: Column, size: int) -> Column:
    """The bytes of a text in blocks; an empty text has one empty block."""
    last = F.greatest(F.ceil(F.octet_length(text) / F.lit(size)).cast("int") - 1, F.lit(0))
    # The outer step binds the bytes once; cast inside the inner one, they would be copied per block.
    return F.transform(F.array(text.cast("binary")), lambda raw: F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size))))[0]


def _digest(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(2 * seed), block).alias("h"), F.xxhash64(F.lit(2 * seed + 1), block).alias("k"))


def _numbered(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Distinct rows with their place in sorted order as integer name."""
    return cut(running_position(distinct, order, out="name"), "names")


def identities(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(row, id, bytes, sha, name) per row of ``docs``; equal texts share (bytes, name)."""
    whole = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    seed = 0
    while True:
        now = seed
        cuts = F.transform(_blocks(F.col("text"), block), lambda b: _digest(b, now))  # noqa: B023
        rows = cut(whole.select(F.monotonically_increasing_id().alias("row"), "id",
                                F.octet_length("text").cast("bigint").alias("bytes"),
                                F.sha2("text", 256).alias("sha"), cuts.alias("cuts")), "texts")
        pieces = whole.select(F.explode(_blocks(F.col("text"), block)).alias("b")).select(
            _digest(F.col("b"), seed).alias("d"), "b").select("d.h", "d.k", "b")
        distinct = cut(pieces.distinct().select("h", "k"), "blocks")
        if distinct.groupBy("h", "k").count().where("count > 1").isEmpty():
            break
        seed += 1
    names = _numbered(distinct, ["h", "k"])
    spots = rows.select("row", F.size("cuts").alias("n"), F.posexplode("cuts").alias("at", "d")).select(
        "row", "n", "at", "d.h", "d.k")
    level = cut(spots.join(names, ["h", "k"]).select("row", "n", "at", "name"), "level")
    roots = None
    while True:  # one round for each doubling of the longest text
        done = level.where("n = 1").select("row", "name")
        roots = done if roots is None else roots.unionByName(done)
        pairs = cut(level.where("n > 1").groupBy(
            "row", F.expr("(n + 1) div 2").cast("int").alias("n"), F.expr("at div 2").cast("int").alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")), "pairs")
        if pairs.isEmpty():
            break
        names = _numbered(pairs.select("left", "right").distinct(), ["left", "right"])
        level = cut(pairs.join(names, ["left", "right"]).select("row", "n", "at", "name"), "level")
    return rows.drop("cuts").join(roots, "row")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Null counts as the empty text, and empty texts equal each other. The row with the largest id
    stays, a null id being smaller than all others; of rows that repeat that id exactly one stays.
    Texts of any length are cut whole. Other columns are not read.
    """
    named = identities(docs, id_col, text, block)
    best = named.groupBy("bytes", "name").agg(
        F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return named.join(best, ["bytes", "name"]).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"))
