"""Exact sizes, gapless slots and the law of the drawn counts."""

import random
import zlib
from collections import Counter
from math import comb

from ledgerlens.llm import sharding


def test_draws_follow_the_hypergeometric_law():
    rng, good, bad, draws, n = random.Random(3), 12, 20, 9, 40_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(n))
    square = 0.0
    for k in range(draws + 1):
        expected = n * comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
        square += (seen[k] - expected) ** 2 / expected
    assert square < 28  # 9 degrees of freedom, p < 0.001
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3
    large = [sharding.hypergeometric(rng, 10**10, 3 * 10**10, 10**6) for _ in range(200)]
    assert abs(sum(large) / 200 - 250_000) < 200


def test_matrix_margins():
    sizes, shards = [5, 0, 17, 300, 1], [81, 81, 81, 80]
    matrix = sharding.communication_matrix(sizes, shards, 1)
    assert [sum(r) for r in matrix] == sizes and [sum(c) for c in zip(*matrix)] == shards


def test_rows_are_whole_and_shards_exact(spark):
    texts = [None, "", "ä b"] + ["copy"] * 150 + [f"text {i} " * (i % 7) for i in range(350)]
    rows = [(i if i % 50 else None, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, row int").repartition(7)
    got = sharding.shuffle_to_shards(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    per = Counter(r.shard for r in got)
    assert set(per) == set(range(16)) and max(per.values()) - min(per.values()) <= 1
    for shard in per:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(per[shard]))
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_small_and_empty_tables(spark):
    few = sharding.shuffle_to_shards(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")).collect()
    assert sorted(r.shard for r in few) == [0, 1]
    assert sharding.shuffle_to_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
