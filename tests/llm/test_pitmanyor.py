"""The language model: exact counts, a whole probability, seating, and held-out gain."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import chunks, pitmanyor

SCHEMA = "doc_id long, text string, held boolean, chunk int, score int"


def tokens(t):
    low = "".join(c.lower() if c.isascii() else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def test_probabilities_of_all_texts_sum_to_one(spark):
    learn = ["a b", "a", "b a a", "", "a b b", "b", "c", "a b", None]
    rows = [(i, t, False) for i, t in enumerate(learn)]
    every = [s for n in range(8) for s in itertools.product(["a", "b", "c", "never seen".split()[0]], repeat=n)]
    rows += [(1000 + i, " ".join(s), True) for i, s in enumerate(every)]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA).repartition(2)
    got = pitmanyor.score_texts(df, F.col("held")).collect()
    mass = [sum(10 ** r.score for r in got if r.held_out and r.n_tokens == n) for n in range(1, 9)]
    rate = mass[-1] / mass[-2]  # of the longer texts, whose mass falls off evenly
    assert rate < 1 and abs(sum(mass) + mass[-1] * rate / (1 - rate) - 1) < 0.003


@pytest.mark.parametrize("chunk_bytes,bucket_keys", [(1 << 24, 10**6), (500, 300)])
def test_counts_and_base_score(spark, monkeypatch, chunk_bytes, bucket_keys):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(chunks, "BUCKET_KEYS", bucket_keys)
    rng = np.random.default_rng(1)
    words = np.array([f"W{i}" for i in range(80)] + ["Élan", "the"])
    chance = np.r_[np.full(81, 0.4 / 81), 0.6]
    rows = [(i if i % 40 else None, " ".join(rng.choice(words, rng.integers(0, 60), p=chance)), bool(i % 7 == 2)) for i in range(200)]
    rows += [(500, None, False), (501, "", True), (502, "the " * 3000, False), (3, rows[3][1], False), (503, "unheard of", None)]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA).repartition(3)
    got = pitmanyor.score_texts(df, F.col("held")).collect()
    count = Counter(w for _, t, held in rows if held is False for w in tokens(t))
    n, v = sum(count.values()), len(count)
    expected = Counter((d, held is not False, len(tokens(t)), sum(w in count for w in tokens(t)), n,
                        round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t, held in rows)
    assert Counter((*tuple(r)[:5], round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_held_out_texts_are_likelier_than_by_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pitmanyor.score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got) and len(got) == docs.count()
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_scores_hardly_depend_on_the_buckets(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def total(keys):
        monkeypatch.setattr(chunks, "BUCKET_KEYS", keys)
        held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
        scored = pitmanyor.score_texts(docs, held).where("held_out")
        return scored.agg(F.sum("score") / F.sum("n_tokens")).first()[0]

    one, many = total(10**9), total(30_000)
    assert chunks.bucket_count(400_000) >= 16 and abs(many / one - 1) < 0.01


def partitions(n):
    """All seatings of n customers, as lists of table sizes."""
    found = [[1]]
    for _ in range(n - 1):
        found = [s[:i] + [s[i] + 1] + s[i + 1:] for s in found for i in range(len(s))] + [s + [1] for s in found]
    return found


def fixed(r, p):
    return lambda dish, tables: (np.full(len(dish), float(r)), np.full(len(dish), float(p)))


@pytest.mark.parametrize("r,p", [(2.5, 0.3), (40, 0.05), (1 / 0.6, 1)])
def test_table_counts_of_few_customers_follow_all_seatings(r, p):
    d, n = 0.6, 6
    chance = np.zeros(n + 1)
    for sizes in partitions(n):
        opened = math.prod((r + i) * d * p for i in range(len(sizes)))
        chance[len(sizes)] += opened * math.prod(j - d for size in sizes for j in range(1, size))
    seating = pitmanyor.Seating(np.full(40_000, n), d, fixed(r, p), np.random.default_rng(5))
    seating.sweep()
    assert np.abs(np.bincount(seating.tables, minlength=n + 1) / 40_000 - chance / chance.sum()).max() < 0.015


@pytest.mark.parametrize("customers", [100, 1_000, 10_000, 100_000])
def test_table_counts_follow_a_plain_restaurant(customers):
    d, strength = 0.75, 1.0  # one dish alone, so that every table serves it
    lg = math.lgamma
    expected = math.exp(lg(strength + customers + d) + lg(strength + 1) - lg(strength + customers)
                        - lg(strength + d)) / d - strength / d
    seating = pitmanyor.Seating(np.full(2_500, customers), d, fixed(strength / d, 1), np.random.default_rng(7))
    means = []
    for _ in range(7):
        seating.sweep()
        means.append(seating.tables.mean())
    assert abs(np.mean(means[pitmanyor.BURN:]) / expected - 1) < 0.03


@pytest.mark.parametrize("d", [0.6, 0.75])
def test_chances_of_many_customers_follow_the_recursion(d, monkeypatch):
    law = pitmanyor.Law(d)
    monkeypatch.setattr(pitmanyor, "EXACT", 1_000)
    table = pitmanyor.Law(d).table
    for c in (257, 600, 1_000):
        t = np.unique(np.concatenate((np.arange(1, 30), np.linspace(30, c, 70).astype(int), [c - 2, c - 1])))
        assert np.abs(law.log_chance(np.full(len(t), c), t) - table[c, t]).max() < 1e-8


def test_a_very_frequent_pair_is_one_number():
    rng = np.random.default_rng(9)
    customers = np.array([10**9, 10**7, 3, 1, 1])
    seating = pitmanyor.Seating(customers, 0.75, fixed(1_000, 0.01), rng)
    seen = []
    for _ in range(200):
        seating.sweep()
        seen.append(seating.tables.copy())
        assert ((seating.tables >= 1) & (seating.tables <= customers)).all()
    mean = 1 + 1_001 * 0.01 / 0.99  # of a negative binomial law, the limit for ever more customers
    assert np.abs(np.mean(seen, 0)[:2] / mean - 1).max() < 0.06


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pitmanyor.score_texts(empty, F.col("held")).count() == 0
    unlearnt = spark.createDataFrame([(1, "a b", True, 1, 1)], SCHEMA)
    assert pitmanyor.score_texts(unlearnt, F.col("held")).first().train_tokens == 0
