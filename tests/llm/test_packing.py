"""Packing: whole, gapless and close to the fewest sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from ledgerlens.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def bins_of(histogram, capacity):
    patterns = packing.plan_bins(histogram, capacity)
    used = Counter()
    for p in patterns:
        assert p.times > 0 and sum(p.lengths) <= capacity
        for size in p.lengths:
            used[size] += p.times
    assert used == Counter({k: v for k, v in histogram.items() if v})
    return sum(p.times for p in patterns)


@pytest.mark.parametrize("seed", range(12))
def test_plans_use_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    histogram = {rng.randrange(1, capacity + 1): rng.randrange(1, 40) for _ in range(rng.randrange(1, 200))}
    n = bins_of(histogram, capacity)
    least = -(-sum(k * v for k, v in histogram.items()) // capacity)
    assert least <= n <= max(least + 2, 1.23 * least + 1, sum(v for k, v in histogram.items() if 2 * k > capacity))


def test_two_replace_the_smallest():
    # Greedy gives 6+3 (9 of 10); 3 gives way to 2+2.
    plan = packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)
    assert plan[0].lengths == [6, 2, 2] and packing._two_for_smallest(np.array([0, 0, 2, 1, 0, 0, 1]), [6, 3], 10) == [6, 2, 2]


def test_hot_length_needs_few_patterns():
    plan = packing.plan_bins({700: 10**12, 3: 10**9, 2048: 10**11, 900: 7}, 2048)
    assert len(plan) < 12


def test_every_piece_has_its_place(spark):
    rng = random.Random(5)
    texts = [None, "", "a", "<|endoftext|>"] + ["same text"] * 60 + [
        " ".join(rng.choice(["the", "quick", "Über", "x1"]) for _ in range(rng.choice([3, 40, 200, 900]))) for _ in range(120)]
    rows = [(i if i != 7 else None, t, "x", 1) for i, t in enumerate(texts)] + [(1, "", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, length int").repartition(4)
    got = packing.pack(df, PATH, capacity=128).collect()
    tokenizer = tokens.load(PATH)
    per_doc = defaultdict(list)
    for r in got:
        per_doc[r.doc_id].append(r)
    for doc, text in [(r[0], r[1]) for r in rows if r[0] != 1]:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        pieces = sorted(per_doc[doc], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // 128))) and sum(p.length for p in pieces) == len(ids)
        assert all(p.length == 128 for p in pieces[1:])
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
    assert len(per_doc[1]) == 2
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= -(-sum(r.length for r in got) // 128) + 2
    assert packing.pack(df.limit(0), PATH).count() == 0
