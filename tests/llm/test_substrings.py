"""Repeats by anchors against a plain index of all windows."""

import hashlib
import random
import re

import pytest

from ledgerlens.llm import chunks, substrings


def brute(rows, k=13):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    order = lambda d: float("inf") if d is None else d
    for d, w in split:
        for i in range(len(w) - k + 1):
            key = tuple(w[i:i + k])
            first[key] = min(first.get(key, float("inf")), order(d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] < order(d):
                gone |= set(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def sample(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(words) for _ in range(n)] for n in (12, 13, 14, 20, 26, 60)]
    rows = []
    for d in range(120):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = rng.choice(passages)
        rows.append((rng.randrange(10**6), rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [rows[5], rows[6], (None, rows[7][1]), (None, rows[8][1]), (-3, rows[9][1]), (4, None), (5, ""), (6, " \n"),
             (2 * 10**6, "again " * 40), (2 * 10**6 + 1, "again " * 13), (2 * 10**6 + 2, "again " * 12)]
    rows.append((2 * 10**6 + 3, " ".join(rng.choice(words) for _ in range(30_000)) + " " + " ".join(passages[5])))
    return rows


@pytest.mark.parametrize("seed,chunk_bytes,bucket_keys", [(1, 1 << 24, 10**6), (2, 2000, 500), (3, 300, 5000)])
def test_against_brute_force(spark, monkeypatch, seed, chunk_bytes, bucket_keys):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(chunks, "BUCKET_KEYS", bucket_keys)
    rows = sample(seed)
    df = spark.createDataFrame([(*r, 1, b"") for r in rows], "doc_id long, text string, chunk int, body binary").repartition(3)
    got = substrings.remove_repeats(df).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_kept_text(spark):
    long = " ".join(f"x{i}" for i in range(30))
    df = spark.createDataFrame([(1, long), (2, f"own {long} words")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in substrings.remove_repeats(df, texts=True).collect()} == {1: long, 2: "own words"}


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
