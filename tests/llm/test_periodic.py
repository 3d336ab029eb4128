"""Runs by seeds on diagonals against all stretches of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerlens.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, min_words=24, repeats=3):
    found = []
    for q in range(1, len(w) // repeats + 1):
        at = 0
        while at + q < len(w):
            end = at
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            if end > at:
                s, e = at, end + q
                smallest = next(p for p in range(1, q + 1) if all(w[i] == w[i + p] for i in range(s, e - p)))
                if e - s >= max(min_words, repeats * q) and smallest == q:
                    found.append((s, e - s, q))
            at = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(d, w):
    h, n = zlib.crc32(str(d).encode()), len(w)
    g = h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_digest(d, text):
    w = WORD.findall(text or "")
    if d is not None:
        w = planted(d, w)
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-(r[1] / r[2]), r[0], r[2]), default=(None,) * 3)
    return (d, len(runs), *best, best[1] and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs)))


def sample(seed):
    rng = random.Random(seed)
    rows = []
    for d in range(150):
        words = [f"w{rng.randrange(rng.choice([2, 3, 50]))}" for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(4)):
            q = rng.choice([1, 2, 3, 7, 8, 9, 11, 16, 17, 18, 31, 33, 40])
            unit = [f"u{rng.randrange(rng.choice([1, 2, 9]))}" for _ in range(q)]
            n = max(24, 3 * q) + rng.choice([-1, 0, 1, 5, 2 * q])
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * n)[:n]
        rows.append((d, rng.choice([" ", "\n", " \t\x0b"]).join(words)))
    rows += [(None, "a b " * 20), (None, None), (3, None), (4, ""), (5, " \n "), (6, "x " * 24), (7, "x " * 23), rows[9], rows[9],
             (1000, "ü é " * 30), (1001, "a b " * 40), (1002, " ".join(["a a b"] * 9 + ["a a b a a b c"] * 9))]
    return rows


@pytest.mark.parametrize("min_words,repeats", [(24, 3), (5, 3), (40, 5), (1, 3)])
def test_runs_equal_all_stretches(min_words, repeats):
    rng = random.Random(min_words)
    texts = []
    for _ in range(60):
        w = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randrange(0, 70))]
        for _ in range(2):
            unit = [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = (unit * 9)[:len(unit) * rng.randrange(2, 9)]
        texts.append(w)
    hashes = np.random.default_rng(1).integers(1, 2**63, 50, dtype=np.uint64)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    flat = hashes[np.array([x for t in texts for x in t])]
    got = [tuple(r) for r in periodic.runs_of(flat, first, min_words, repeats).tolist()]
    assert got == [(i, *r) for i, t in enumerate(texts) for r in brute_runs(t, min_words, repeats)]


def test_every_gram_twice_in_a_period():
    unit = [0, 0, 1, 1] * 4 + [0, 1] * 8 + [0, 0, 1, 1, 1]
    first = np.array([0, 4 * len(unit)])
    h = np.array([3, 5], np.uint64)[np.array(unit * 4)]
    assert [tuple(r[1:]) for r in periodic.runs_of(h, first).tolist()] == brute_runs(unit * 4)


def test_long_runs_give_few_pairs():
    for q in (1, 5, 3000):
        h = np.tile(np.random.default_rng(q).integers(1, 2**63, q, dtype=np.uint64), 300_000 // q)
        assert periodic.runs_of(h, np.array([0, len(h)])).tolist() == [[0, 0, len(h), q]]


@pytest.mark.parametrize("seed", [1, 2])
def test_query_steps_against_brute_force(spark, seed):
    rows = sample(seed)
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, runs int, n_words string").repartition(3)
    got = periodic.digests(periodic.find_runs(periodic.repeat_tails(df))).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([brute_digest(*r) for r in rows], key=str)


def test_spans_and_text(spark):
    df = spark.createDataFrame([("k", "go " + "one two " * 15 + "end")], "id string, body string")
    row = periodic.find_runs(df, "id", "body").first()
    assert (row.id, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == ("k", 32, [(1, 30, 2)], "go one two end")


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.digests(periodic.find_runs(periodic.repeat_tails(empty))).count() == 0
