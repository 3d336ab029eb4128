"""Suffix arrays by Lyndon groups, and removal of repeated bytes, against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import chunks, suffixgroups


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=50), st.integers(1, 4))
def test_suffix_order(values, most):
    text = [min(v, most) for v in values] + [0]
    assert suffixgroups.suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_groups_are_lyndon_prefixes(values):
    text = values + [0]
    group, order, pointer = suffixgroups.lyndon_groups(text)
    suffix = [text[i:] for i in range(len(text))]

    def prefix(i):  # up to the next smaller suffix
        return text[i:next((j for j in range(i + 1, len(text)) if suffix[j] < suffix[i]), len(text))]

    rank = {g: r for r, g in enumerate(order)}
    for i in range(len(text)):
        smaller = [j for j in range(i) if prefix(j) < prefix(i)]
        assert pointer[i] == (smaller[-1] if smaller else -1)
        for j in range(i):
            assert (rank[group[i]] > rank[group[j]]) - (rank[group[i]] < rank[group[j]]) == (prefix(i) > prefix(j)) - (prefix(i) < prefix(j))


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 2, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i + 1:i + length + 1] = True
        heads, tails = np.flatnonzero(gone[1:] & ~gone[:-1]), np.flatnonzero(gone[:-1] & ~gone[1:])
        out.append((d, len(t), list(zip(heads.tolist(), (tails - heads).tolist())), bytes(b for b, g in zip(t, gone[1:]) if not g)))
    return sorted(out, key=str)


def sample(seed, length):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abcé ", "abcdefghijklmnopqrstuvwxyz 漢\n"])
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [word(n) for n in (length - 1, length, length + 1, 2 * length, 5 * length)]
    rows = []
    for d in range(80):
        text = word(rng.randrange(0, 3 * length))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(passages) + text[at:]
        rows.append((d, text))
    base = word(6 * length)
    rows += [(100 + i, base[:i * 7] + "#" + base[i * 7:]) for i in range(12)]  # near copies
    rows += [(200, base), (201, base), (None, base), (None, None), (3, None), (4, ""), rows[0], rows[1],
             (300, "x" * (3 * length)), (301, "xy" * (2 * length)), (302, "z" * length), (303, "w" * (length + 1)),
             (304, "\x00\x01" * length + "\x7f"), (305, word(60 * length) + passages[3])]
    return rows


@pytest.mark.parametrize("seed,length,chunk_bytes,keys,home,frequent", [
    (1, 200, 1 << 22, 10**6, 1 << 24, 1000), (2, 40, 3000, 50, 2000, 3), (3, 12, 500, 20, 500, 1), (4, 40, 1, 50, 4000, 5), (5, 24, 2000, 9, 900, 2)])
def test_against_plain_index(spark, monkeypatch, seed, length, chunk_bytes, keys, home, frequent):
    monkeypatch.setattr(suffixgroups, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(chunks, "BUCKET_KEYS", keys)
    monkeypatch.setattr(suffixgroups, "BUCKET_BYTES", home)
    monkeypatch.setattr(suffixgroups, "FREQUENT", frequent)
    rows = sample(seed, length)
    df = spark.createDataFrame([(*r, 1, b"") for r in rows], "doc_id long, text string, chunk int, body binary").repartition(3)
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffixgroups.remove_repeats(df, length=length).collect()]
    assert sorted(got, key=str) == brute(rows, length)


def test_empty_table(spark):
    assert suffixgroups.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
