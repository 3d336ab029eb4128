"""Dynamic counting of phrases against plain counts of all of them."""

import random
import re
from collections import Counter

import pytest

from ledgerlens.llm import phrases

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute_counts(rows, longest=4):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f.update((lang or "und", " ".join(w[i:i + k])) for i in range(len(w) - k + 1))
    return f, {k: v for k, v in n.items() if v}


def brute_collocations(f, n, threshold, top, share):
    out, f = [], {k: v for k, v in f.items() if v >= threshold}
    best = Counter()
    for (lang, p), v in f.items():
        w = p.split(" ")
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                best[lang, " ".join(w[i:i + m])] = max(best[lang, " ".join(w[i:i + m])], v)
    for lang in n:
        rows = []
        for (own, p), a in f.items():
            w = p.split(" ")
            if own == lang and len(w) > 1 and 100 * best[own, p] < share * a:
                cuts = []
                for j in range(1, len(w)):
                    left, right = f[lang, " ".join(w[:j])], f[lang, " ".join(w[j:])]
                    cuts.append((2000000 * a // (left + right), j, left, right))
                score, _, left, right = min(cuts)
                rows.append((-score, -a, p.encode(), p, left, right))
        for rank, (score, a, _, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p, -a, left, right, n[lang], -score))
    return sorted(out)


def sample(seed):
    rng = random.Random(seed)
    words = ["a", "B", "c'd", "é", "É", "x-y", "THE", "the", "of", "n b", "z"]
    fixed = ["the of a B", "of a B", "c'd é x-y", "z z z z z"]
    rows = []
    for _ in range(300):
        text = "".join(rng.choice([rng.choice(words), rng.choice(fixed)]) + rng.choice([" ", " ", " ", " \t", ". ", "\n", ","])
                       for _ in range(rng.randrange(0, 25)))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    return rows + [("en", None), ("en", ""), ("fr", None), ("fr", " . \t!"), rows[0], rows[0], ("it", "only here"),
                   ("en", "the of a b " * 3000)]


@pytest.mark.parametrize("seed,chunk_bytes,shards,slots", [(1, 1 << 23, 4, 1 << 20), (2, 500, 4, 1 << 16), (3, 2000, 1, 4), (4, 900, 3, 16)])
def test_against_plain_counts(spark, monkeypatch, seed, chunk_bytes, shards, slots):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(phrases, "MOST_SLOTS", slots)  # few slots: most phrases share theirs
    monkeypatch.setattr(phrases, "RANGE_BITS", min(16, slots.bit_length() - 1))
    rows = sample(seed)
    df = spark.createDataFrame([(*r, 5, b"") for r in rows], "lang string, text string, k int, body binary").repartition(3)
    counts, totals = phrases.frequent_phrases(df, threshold=12, shards=shards)
    f, n = brute_counts(rows)
    got = {(r.lang, r.phrase): r.f for r in counts.collect()}
    assert got == {k: v for k, v in f.items() if v >= 12}
    assert all(r.k == len(r.phrase.split(" ")) for r in counts.collect())
    assert {r.lang: r.n for r in totals.collect()} == n
    out = [tuple(r) for r in phrases.collocations(counts, totals, top=40).collect()]
    assert sorted(out) == brute_collocations(f, n, 12, 40, 80)


def test_products_past_64_bits(spark):
    big = 9 * 10**17
    counts = spark.createDataFrame([("en", 1, "a", big + 1), ("en", 1, "b", big), ("en", 2, "a b", big - 7)], "lang string, k int, phrase string, f long")
    row = phrases.collocations(counts, spark.createDataFrame([("en", 2 * big)], "lang string, n long")).first()
    assert row.score == 2000000 * (big - 7) // (2 * big + 1) and row.a == big - 7


def test_empty_table(spark):
    counts, totals = phrases.frequent_phrases(spark.createDataFrame([], "text string, lang string"))
    assert counts.count() == 0 and totals.count() == 0 and phrases.collocations(counts, totals).count() == 0
