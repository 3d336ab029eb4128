"""Near-duplicates of the pipeline against brute-force Jaccard similarity."""

import random

import pyarrow as pa
import pytest

from ledgerlens.llm import jaccard, simhash


def sets_of(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similar(a, b):
    a, b = sets_of(a), sets_of(b)
    return len(a & b) >= 0.8 * len(a | b) if a and b else a == b


def brute_kept(rows):
    left, kept = dict(rows), []
    while left:
        first = min(left)
        group, todo = {first}, [first]
        while todo:
            text = dict(rows)[todo.pop()]
            new = {d for d in left if d not in group and similar(text, left[d])}
            group |= new
            todo += new
        kept.append(first)
        left = {d: t for d, t in left.items() if d not in group}
    return sorted(kept)


def edited(words, share, rng, fresh):
    """A stretch at the end is new, so about ``share`` of all shingles stay common."""
    n = len(words) - 4
    x = round(n * (1 - share) / (1 + share))  # (n - x) / (n + x) is the similarity
    return " ".join(words[:len(words) - x] + [f"new{fresh}_{rng.random()}" for _ in range(x)])


def test_texts_below_the_similarity_stay(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(94)]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, edited(words, 0.72, rng, i)), (10 * i + 2, edited(words, 0.96, rng, i))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows) == sorted(d for d, _ in rows if d % 10 < 2)


@pytest.mark.parametrize("block", [4, 16, 128])
def test_blocks_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(block)
    rows = [(0, "")]
    for chain in range(4):  # windows that slide over one text: neighbours link, most pairs do not
        words = [f"c{chain}w{i}" for i in range(120)]
        for i in range(18):
            step = i * (3 if chain % 2 else 5 if i % 4 else 12)
            rows.append((100 * chain + i + 1, " ".join((words * 3)[step:step + 60])))
    rows += [(900 + i, rows[1 + rng.randrange(70)][1]) for i in range(10)]
    df = spark.createDataFrame(rows, "_id long, _text string")
    got = jaccard.linked(df, df.selectExpr("_id", "'all' AS component"), 5, 0.8).collect()
    assert sorted({r.component_id for r in got}) == brute_kept(rows) and len(got) == len(rows)


def test_sets_ignore_case_and_spaces():
    got = [jaccard.set_name(s) for s in jaccard.shingle_sets(pa.array(["A b  c d e f", "a b c d e\nf", "a b", "", None, "b a"]), 5)]
    assert got[0] == got[1] and got[3] == got[4] and len(set(got)) == 4


def test_recall_at_the_similarity_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):  # changes at the end, which keep 0.8 to 0.82 of all shingles, on varied lengths
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([24, 49, 94, 184, 454]))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, edited(words, 0.805, rng, i))]
    expected = brute_pairs(rows)
    assert len(expected) > 400
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, _ in rows} - kept == expected


def brute_pairs(rows):
    return {b[0] for a, b in zip(rows[::2], rows[1::2]) if similar(a[1], b[1])}


def test_thousands_of_copies_of_one_template_are_one_group(spark):
    rng = random.Random(9)
    template = [f"w{i}" for i in range(60)]
    rows = [(5000, " ".join(template))]
    for i in range(2500):  # near the template and those with the same place changed, not near the others
        place = rng.randrange(4, 56)
        rows.append((i, " ".join(template[:place] + [f"own{i}"] + template[place + 1:])))
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept] == [0]
