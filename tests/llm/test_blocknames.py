"""Block naming against plain grouping."""

import hashlib
import random

from pyspark.sql import functions as F

from ledgerlens.llm import blocknames


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t in rows:
        same = groups[t or ""]
        keep = max((x for x in same if x is not None), default=None)
        out.append((d, keep, len(same), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_equal_texts_and_edge_cases(spark):
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "a"), (None, "a"), (None, None), (5, "a" * 16), (6, "a" * 17),
            (7, "a" * 32), (8, "ä" * 8), (9, "ä" * 8), (10, " a"), (11, "A")]
    long = "".join(rng.choice("ab") for _ in range(5000))
    rows += [(20, long), (21, long), (22, long[:-1]), (23, long[:-1] + "z"), (24, long[:2500] + "z" + long[2501:]), (25, long + "a")]
    rows += [(100 + i, "copy of one text " * 9) for i in range(300)]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, name string, row int").repartition(5)
    got = blocknames.exact_duplicates(df, block=16).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in rows}) and all(r.doc_id == r.keep_id for r in kept)


def test_shared_digests_are_drawn_anew(spark, monkeypatch):
    real = blocknames._digest
    monkeypatch.setattr(blocknames, "_digest", lambda b, seed: real(b, seed) if seed else F.struct(
        F.lit(0).cast("bigint").alias("h"), F.length(b).cast("bigint").alias("k")))
    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in blocknames.exact_duplicates(df).collect()} == {(1, 3), (2, 2), (3, 3)}


def test_empty_table(spark):
    assert blocknames.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
