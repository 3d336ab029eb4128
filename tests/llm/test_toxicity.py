"""Held-out accuracy, and what learning may see."""

import random
import zlib

import numpy as np
import pyarrow as pa

from ledgerlens.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    labels = np.array(labels)
    n = labels.sum()
    return (rank[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


def test_held_out_rows_are_told_apart(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = toxicity.classify(docs, labels).join(labels, "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert auc([r.score for r in out], [r.toxic for r in out]) > 0.97
    clean = [r for r in out if not r.toxic]
    toxic = [r for r in out if r.toxic]
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)


def toy(spark, n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [rng.choice(["red", "green", "blue", "stone", "river"]) for _ in range(30)]
        if bad:
            words[4:4] = ["you", "utter", "clod"]
        rows.append((i, " ".join(words), 1))
        labels.append((i, int(bad)))
    rows += [(900, None, 1), (901, "", 1), (None, "no id clod", 1), (902, "you utter clod " * 20000, 1), (3, rows[3][1], 1)]
    return (spark.createDataFrame(rows, "doc_id long, text string, _toxicity int"),
            spark.createDataFrame([*labels, (1, None), (77777, 1)], "doc_id long, toxic int"))


def test_edge_cases_and_the_filter(spark):
    docs, labels = toy(spark)
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {900, 901} <= ids and 902 not in ids and sum(i % 5 == 0 for i in ids if i and i < 900) <= 1


def test_held_out_labels_change_nothing(spark):
    docs, labels = toy(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_without_labels(spark):
    docs, labels = toy(spark, 20)
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.classify(docs, labels.where("toxic = 1")).collect()} == {1.0}


def test_features_are_words_pairs_and_skips():
    slots = toxicity._row_slots(pa.array(["a b c d", "a, B! c? d", None, "a a a a"]))
    assert len(slots[0]) == 4 + 3 + 2 + 1 and slots[0].tolist() == slots[1].tolist() and len(slots[2]) == 0 and len(slots[3]) == 4
