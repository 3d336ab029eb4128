"""Fits hold a bounded number of rows in a task; isolation trees score as a plain walk does."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import models as L


@pytest.fixture(scope="module")
def table(spark):
    """One value holds nine tenths of the rows, which come in one partition."""
    return spark.range(0, 2000, 1, 1).select(
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("transaction_id"),
        F.when(F.col("id") % 10 > 0, "often").otherwise(F.concat(F.lit("v"), (F.col("id") % 70).cast("string")))
        .alias("kind"), (F.col("id") % 13).cast("double").alias("a"), (F.col("id") % 3 == 0).cast("int").alias("is_fraud"))


def test_vectors_are_dealt_to_tasks_by_their_number(table, monkeypatch):
    monkeypatch.setattr(L, "TASK_ROWS", 50)
    sizes = [r["count"] for r in L.dealt(table, table).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 60


@pytest.mark.parametrize("few", [0, 50_000])
def test_a_frequent_category_is_not_shuffled(table, monkeypatch, few):
    monkeypatch.setattr(L, "FEW_CODES", few)
    known = table.where("kind != 'v0'")
    out = L.ordinal_encode(table, L.fit_categories(known, ["kind"]), ["kind"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (few > 0)
    values = sorted({r["kind"] for r in known.collect()})
    expected = {r["transaction_id"]: float(values.index(r["kind"])) if r["kind"] in values else -1.0
                for r in table.collect()}
    assert {r["transaction_id"]: r["kind"] for r in out.collect()} == expected


def test_path_lengths_equal_a_plain_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)).round(1)
    x[::7, 2] = np.nan
    for sample in (x[1:2], np.ones((9, 5)), rng.normal(size=(200, 5)).round(1)):
        tree = L.grow_tree(sample, 3)
        expected = []
        for row in x:
            at = 0
            while tree["feature"][at] >= 0:
                at = tree["left" if row[tree["feature"][at]] < tree["threshold"][at] else "right"][at]
            expected.append(tree["depth"][at])
        assert L.path_lengths(tree, x).tolist() == expected
    assert L.path_lengths(tree, x[:0]).tolist() == []


def test_values_next_to_each_other_are_split():
    x = np.array([[1.0], [np.nextafter(1.0, 2)]] * 3)
    for seed in range(20):  # some draws are the least value itself
        assert L.grow_tree(x, seed)["feature"][0] == 0


def test_each_step_of_the_node_model_is_written_once(spark, monkeypatch):
    written, cut = [], L.cut
    monkeypatch.setattr(L, "cut", lambda df, tag="table": (written.append(tag), cut(df, tag))[1])
    edges = spark.createDataFrame(
        [(f"u{i % 9}", f"d{i % 7}", "user", "device", "uses_device", int(i % 9 < 3)) for i in range(60)],
        "src_id string, dst_id string, src_type string, dst_type string, edge_type string, label int")
    scores = L.node_risk_model(edges).collect()
    assert len(scores) == 16 and all(0 <= r["node_risk_score"] <= 1 for r in scores)
    assert sorted(written) == ["hop", "hop2", "nodes", "parted"]


def _isolation_rows(spark, n):
    rng = np.random.default_rng(n)
    rows = [(f"t{i}", int(i % 10 == 0), *map(float, rng.normal(size=4) + 4 * (i % 10 == 0))) for i in range(n)]
    return spark.createDataFrame(rows, "transaction_id string, is_fraud int, a double, b double, c double, d double")


def test_isolation_trees_take_their_sample_of_all_normal_rows(spark):
    """A tree takes all rows up to its sample, and of more rows about as many, drawn by itself."""
    rows = _isolation_rows(spark, 4000)
    contract = L.select_features(rows)
    for sample, least, most in ((100_000, 3600, 3600), (1800, 1650, 1950)):
        model = L.fit_isolation(rows, contract, trees=6, sample=sample)
        sizes = [r["size"] for r in model.forest.trees.select("size").collect()]
        assert len(sizes) == 6 and least <= min(sizes) and max(sizes) <= most
        scores = L.score_batch(model, rows).groupBy("is_fraud").agg(F.avg("risk_score").alias("m")).collect()
        means = {r["is_fraud"]: r["m"] for r in scores}
        assert means[1] > means[0] + 0.2


def test_groups_of_trees_change_no_score(spark, monkeypatch):
    from ledgerlens.operators import forest as R

    rows = _isolation_rows(spark, 600)
    contract = L.select_features(rows)
    fits = (lambda: L.fit_isolation(rows, contract, trees=7),
            lambda: L.fit_trees(rows, contract, settings=R.TreeSettings(trees=7)))
    for fit in fits:
        found = []
        for shuffled, group in ((2 << 30, 64 << 20), (30_000, 3000)):
            monkeypatch.setattr(L, "PICKED_BYTES", shuffled)
            monkeypatch.setattr(R, "GROUP_BYTES", group)
            scores = L.score_batch(fit(), rows).select("transaction_id", "risk_score").collect()
            found.append({r["transaction_id"]: r["risk_score"] for r in scores})
        assert len(found[0]) == 600 and found[0] == pytest.approx(found[1], abs=1e-9)


def test_isolation_trees_follow_the_plain_rules():
    """Every inner node parts its rows within their range, and a leaf has the depth of its level and rows."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 3)).round(1).astype(np.float32)
    x[::50, 1] = np.inf
    tree = L.grow_tree(x, 5)
    seen = []

    def visit(at, rows, level):
        seen.append(at)
        low, high = x[rows].min(0), x[rows].max(0)
        f = tree["feature"][at]
        if f < 0:
            assert level == 9 or len(rows) == 1 or (low == high).all()
            assert tree["depth"][at] == pytest.approx(level + float(L._path_rest(len(rows))))
            return
        below = x[rows, f] < tree["threshold"][at]
        assert low[f] < high[f] and 0 < below.sum() < len(rows)
        visit(tree["left"][at], rows[below], level + 1)
        visit(tree["right"][at], rows[~below], level + 1)

    visit(0, np.arange(500), 0)
    assert sorted(seen) == list(range(len(tree["feature"])))
