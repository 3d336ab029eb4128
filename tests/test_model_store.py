"""Stored models score as they did before; publications take effect from the next batch on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import models as L
from ledgerlens.operators.derive import FeatureContract, Thresholds
from ledgerlens.operators.forest import TreeSettings
from ledgerlens.sources import model_store as M
from ledgerlens.streaming import scoring as Z


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = [(f"t{i}", "ab"[i % 2] if i % 9 else None, float(rng.normal()) if i % 11 else None,
             float(rng.normal()), int(rng.random() < 0.3)) for i in range(400)]
    df = spark.createDataFrame(rows, "transaction_id string, kind string, a double, b double, is_fraud int")
    return df.withColumn("is_fraud", F.when(F.col("a") + F.col("b") > 0.8, 1).otherwise(F.col("is_fraud")))


CONTRACT = FeatureContract(("a", "kind", "b"), ("kind",), {"a": 0.1, "b": 0.0})
FITS = {
    "logistic": lambda t: L.fit_logistic(t, CONTRACT, max_iter=20),
    "trees": lambda t: L.fit_trees(t, CONTRACT, settings=TreeSettings(trees=4)),
    "isolation": lambda t: L.fit_isolation(t, CONTRACT, trees=5, sample=40),
    "gbt_histogram": lambda t: L.fit_gbt(t, t, CONTRACT, preset="histogram", maxIter=3),
    "linear": lambda t: L.linear_model(CONTRACT, {"a": 1.5, "b": -0.5}, 0.2, L.fit_categories(t, ["kind"])),
}


@pytest.mark.parametrize("name", FITS)
def test_a_loaded_model_scores_alike(spark, tmp_path, table, name):
    model = FITS[name](table)
    M.save_model(spark, model, str(tmp_path), "7")
    again = M.load_model(spark, str(tmp_path), name, "7")
    assert again.contract == model.contract
    # unseen category, missing values and a missing column among the rows to score
    new = table.unionByName(spark.createDataFrame(
        [("n1", "zz", None, 1.0, 0), (None, None, 2.0, None, 1)], table.schema))
    for rows in (new, new.drop("b"), new.where("false")):
        scores = [{(r.transaction_id, r.is_fraud): r.risk_score for r in L.score_batch(m, rows).collect()}
                  for m in (model, again)]
        assert scores[0] == scores[1] and all(0 <= v <= 1 for v in scores[0].values())


def test_a_version_is_stored_once_and_whole(spark, tmp_path, table):
    model = FITS["linear"](table)
    M.save_model(spark, model, str(tmp_path), "1")
    with pytest.raises(Exception, match="exists"):
        M.save_model(spark, model, str(tmp_path), "1")
    with pytest.raises(Exception, match="(?i)path"):
        M.load_model(spark, str(tmp_path), "linear", "2")
    with pytest.raises(ValueError, match="contract"):
        L.linear_model(CONTRACT, {"c": 1.0}, 0.0)


def test_the_latest_publication_is_read_by_each_batch(spark, tmp_path):
    folder = str(tmp_path)
    contract = FeatureContract(("amount", "txn_count"), (), {"amount": 0.0, "txn_count": 5.0})
    batch = spark.createDataFrame(
        [("t1", "u1", 2.0), ("t2", None, 1.0)], "transaction_id string, payer_id string, amount double")
    for version, count in (("1", 10), ("2", 20)):
        M.save_model(spark, L.linear_model(contract, {"txn_count": float(version)}, -10.0), folder, version)
        spark.createDataFrame([("u1", count)], "user_id string, txn_count long").write.parquet(f"{folder}/u{version}")
    score = Z.published_scorer(spark, folder)
    with pytest.raises(Exception):
        score(batch)  # nothing is published
    seen = {}
    for version, cuts in (("1", (0.4, 0.9)), ("2", (0.1, 0.99))):
        M.publish(spark, folder, M.Publication("linear", version, Thresholds(*cuts), {"user": f"{folder}/u{version}"}))
        for r in score(batch).collect():
            seen[version, r.transaction_id] = (r.model_version, round(r.risk_score, 6), r.risk_level)
    sigmoid = lambda z: round(1 / (1 + np.exp(-z)), 6)
    assert seen == {("1", "t1"): ("1", 0.5, "medium"), ("1", "t2"): ("1", sigmoid(-5), "low"),
                    ("2", "t1"): ("2", sigmoid(30), "high"), ("2", "t2"): ("2", 0.5, "medium")}
