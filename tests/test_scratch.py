"""What a query writes on its way is removed, and steps and micro-batches change no row."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens import session as S
from ledgerlens.operators import models as L
from ledgerlens.plans import queries_models as M
from ledgerlens.plans import queries_streaming as Q
from ledgerlens.streaming import scoring as Z


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    begin = dt.datetime(2024, 1, 1)
    rows = [(i, begin + dt.timedelta(seconds=i * 9000 + int(rng.integers(9000))), int(rng.integers(30)),
             ["view", "purchase", "signup", "click", "error"][i % 5], float(rng.gamma(2, 50)), '{"k": %d}' % rng.integers(100))
            for i in range(280)]
    path = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
                          "props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def _tags(spark):
    found = os.listdir(S.shared_folder(spark).removeprefix("file:"))
    return sorted(name.split("-")[0] for name in found if "-" in name)


def _new(spark, before):
    left = _tags(spark)
    for tag in before:
        left.remove(tag)
    return left


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_steps_leave_the_training_table_only_and_change_no_row(spark, folder, monkeypatch):
    before = _tags(spark)
    names = sorted(M.training_table(spark, folder).columns)
    assert _new(spark, before) == ["training"]
    once = _rows(M.training_table(spark, folder).select(*[F.round(c, 6) if "sum" in c or "amount" in c else c for c in names]))
    written, cut = [], S.cut
    monkeypatch.setattr(S, "STEP_ROWS", 0)
    monkeypatch.setattr(S, "cut", lambda df, tag="table": (written.append(tag), cut(df, tag))[1])
    before = _tags(spark)
    stepped = M.training_table(spark, folder)
    assert written.count("step") == 13 and _new(spark, before) == ["training"]
    assert _rows(stepped.select(*[F.round(c, 6) if "sum" in c or "amount" in c else c for c in names])) == once


def test_a_fit_leaves_its_scores_only(spark, folder):
    before = _tags(spark)
    for fit in (lambda train, valid, c: L.fit_logistic(train, c, max_iter=3),
                lambda train, valid, c: L.fit_gbt(train, valid, c, preset="histogram", maxIter=2)):
        assert M._fit(spark, folder, fit, 0.0).where("in_range").count() > 0
    assert not {"training", "vectors", "step", "degrees", "profile", "categories"} & set(_new(spark, before))


def test_vectors_are_read_as_they_were_dealt(spark, monkeypatch):
    monkeypatch.setattr(L, "TASK_ROWS", 50)
    table = spark.range(2000)
    rows = S.cut(L.dealt(table, table), "vectors")
    with L.read_as_dealt(spark):
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 60


def test_streams_leave_their_tables_only_and_batches_change_no_row(spark, folder, monkeypatch):
    found = []
    for most in (2_000_000, 60):
        monkeypatch.setattr(Q, "BATCH_ROWS", most)
        before = _tags(spark)
        tables = Q._scored_tables(spark, folder)
        assert not {"messages", "lines", "sorted", "checkpoint", "profile", "device_profile"} & set(_new(spark, before))
        sums = [f.name for f in tables[0].schema["window_features"].dataType]
        found.append([_rows(t.select("transaction_id", "risk_score", "is_late_event", "device_profile",
                                     *[F.round(f"window_features.{name}", 4).alias(name) for name in sums])) for t in tables])
    risk, alert, late = found[0]
    assert len(risk) == 280 and 0 < len(alert) < 280 and found[0] == found[1]


def test_routed_rows_are_scored_once_and_not_kept(spark, tmp_path):
    ran = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        ran.add(1)
        return x

    rows = spark.range(10).select(
        F.col("id").cast("string").alias("transaction_id"), F.lit(None).cast("string").alias("payer_id"),
        counted(F.col("id") / 10).alias("risk_score"), F.lit("pass").alias("decision"), (F.col("id") % 2 == 0).alias("is_late_event"))
    scored = rows.withColumn("risk_level", F.when(F.col("risk_score") >= 0.8, "high").otherwise("low"))
    Z.route(scored.withColumn("risk_score", F.col("risk_score")), str(tmp_path), 4)
    counts = {n: spark.read.parquet(f"{tmp_path}/{n}").count() for n in ("risk_results", "alert_events", "late_events")}
    assert counts == {"risk_results": 10, "alert_events": 2, "late_events": 5} and ran.value <= 20
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
