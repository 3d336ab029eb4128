"""Results stay whole and exact when one key holds a third of the rows or more."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import joins as J
from ledgerlens.operators import ordering as O
from ledgerlens.operators import rings as R
from ledgerlens.operators import sampling as X
from ledgerlens.operators import windows as W
from ledgerlens import session as S0
from ledgerlens.sources import tables as S

T0 = dt.datetime(2026, 1, 1)


def hot_rows(n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        payer = "hot" if rng.random() < 0.5 else f"u{rng.randrange(40)}"
        seconds = rng.choice([0, 3600, rng.randrange(20000), rng.randrange(20000) // 600 * 600])
        rows.append((f"t{i:05d}", T0 + dt.timedelta(seconds=seconds), payer, f"p{rng.randrange(9)}",
                     None if rng.random() < 0.6 else f"m{rng.randrange(3)}", f"d{rng.randrange(5)}",
                     round(rng.random() * 90, 2)))
    return rows


SCHEMA = ("transaction_id string, timestamp timestamp_ntz, payer_id string, payee_id string, "
          "merchant_id string, device_id string, amount double")


@pytest.mark.parametrize("hot,ties", [(10**6, "exact"), (30, "exact"), (10**6, "peers"), (30, "peers"), (0, "exact"), (0, "peers")])
@pytest.mark.parametrize("key,span", [("payer_id", 3600), ("merchant_id", 3600), ("device_id", 600)])
def test_windows_against_brute_force(spark, key, span, hot, ties):
    rows = hot_rows()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    table = [dict(zip(names, r)) for r in rows]
    features = [W.Feature("n", "count", span), W.Feature("total", "sum", span, "amount"),
                W.Feature("who", "distinct", span, "payee_id"), W.Feature("short", "count", span // 4)]
    got = {r.transaction_id: r for r in W.sliding_features(
        spark.createDataFrame(rows, SCHEMA), key, features, prefix="", hot_records=hot, ties=ties).collect()}
    assert len(got) == len(rows)
    table.sort(key=lambda r: (r["timestamp"], r["transaction_id"]))
    groups = defaultdict(list)
    for row in table:
        group = groups[row[key] or ""]
        group.append(row)
        age = lambda e: (row["timestamp"] - e["timestamp"]).total_seconds()  # noqa: B023, E731
        seen = group if ties == "exact" else [e for e in table if (e[key] or "") == (row[key] or "") and age(e) >= 0]
        inside = [e for e in seen if age(e) <= span]
        mine = got[row["transaction_id"]]
        assert mine.n == len(inside)
        assert mine.total == pytest.approx(sum(e["amount"] for e in inside))
        assert mine.who == len({e["payee_id"] for e in inside})
        assert mine.short == sum(age(e) <= span // 4 for e in inside)


def test_positions_ranks_and_quantiles_with_a_hot_group(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", rng.choice([1.0, 2.0, rng.random() * 9])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(7)
    place = {r.id: (r.position, r.n) for r in O.running_position(df, ["v", "id"], ["g"], total="n").collect()}
    rank = {r.id: r.pr for r in O.pct_rank_avg(df, "v", "pr", ["g"]).collect()}
    quant = {r.g: r.q for r in O.exact_quantiles(df, "v", {"q": 0.9}, ["g"]).collect()}
    groups = defaultdict(list)
    for i, g, v in rows:
        groups[g].append((v, i))
    for g, members in groups.items():
        members.sort()
        values = [v for v, _ in members]
        for at, (v, i) in enumerate(members):
            assert place[i] == (at, len(members))
            average = sum(k + 1 for k, x in enumerate(values) if x == v) / values.count(v)
            assert rank[i] == pytest.approx(average / len(values))
        h = 0.9 * (len(values) - 1)
        low = int(h)
        expected = values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (h - low)
        assert quant[g] == pytest.approx(expected)


def test_hash_sample_is_exact_and_repeatable(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("id"),
                                  F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("s"))
    one, two = ({r.id for r in X.hash_sample(df, {"a": 137, "b": 20}, "id", 1, F.col("s")).collect()}
                for _ in range(2))
    assert one == two and len(one) == 157
    assert sum(int(i) % 3 == 0 for i in one) == 137


def test_lookup_keeps_rows_without_a_key(spark):
    fact = spark.createDataFrame([(str(i), None if i % 3 else "k") for i in range(90)],
                                 "transaction_id string, key string")
    out = J.lookup(fact, spark.createDataFrame([("k", 1)], "id string, v int"), "key", "id")
    assert out.count() == 90 and out.where("v = 1").count() == 30 and out.columns == ["transaction_id", "key", "v"]


def test_late_tag_over_slices_equals_running_maximum(spark):
    rng = random.Random(8)
    rows = [(i, T0 + dt.timedelta(seconds=i + rng.choice([0, 0, -61, -60])), 0) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, timestamp timestamp_ntz, part int")
    # Arrival numbers far apart put the rows into many slices.
    spaced = df.withColumn("seq", F.col("seq") * (1 << 19))
    got = {r.seq >> 19: r.is_late_event for r in W.late_flag(spaced, "timestamp", ["part"], "seq").collect()}
    top = None
    for i, ts, _ in rows:
        top = ts if top is None else max(top, ts)
        assert got[i] == (ts < top - dt.timedelta(seconds=60))


def test_a_resource_of_many_payers_is_kept(spark):
    rows = [(f"t{i}", T0, 5.0, int(i < 3), 0, None, f"u{i}", "p", None, "D_hub", f"i{i}", None) for i in range(500)]
    tx = spark.createDataFrame(rows, "transaction_id string, timestamp timestamp_ntz, amount double, is_fraud int, "
                               "is_injected int, injection_scenario string, payer_id string, payee_id string, "
                               "merchant_id string, device_id string, ip_id string, fraud_group_id string")
    assert {r.entity_id: r.shared_user_count for r in R.resource_stats(tx).collect()} == {"D_hub": 500, "p": 500}
    hub = R.mine_rings(tx).candidates.where("entity_id = 'D_hub'").first()
    assert hub.shared_user_count == 500


def test_tail_of_a_topic_with_one_busy_partition(spark):
    rows = [(0, i, str(i), "{}") for i in range(91)] + [(p, 0, "k", "x") for p in range(1, 10)]
    messages = spark.createDataFrame(rows, "partition int, offset long, key string, value string")
    got = [(r.partition, r.offset) for r in S.tail_topic(messages, 20).collect()]
    assert got == [(p, 0) for p in range(9, 0, -1)] + [(0, i) for i in range(90, 79, -1)]


def test_evidence_beyond_the_listed_rows_counts(spark):
    rows = [("c", f"e{i:02d}", "shared_ip" if i < 22 else "shared_payee") for i in range(30)]
    counted = R.evidence_kinds(spark.createDataFrame(rows, "component string, entity_id string, evidence_kind string")).first()
    assert (counted.ip_evidence, counted.payee_evidence, counted.device_evidence) == (22, 8, 0)


def test_hot_resource_beyond_the_limit_is_left_out_whole(spark):
    rows = [(f"t{i}", T0, 5.0, 1, 0, None, f"u{i}", "p", None, "D_hot" if i < 30 else "D_small", f"i{i}")
            for i in range(33)]
    tx = spark.createDataFrame(rows, "transaction_id string, timestamp timestamp_ntz, amount double, is_fraud int, "
                               "is_injected int, injection_scenario string, payer_id string, payee_id string, "
                               "merchant_id string, device_id string, ip_id string")
    stats = {r.entity_id: r.shared_user_count for r in R.resource_stats(tx, max_users=20).collect()}
    assert stats == {"D_small": 3}


def largest_share(spark, job):
    """Of the stages that ``job`` runs and that read many shuffled rows: the most rows of a task, and of all its tasks."""
    store = spark.sparkContext._jsc.sc().statusStore()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("measured", "")
    job()
    spark.sparkContext.setJobGroup("", "")
    out = []
    for j in tracker.getJobIdsForGroup("measured"):
        for stage in tracker.getJobInfo(j).stageIds:
            info = tracker.getStageInfo(stage)
            if info is None or not info.numCompletedTasks:
                continue
            tasks = store.taskList(stage, info.currentAttemptId, 10**6)
            read = [tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size())]
            out.append((max(read), sum(read)))
    return [x for x in out if x[1] >= 100_000]


def test_half_of_the_rows_in_one_hour_of_one_key(spark):
    n, parts = 100_000, 16
    settings = {"spark.sql.shuffle.partitions": parts, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        seconds = F.when(F.col("id") % 2 == 0, F.pmod(F.xxhash64("id"), F.lit(3600))).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**6)))
        rows = S0.cut(spark.range(0, n, 1, 8).select(
            F.format_string("t%07d", "id").alias("transaction_id"),
            F.timestamp_add("SECOND", seconds, F.lit(T0).cast("timestamp_ntz")).alias("timestamp"),
            F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 5000)).alias("payer_id"),
            F.when(F.col("id") % 3 == 0, "p").otherwise(F.concat(F.lit("p"), F.col("id") % 997)).alias("payee_id"),
            (F.col("id") % 90).cast("double").alias("amount")))
        run = lambda hot: W.sliding_features(rows, "payer_id", W.USER_5MIN + W.USER_1H, prefix="", hot_records=hot)
        columns = ["transaction_id", *[f.name for f in W.USER_5MIN + W.USER_1H]]
        read = largest_share(spark, lambda: run(20_000).write.format("noop").mode("overwrite").save())
        assert read and all(most <= 2 * total / parts for most, total in read), read
        whole, sliced = run(10**9).select(*columns), run(20_000).select(*columns)
        assert whole.exceptAll(sliced).count() == 0 and sliced.count() == n
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
