"""Streams: late tags, windows in arrival order, restarts, routing."""

import datetime as dt
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import windows as W
from ledgerlens.plans.queries_streaming import EVENT, collected
from ledgerlens.sources.tables import source_stream_events
from ledgerlens.streaming import bundles
from ledgerlens.streaming import events as V
from ledgerlens.streaming import scoring as Z
from ledgerlens.streaming import windows as K

T0 = dt.datetime(2026, 1, 1)


def event(i, seconds, payer="u", payee="p", merchant=None, device="d", ip="i", amount=1.0):
    return {"timestamp": (T0 + dt.timedelta(seconds=seconds)).isoformat(), "transaction_id": f"t{i}",
            "source": "s", "payer_id": payer, "payee_id": payee, "merchant_id": merchant,
            "amount": amount, "device_id": device, "ip_id": ip, "is_fraud": 0}


def write(folder, batches):
    """One file per batch, each later than the one before."""
    import os
    folder.mkdir(exist_ok=True)
    offset = 0
    for n, batch in enumerate(batches):
        path = folder / f"b{n:03d}.json"
        with path.open("w") as f:
            for item in batch:
                f.write(json.dumps({"value": item if isinstance(item, str) else json.dumps(item),
                                    "partition": 0, "offset": offset,
                                    "arrived": (T0 + dt.timedelta(seconds=offset)).isoformat()}) + "\n")
                offset += 1
        os.utime(path, (1_700_000_000 + n * 10,) * 2)
    return str(folder)


def stream(spark, folder, batches):
    V.use_state_store(spark)
    return V.parse_events(source_stream_events(spark, write(folder, batches), max_files=1), EVENT)


def test_late_is_strictly_more_than_a_minute_over_batches(spark, tmp_path):
    batches = [[event(0, 100)], [event(1, 40), event(2, 39)], [event(3, 200)], [event(4, 140), event(5, 139)]]
    out = collected(V.late_tag(stream(spark, tmp_path / "in", batches)))
    assert {r.transaction_id: r.is_late_event for r in out.collect()} == {
        "t0": False, "t1": False, "t2": True, "t3": False, "t4": False, "t5": True}


def test_markers_and_broken_lines_are_dropped(spark, tmp_path):
    out = collected(stream(spark, tmp_path / "in", [['{"__flush": true}', "nonsense", event(1, 0)]]))
    assert [r.transaction_id for r in out.collect()] == ["t1"]


def test_broken_lines_come_back_as_dead_letters(spark, tmp_path):
    lines = ['{"__flush": true}', "nonsense", event(1, 0), '{"amount": 3}']
    raw = source_stream_events(spark, write(tmp_path / "in", [lines]), max_files=1)
    out = collected(V.dead_letters(raw, EVENT))
    assert {(r.value, r.reason) for r in out.collect()} == {("nonsense", "not json"), ('{"amount": 3}', "no transaction_id")}


def test_times_with_zone_missing_or_unreadable(spark, tmp_path):
    zoned, missing, odd = event(1, 0), event(2, 0), event(3, 0)
    zoned["timestamp"], missing["timestamp"], odd["timestamp"] = "2026-01-01T00:00:09.250000Z", None, "soon"
    out = collected(V.late_tag(stream(spark, tmp_path / "in", [[zoned, missing, odd]]))).collect()
    assert {r.transaction_id: r.timestamp for r in out} == {
        "t1": T0 + dt.timedelta(seconds=9, milliseconds=250), "t2": T0 + dt.timedelta(seconds=1), "t3": T0 + dt.timedelta(seconds=2)}


def test_a_consumer_whose_last_event_has_no_time(spark, tmp_path):
    V.use_state_store(spark)
    batches = [[event(0, 100), event(1, 30)], [event(2, 100)], [event(3, 41), event(4, 39)]]
    source = stream(spark, tmp_path / "in", batches)
    holes = source.withColumn("timestamp", F.when(F.col("transaction_id") != "t2", F.col("timestamp")))
    out = collected(V.late_tag(holes)).collect()
    assert {r.transaction_id for r in out if r.is_late_event} == {"t1", "t4"}


def test_redelivered_events_are_messages_of_their_own(spark, tmp_path):
    batches = [[event(1, 0, amount=1.0), event(1, 0, amount=1.0), event(2, 10, amount=1.0)], [event(1, 20, amount=1.0)]]
    source = stream(spark, tmp_path / "in", batches)
    rows = K.join_back(collected(K.window_state(source)), source.schema).collect()
    assert sorted((r.offset, r.transaction_id, r.window_features.user_txn_count_1h) for r in rows) == [
        (0, "t1", 1), (1, "t1", 2), (2, "t2", 3), (3, "t1", 4)]


def by_state(spark, folder, batches):
    source = stream(spark, folder, batches)
    rows = K.join_back(collected(K.window_state(source)), source.schema).collect()
    return {r.transaction_id: r.window_features for r in rows}


def test_state_over_batches_equals_the_table(spark, tmp_path):
    events = [event(i, i * 61, payer=f"u{i % 3}", payee=f"p{i % 5}",
                    merchant=None if i % 2 else "m", device=f"d{i % 4}", ip=None if i % 7 == 0 else "i",
                    amount=float(i)) for i in range(120)]
    got = by_state(spark, tmp_path / "in", [events[i:i + 30] for i in range(0, 120, 30)])
    table = spark.createDataFrame([{**e, "timestamp": dt.datetime.fromisoformat(e["timestamp"])} for e in events],
                                  "timestamp timestamp_ntz, transaction_id string, payer_id string, payee_id string, "
                                  "merchant_id string, amount double, device_id string, ip_id string")
    features = [f for group in W.BY_KEY.values() for f in group]
    for r in W.window_features(table).collect():
        for f in features:
            assert abs(got[r.transaction_id][f.name] - r[W.PREFIX + f.name]) < 1e-9, (r.transaction_id, f.name)


def test_late_event_sees_the_queue_at_its_arrival(spark, tmp_path):
    # In order of arrival: the last event is old, joins at the tail, and trims nothing.
    got = by_state(spark, tmp_path / "in", [[event(0, 4000), event(1, 4100)], [event(2, 100)]])
    assert [got[f"t{i}"].user_txn_count_1h for i in range(3)] == [1, 2, 3]
    assert got["t2"].user_txn_count_5min == 3


def test_scored_stream_routes_each_event_once(spark, tmp_path):
    V.use_state_store(spark)
    batches = [[event(0, 500, amount=190.0), event(1, 400, amount=10.0)], [event(2, 600, amount=10.0)]]
    source = V.late_tag(stream(spark, tmp_path / "in", batches))

    def score(batch):
        scored = batch.withColumn("risk_score", F.col("amount") / 200)
        return Z.score_events(scored, lambda df: df, "m", "1")

    for _ in range(2):  # a second start continues after the first and adds nothing
        Z.scoring_stream(source, str(tmp_path / "out"), str(tmp_path / "ck"), score).awaitTermination()
    read = lambda n: sorted(r.transaction_id for r in spark.read.parquet(f"{tmp_path}/out/{n}").collect())
    assert read("risk_results") == ["t0", "t1", "t2"]
    assert read("alert_events") == ["t0"] and read("late_events") == ["t1"]
    row = spark.read.parquet(f"{tmp_path}/out/risk_results").where("transaction_id = 't0'").first()
    assert (row.decision, row.key, row.window_features.user_txn_count_1h) == ("reject", "u", 1)


def queue_brute(events):
    """The figures of the queues event by event, as lists."""
    out, queues = {}, {}
    for e in events:
        at = dt.datetime.fromisoformat(e["timestamp"])
        got = {}
        for kind, key, other, span in K.KINDS:
            queue = queues.setdefault((kind, e[key] or ""), [])
            queue.append((at, e["amount"], e[other]))
            while (at - queue[0][0]).total_seconds() > span:
                queue.pop(0)
            short = [x for x in queue if (at - x[0]).total_seconds() <= K.SHORT_SECONDS]
            got[kind] = (len(queue), sum(x[1] for x in queue), len({x[2] for x in queue if x[2]}), len(short), sum(x[1] for x in short))
        u, m = got["user"], got["merchant"]
        out[e["transaction_id"]] = (u[3], u[4], u[0], u[1], u[2], got["device"][2], got["ip"][2], m[0], m[1], m[2])
    return out


@pytest.mark.parametrize("late", [False, True])
def test_blocks_of_a_hot_entity_equal_plain_queues(spark, tmp_path, monkeypatch, late):
    monkeypatch.setattr(K, "BLOCK", 8)  # 90 % of the events have one payer: many blocks, trimmed over five batches
    rng = random.Random(late)
    events, clock = [], 0
    for i in range(600):
        clock += rng.choice([0, 1, 20, 60]) + (4000 if i in (250, 400) else 0)
        seconds = clock - (rng.choice([0, 0, 90, 400, 3000]) if late else 0)
        events.append(event(i, seconds, payer="hot" if rng.random() < 0.9 else f"u{i % 5}", payee=rng.choice(["", *[f"p{k}" for k in range(40)]]),
                            merchant=f"m{i % 2}", device=f"d{i % 3}", ip="i", amount=round(rng.random() * 9, 2)))
    got = by_state(spark, tmp_path / "in", [events[i:i + 120] for i in range(0, 600, 120)])
    for name, expected in queue_brute(events).items():
        assert tuple(got[name]) == pytest.approx(expected), name


class Kept:
    """State in a dictionary that counts the requests."""

    def __init__(self, owner):
        self.values, self.owner = {}, owner

    def _at(self, key):
        self.owner.requests += 1
        return self.values, key

    def containsKey(self, key):
        values, key = self._at(key)
        return key in values

    def getValue(self, key):
        values, key = self._at(key)
        return values[key]

    def updateValue(self, key, value):
        values, key = self._at(key)
        values[key] = value

    def removeKey(self, key):
        values, key = self._at(key)
        del values[key]


class Handle:
    requests = 0

    def getMapState(self, *_):
        return Kept(self)


SECOND = 1_000_000


def bucket_figures(batches, kind="user", bucket=0):
    """Figures by offset of rows (offset, entity, own, other, seconds, amount), and the state requests of each batch."""
    processor, handle, out, requests = K._Windows(), Handle(), {}, []
    processor.init(handle)
    for batch in batches:
        names = ("offset", "entity", "own", "other", "us", "amount")
        table = pa.table({n: [r[i] * SECOND if n == "us" else r[i] for r in batch] for i, n in enumerate(names)} | {
            "event_json": pa.array([None] * len(batch), pa.string()), "partition": [0] * len(batch), "arrived": [r[0] for r in batch]})
        shuffled = table.take(random.Random(1).sample(range(len(batch)), len(batch)))
        before = handle.requests
        for r in bundles.read(processor.handleInputRows((kind, bucket), bundles.written(shuffled), None)).to_pylist():
            out[r["offset"]] = tuple(r[c] for c in ("n", "total", "others", "n_short", "total_short"))
        requests.append(handle.requests - before)
    return out, requests


def plain_figures(batches, span=3600):
    out, queues = {}, {}
    for offset, entity, own, other, at, amount in [r for b in batches for r in b]:
        queue = queues.setdefault(entity, [])
        if own:
            queue.append((at, amount, other))
        while queue and at - queue[0][0] > span:
            queue.pop(0)
        near = [q for q in queue if at - q[0] <= K.SHORT_SECONDS]
        out[offset] = (len(queue), sum(q[1] for q in queue), len({q[2] for q in queue if q[2]}), len(near), sum(q[1] for q in near))
    return out


@pytest.mark.parametrize("late", [0, 5000])
@pytest.mark.parametrize("block", [512, 8])
@pytest.mark.parametrize("missing", [False, True])
def test_a_bucket_of_entities_equals_plain_queues(monkeypatch, block, late, missing):
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "PAGES", 5)
    monkeypatch.setattr(K, "PAIRS", 64)
    rng, clock, rows = random.Random(late + block), 0, []
    for i in range(1500):
        clock += rng.choice([0, 1, 20, 60]) + (9000 if i in (600, 1100) else 0)
        entity = "" if missing else "hot" if rng.random() < 0.5 else f"u{rng.randrange(90)}"
        rows.append((i, entity, not missing or rng.random() < 0.4, rng.choice([None, "", *[f"p{k}" for k in range(20)]]),
                     clock - rng.choice([0, late]), round(rng.random() * 9, 2)))
    batches = [rows[i:i + 300] for i in range(0, 1500, 300)]
    got, _ = bucket_figures(batches, bucket=-1 if missing else 3)
    for offset, expected in plain_figures(batches).items():
        assert got[offset] == pytest.approx(expected), offset


def test_state_requests_do_not_grow_with_the_entities():
    batches = [[(b * 3000 + i, f"u{i}", True, f"p{i % 7}", b * 1000 + i, 1.0) for i in range(3000)] for b in range(3)]
    got, requests = bucket_figures(batches)
    assert got == plain_figures(batches)
    assert max(requests) <= 3 * K.SHELVES  # it was two and more for each entity


def test_one_huge_amount_stays_with_its_entity():
    batches = [[(0, "a", True, "p", 0, 1e300), (1, "b", True, "p", 0, 0.1), (2, "b", True, "p", 1, 0.2)]]
    got, _ = bucket_figures(batches)
    assert got[2] == pytest.approx((2, 0.3, 1, 2, 0.3))


def test_bundles_keep_every_row(spark, monkeypatch):
    rows = spark.range(40_000).selectExpr("IF(id % 3 = 0, NULL, id % 3) AS k", "'x' AS kind", "id",
                                          "IF(id % 5 = 0, NULL, CAST(id AS STRING)) AS name")
    packed = bundles.bundled(rows, "kind", "k")
    assert packed.columns == ["kind", "k", "rows"] and packed.count() < 200
    back = bundles.opened(packed, rows.drop("k", "kind").schema)
    assert back.count() == 40_000 and back.exceptAll(rows.drop("k", "kind")).isEmpty()


def test_late_flags_do_not_depend_on_the_order_of_bundles():
    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, value):
            self.held = value

    class Top:
        getValueState = lambda self, *_: Value()

    tagger = V._LateTagger(60 * SECOND)
    tagger.init(Top())
    late = {}
    for batch in ([(1, 40), (0, 100), (2, 39)], [(5, 39), (3, 200), (4, None), (6, 140)]):
        frames = [f for o, s in batch for f in bundles.written(pa.table({
            "offset": [o], "event_us": pa.array([s and s * SECOND], pa.int64())}))]
        late |= {r["offset"]: r["is_late_event"] for r in bundles.read(tagger.handleInputRows((0,), iter(frames), None)).to_pylist()}
    assert late == {0: False, 1: False, 2: True, 3: False, 4: False, 5: True, 6: False}
