"""Toxicity by logistic regression, learnt with FTRL-proximal over hashed word features.

Features of a text are its words, word pairs, and pairs that skip one or two words, hashed into
2^20 slots and counted once per text. Inflected words are rare one by one, so words also count by
their stems, the first five to nine bytes of a longer word. McMahan et al., "Ad click prediction: a view from the
trenches" (2013): every slot has its own rate, and the L1 term leaves most weights at exactly
zero, so the model is a short list of weights that is broadcast.

The model is fitted on a sample of bounded size, at most ``PER_CLASS`` labelled rows of each label
in hash order, by one task; the intercept is then moved by the labels' true odds, counted over
all learning rows. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import arrow_map, cut, free_name, slices
from ledgerlens.llm.words import ALNUM, mix, span_hashes, words_of

SLOTS = 1 << 20
PER_CLASS = 4_000
THRESHOLD = 0.3
_ALPHA, _BETA, _L1, _L2, _PASSES = 0.3, 1.0, 6.0, 0.1, 4
STEMS = range(5, 10)
_KINDS = np.random.default_rng(5).integers(0, 2**63, 4 + len(STEMS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def held_out(id_col: str) -> Column:
    """Rows that learning must not see: crc32 of the id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, slot) arrays, one pair for each kind of feature; repeats included."""
    words = words_of(column, ALNUM, lower=True)
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    mask = np.uint64(SLOTS - 1)
    yield row, (mix(words.hash * _KINDS[0]) & mask).astype(np.int64)
    for kind, size in enumerate(STEMS, 4):
        longer = np.flatnonzero(words.end - words.start > size)
        stem = span_hashes(words.data, words.start[longer], words.start[longer] + size)
        yield row[longer], (mix(stem * _KINDS[kind]) & mask).astype(np.int64)
    for gap in (1, 2, 3):
        if len(row) > gap:
            same = row[gap:] == row[:-gap]
            pair = words.hash[:-gap][same] * _KINDS[gap] + words.hash[gap:][same]
            yield row[:-gap][same], (mix(pair) & mask).astype(np.int64)


def _row_slots(column: pa.Array) -> list[np.ndarray]:
    """The distinct slots of each row."""
    rows, slots = zip(*features(column))
    both = np.unique(np.concatenate(rows) * SLOTS + np.concatenate(slots))
    bounds = np.searchsorted(both, np.arange(len(column) + 1) * SLOTS)
    return [(both[a:b] % SLOTS).astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:])]


class Ftrl:
    def __init__(self):
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)  # the last slot is the intercept

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(np.asarray(at) == SLOTS, 0.0, _L1), 0)
        return -shrunk / ((_BETA + np.sqrt(n)) / _ALPHA + _L2)

    def learn(self, slots: np.ndarray, label: int) -> None:
        at = np.append(slots, SLOTS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / _ALPHA * w
        self.n[at] = n + g * g


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(np.frombuffer(s, np.int32), label) for batch in batches
            for s, label in zip(batch.column("slots").to_pylist(), batch.column("label").to_pylist())]
    model = Ftrl()
    for _ in range(_PASSES):
        for slots, label in rows:
            model.learn(slots, label)
    weights = model.weights(np.arange(SLOTS + 1))
    used = np.flatnonzero(weights)
    yield pa.record_batch([pa.array(used), pa.array(weights[used])], names=["slot", "weight"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
        per_class: int = PER_CLASS) -> tuple[dict[int, float], float]:
    """Non-zero weights by slot (``SLOTS``: the intercept) and the share of toxic learning rows.

    Learns only from rows that are not held out. A document with several labels takes the largest;
    null labels and labels of unknown documents teach nothing.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.col(label)).cast("int").alias("label"))
    known = cut(known.withColumn("order", F.xxhash64("_id")), "labels")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, total = counts.get(1, 0), sum(counts.values())
    if not positive or positive == total:
        return {}, float(positive > 0)
    chosen = None
    for value in (0, 1):
        some = known.where(F.col("label") == value).orderBy("order", "_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = cut(chosen, "sample")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            if len(batch):
                yield pa.record_batch([pa.array([s.tobytes() for s in _row_slots(batch.column("text"))], pa.binary()),
                                       batch.column("label"), batch.column("order")], names=["slots", "label", "order"])

    # At most two times per_class narrow rows are broadcast.
    sampled = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")
    slots = cut(arrow_map(sampled.select("text", "label", "order"), extract, "slots binary, label int, order bigint"), "slots")
    shown = {r["label"]: r["n"] for r in slots.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shown) < 2:
        return {}, positive / total
    one_task = slots.repartition(1).sortWithinPartitions("order", "slots")
    weights = {r["slot"]: r["weight"] for r in arrow_map(one_task, _fit, "slot bigint, weight double").collect()}
    prior = np.log(positive / (total - positive)) - np.log(shown[1] / shown[0])
    weights[SLOTS] = weights.get(SLOTS, 0.0) + float(prior)
    return weights, positive / total


def score(docs: DataFrame, model: tuple[dict[int, float], float], text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``, the chance in [0, 1] that the text is toxic.

    Texts without words, null and empty ones included, get the share of toxic labels: nothing is
    known of them. So does every row where the labels are of one kind; without labels it is 0.
    """
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    weights, share = model
    dense = np.zeros(SLOTS + 1, dtype=np.float32)
    for slot, weight in weights.items():
        dense[slot] = weight
    shared = docs.sparkSession.sparkContext.broadcast(dense)  # 4 MB whatever the corpus
    fitted, names = bool(weights), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in slices(batches, text):
            total = np.full(len(batch), w[SLOTS], dtype=np.float64)
            found, known = [], np.zeros(len(batch), dtype=bool)
            for row, slot in features(batch.column(text)):
                known[row] = True
                live = w[slot] != 0
                found.append(row[live] * SLOTS + slot[live])
            both = np.unique(np.concatenate(found))
            np.add.at(total, both // SLOTS, w[both % SLOTS])
            chance = np.where(known & fitted, 1 / (1 + np.exp(-np.clip(total, -35, 35))), share)
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(chance)], names=names + [out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(docs, run, f"{schema}, `{out}` double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
             threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``."""
    model = fit(docs, labels, id_col, text, label)
    return score(docs.select(id_col, text), model, text).select(
        id_col, held_out(id_col).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
               threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; all columns stay."""
    mark = free_name(docs, "_toxicity")
    return score(docs, fit(docs, labels, id_col, text, label), text, mark).where(
        F.col(mark) < threshold).select(*docs.columns)
