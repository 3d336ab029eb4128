"""Packing of token sequences by best-two-fit on the histogram of lengths.

Pieces of one length are alike, so bins are planned as patterns of lengths with a multiplicity.
The planner sees one count per length, at most ``capacity`` numbers whatever the table holds. Each
pattern is filled greedily, longest first; then its smallest piece gives way to two unpacked ones
if together they fill the gap better. A pattern is used as often as the counts allow, which
exhausts a length or nearly so, so the number of patterns is bounded by the lengths as well.
Pieces take their places by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import tokens
from ledgerlens.llm.tables import arrow_map, cut
from ledgerlens.operators.ordering import running_position

CAPACITY = 2048


@dataclass
class Pattern:
    lengths: list[int]
    times: int


def _greedy(counts: np.ndarray, longest: int, capacity: int) -> list[int]:
    lengths, gap, left = [longest], capacity - longest, Counter({longest: counts[longest] - 1})
    fit = gap
    while fit > 0:
        some = np.flatnonzero(counts[1:fit + 1])
        if not len(some):
            break
        size = int(some[-1]) + 1
        room = left.get(size, counts[size])
        if room <= 0:
            fit = size - 1
            continue
        take = int(min(room, gap // size))
        if take == 0:
            fit = min(gap, size - 1)
            continue
        lengths += [size] * take
        left[size] = room - take
        gap -= take * size
        fit = min(gap, size if left[size] else size - 1)
    return lengths


def _two_for_smallest(counts: np.ndarray, lengths: list[int], capacity: int) -> list[int]:
    """The bin with its smallest piece replaced by the two unpacked ones that fit best, if better."""
    if len(lengths) < 2:
        return lengths
    smallest = min(lengths)
    gap = capacity - sum(lengths) + smallest
    if gap == smallest:
        return lengths  # full
    left = counts[:gap + 1].copy()
    for size, used in Counter(lengths).items():
        if size <= gap:
            left[size] -= used
    have = np.flatnonzero(left > 0)
    have = have[have > 0]
    if not len(have):
        return lengths
    upto = np.zeros(gap + 1, dtype=np.int64)  # the largest available length up to each size
    upto[have] = have
    upto = np.maximum.accumulate(upto)
    other = upto[np.minimum(gap - have, have)]
    twice = (other == have) & (left[have] < 2)
    other[twice] = upto[np.minimum(gap - have[twice], have[twice] - 1)]
    sums = np.where(other > 0, have + other, 0)
    best = int(sums.argmax())
    if sums[best] <= smallest:
        return lengths
    kept = list(lengths)
    kept.remove(smallest)
    return kept + [int(have[best]), int(other[best])]


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        counts[size] = n
    patterns, longest = [], capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return patterns
        lengths = _two_for_smallest(counts, _greedy(counts, longest, capacity), capacity)
        uses = Counter(lengths)
        times = int(min(counts[size] // used for size, used in uses.items()))
        for size, used in uses.items():
            counts[size] -= used * times
        patterns.append(Pattern(lengths, times))


class _Places:
    """Where the r-th piece of each length goes; built from the patterns alone."""

    def __init__(self, patterns: list[Pattern]):
        taken: Counter = Counter()
        rows, base = [], 0
        for pattern in patterns:
            offsets: dict[int, list[int]] = {}
            at = 0
            for size in pattern.lengths:
                offsets.setdefault(size, []).append(at)
                at += size
            for size, places in offsets.items():
                rows.append((size, taken[size], base, places))
                taken[size] += len(places) * pattern.times
            base += pattern.times
        rows.sort(key=lambda r: r[:2])
        self.key = np.array([self.keyed(r[0], r[1]) for r in rows], dtype=np.int64)
        self.first = np.array([r[1] for r in rows], dtype=np.int64)
        self.base = np.array([r[2] for r in rows], dtype=np.int64)
        self.uses = np.array([len(r[3]) for r in rows], dtype=np.int64)
        self.spot = np.cumsum(self.uses) - self.uses
        self.offsets = np.array([o for r in rows for o in r[3]], dtype=np.int64)

    @staticmethod
    def keyed(size, rank):
        return size * (1 << 48) + rank

    def of(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.key, self.keyed(size, rank), side="right") - 1
        turn = rank - self.first[row]
        return self.base[row] + turn // self.uses[row], self.offsets[self.spot[row] + turn % self.uses[row]]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every text, cut into pieces of ``capacity`` ids.

    Only longer texts are cut, and the first piece takes the remainder.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = tokens.encode(batch.column("text"), tokenizer, end_id)
            size = np.diff(ids.first)
            pieces = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = size - (pieces - 1) * capacity
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            raw, begin = memoryview(ids.ids.astype("<u4")).cast("B"), (ids.first[row] + start) * 4
            crc = [zlib.crc32(raw[b:b + 4 * n]) for b, n in zip(begin.tolist(), length.tolist())]
            yield pa.record_batch([batch.column("id").take(pa.array(row)), pa.array(piece.astype(np.int32)),
                                   pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                                  names=["id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), run,
                     f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    Null and empty texts are one piece of one id. Repeated rows and null ids are packed like
    others. Sequences are numbered from 0 and filled from offset 0 without gaps. ``tokenizer`` is
    the path of a tokenizers file that executors can read.
    """
    pieces = cut(token_pieces(docs, tokenizer, end_id, capacity, id_col, text)
                 .withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not histogram:
        return pieces.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
                             F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    places = docs.sparkSession.sparkContext.broadcast(_Places(plan_bins(histogram, capacity)))
    ranked = running_position(pieces, ["row"], ["length"], out="rank").drop("row")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([batch.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)],
                                  names=kept + ["sequence_id", "offset"])

    out = arrow_map(ranked, run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
                                 "sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)
