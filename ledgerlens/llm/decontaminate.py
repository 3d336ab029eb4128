"""Benchmark decontamination with a broadcast hash set of the benchmark's word windows.

The distinct windows of the benchmark are hashed, checked in number and broadcast in slices of at
most ``SLICE`` windows, so what the driver or a task holds is bounded however large the benchmark is
and however many items share a passage. Each slice is one scan of the documents; a hit by hash is
verified by its words. Slices are merged by row.

A scan does not know items: windows of the same items carry one number, a text's finding is a list
of such numbers, and each distinct list is joined with its items once, not once per text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import arrow_map, cut, free_name, slices
from ledgerlens.llm.words import ALNUM, Words, covered, rolling, row_sums, window_starts, words_of
from ledgerlens.operators.ordering import running_position

SLICE = 1_000_000
WINDOW = 10


def benchmark_windows(items: DataFrame, id_col: str, text: str, window: int) -> DataFrame:
    """(item, size, hash, words) of every window; an item with fewer words is one window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column("text"), ALNUM, lower=True)
            ids = batch.column("item").to_pylist()
            out = []
            for row, item in enumerate(ids):
                low, high = int(words.first[row]), int(words.first[row + 1])
                size = min(window, high - low)
                if size:
                    hashed = rolling(words.hash[low:high], size)
                    out += [(item, size, int(h.view(np.int64)), words.joined(low + i, size))
                            for i, h in enumerate(hashed)]
            yield pa.RecordBatch.from_pylist([dict(zip(("item", "size", "hash", "words"), r)) for r in out],
                                             schema=pa.schema([("item", pa.string()), ("size", pa.int32()),
                                                               ("hash", pa.int64()), ("words", pa.binary())]))

    chosen = items.select(F.col(id_col).cast("string").alias("item"), F.col(text).alias("text"))
    return arrow_map(chosen, run, "item string, size int, hash bigint, words binary")


def _numbered(items: DataFrame, id_col: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (size, hash, words, set), and (set, item): windows of the same items share a set.

    Items are compared by their number and two sums of 64-bit hashes. Items without an id have
    windows but are no members.
    """
    each = cut(benchmark_windows(items, id_col, text, window).distinct(), "windows")
    same = ["count", "sum", "other"]
    name = lambda seed: F.sum(F.xxhash64("item", F.lit(seed)).cast("decimal(38,0)"))
    windows = cut(each.groupBy("size", "words").agg(
        F.first("hash").alias("hash"), F.count("item").alias("count"), name(1).alias("sum"), name(2).alias("other")), "named")
    sets = cut(windows.groupBy(*same).agg(F.min(F.struct("size", "words")).alias("one")).withColumn(
        "set", F.monotonically_increasing_id()), "sets")
    members = sets.select("set", "one.size", "one.words").join(each, ["size", "words"]).where(
        F.col("item").isNotNull()).select("set", "item")
    return cut(windows.join(sets.drop("one"), same).select("size", "hash", "words", "set"), "numbered"), members


class _Slice:
    """Windows of one slice, by size: sorted hashes, and the set of each window's words."""

    def __init__(self, rows):
        self.sets: dict[bytes, int] = {}
        by_size = defaultdict(set)
        for size, hashed, words, owner in rows:
            self.sets[bytes(words)] = owner
            by_size[size].add(hashed)
        self.hashes = {size: np.sort(np.array(list(found), dtype=np.int64).view(np.uint64))
                       for size, found in by_size.items()}
        self.maybe = {}
        for size, found in self.hashes.items():
            bits = np.zeros(1 << 20, dtype=bool)
            bits[found & np.uint64((1 << 20) - 1)] = True
            self.maybe[size] = bits

    def hits(self, words: Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Hit words of a batch, and the sets found by row."""
        hit = np.zeros(len(words.start), dtype=bool)
        sets: dict[int, set[int]] = defaultdict(set)
        for size, found in self.hashes.items():
            rolled = rolling(words.hash, size)
            if not len(rolled):
                continue
            place = np.flatnonzero(self.maybe[size][rolled & np.uint64((1 << 20) - 1)])
            at = np.minimum(np.searchsorted(found, rolled[place]), len(found) - 1)
            place = place[found[at] == rolled[place]]
            place = place[np.isin(place, window_starts(words.first, size), assume_unique=True)] if len(place) else place
            sure = []
            for start in place.tolist():
                owner = self.sets.get(words.joined(start, size))
                if owner is not None:
                    sure.append(start)
                    sets[int(np.searchsorted(words.first, start, side="right")) - 1].add(owner)
            if sure:
                hit |= covered(len(hit), np.array(sure), size)
        return hit, sets


ADDED = ("_n_words", "_runs", "_items", "_sets", "_all")


def _runs(hit: np.ndarray) -> list[int]:
    """Bounds of the runs of True: start, end, start, end, ..."""
    return np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))).tolist()


def _scan(docs: DataFrame, text: str, piece) -> DataFrame:
    """``docs`` with n_words, hit runs (word bounds) and sets found for one slice."""
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = piece.value
        for batch in slices(batches, text):
            words = words_of(batch.column(text), ALNUM, lower=True)
            hit, sets = found.hits(words)
            some = row_sums(hit, words.first) > 0
            runs = [_runs(hit[words.first[i]:words.first[i + 1]]) if some[i] else [] for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array(np.diff(words.first)), pa.array(runs, pa.list_(pa.int32())),
                                 pa.array([sorted(sets.get(i, ())) for i in range(len(batch))], pa.list_(pa.int64()))],
                names=kept + ["_n_words", "_runs", "_sets"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(docs, run, f"{schema}, _n_words bigint, _runs array<int>, _sets array<bigint>")


def _scan_all(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_n_words``, ``_runs`` and ``_sets`` over all slices."""
    pieces = max(1, -(-windows.count() // SLICE))
    context = docs.sparkSession.sparkContext
    broadcast = lambda rows: context.broadcast(_Slice(rows.collect()))  # noqa: E731, at most SLICE windows
    if pieces == 1:
        return _scan(docs, text, broadcast(windows))
    placed = cut(running_position(windows, ["hash", "size", "words"], out="at"), "placed")
    row = free_name(docs, "_row")
    fixed = cut(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    parts = [cut(_scan(fixed.select(row, text), text, broadcast(placed.where(
        (F.col("at") >= at * SLICE) & (F.col("at") < (at + 1) * SLICE)).select(windows.columns))).drop(text), "hits")
        for at in range(pieces)]
    merged = reduce(DataFrame.unionByName, parts).groupBy(row).agg(
        F.max("_n_words").alias("_n_words"), F.collect_list("_runs").alias("_all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_sets")))).alias("_sets"))
    return fixed.join(_merge_runs(merged), row).select(*docs.columns, "_n_words", "_runs", "_sets")


def _with_items(found: DataFrame, members: DataFrame, empty: dict, **of_items) -> DataFrame:
    """A written scan with columns made of the sorted items of each distinct list of sets."""
    lists = found.where(F.size("_sets") > 0).select("_sets").distinct()
    pairs = lists.select("_sets", F.explode("_sets").alias("set")).join(members, "set").select("_sets", "item").distinct()
    known = pairs.groupBy("_sets").agg(F.array_sort(F.collect_list("item")).alias("_items")).select(
        "_sets", *[value.alias(name) for name, value in of_items.items()])
    columns = [c for c in found.columns if c != "_sets"]
    hit = found.where(F.size("_sets") > 0).join(known, "_sets", "left").select(
        *columns, *[F.coalesce(name, value).alias(name) for name, value in empty.items()])
    clean = found.where(F.size("_sets") == 0)  # no join: these would all share one key
    return hit.unionByName(clean.select(*columns, *[value.alias(name) for name, value in empty.items()]))


def find_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
              item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: all its columns, then ``_n_words``, ``_runs`` and ``_items``.

    ``_runs`` holds the bounds of runs of hit words, ``_items`` the ids of items with windows in
    the text. Null and empty texts have no words and no hits; items without words are no windows;
    repeated items are one; items without an id hit but are not listed. An empty benchmark hits
    nothing. Very long texts are read whole. Clashing column names raise.
    """
    windows, members = _numbered(items, item_id, item_text, window)
    found = cut(_scan_all(docs, windows, text), "found")
    return _with_items(found, members, {"_items": F.array().cast("array<string>")}, _items=F.col("_items"))


def _merge_runs(df: DataFrame) -> DataFrame:
    """Union of the run lists in ``_all``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for count, lists in zip(batch.column("_n_words").to_pylist(), batch.column("_all").to_pylist()):
                hit = np.zeros(count, dtype=bool)
                for bounds in lists:
                    for low, high in zip(bounds[::2], bounds[1::2]):
                        hit[low:high] = True
                out.append(_runs(hit))
            at = batch.schema.get_field_index("_all")
            yield batch.remove_column(at).append_column("_runs", pa.array(out, pa.list_(pa.int32())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "_all")
    return arrow_map(df, run, schema + ", _runs array<int>")


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every row, as ``find_hits`` says."""
    windows, members = _numbered(items, item_id, item_text, window)
    scanned = _scan_all(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), windows, "_text")
    ends = F.expr("transform(sequence(1, size(_runs) div 2), i -> _runs[2 * i - 1] - _runs[2 * i - 2])")
    hits = F.when(F.size("_runs") > 0, F.aggregate(ends, F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(F.lit(0).cast("bigint"))
    found = cut(scanned.select("_id", "_n_words", hits.alias("_n_hit"), "_sets"), "found")
    digest = lambda items: {"n_items": F.size(items).cast("bigint"),
                            "items_sha256": F.sha2(F.array_join(items, ","), 256)}
    named = _with_items(found, members, digest(F.array().cast("array<string>")), **digest(F.col("_items")))
    return named.select(
        F.col("_id").alias(id_col), F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"),
        "n_items", "items_sha256", (F.col("_n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                        item_text: str = "text", window: int = WINDOW, spans: bool = False) -> DataFrame:
    """``docs`` without the rows that hit, or (``spans``) without the hit words only.

    With ``spans`` the rest of a hit row is joined as it stands: each run of hit words goes with
    the characters between its words. Rows without a hit are unchanged, null texts included. Columns
    named like those of ``find_hits`` keep their names and values. Repeated rows are judged alike;
    very long texts are read whole.
    """
    aside = {c: free_name(docs, f"{c}_") for c in docs.columns if c.lower() in ADDED}
    if aside:
        given = docs.columns
        out = remove_contaminated(docs.withColumnsRenamed(aside), items, aside.get(text, text), item_id, item_text, window, spans)
        return out.withColumnsRenamed({new: old for old, new in aside.items()}).select(*given)
    found = _scan_all(docs, _numbered(items, item_id, item_text, window)[0], text)  # items are not asked for
    if not spans:
        return found.where(F.size("_runs") == 0).select(*docs.columns)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            words = words_of(batch.column(text), ALNUM, lower=True)
            for row, bounds in enumerate(batch.column("_runs").to_pylist()):
                if not bounds:
                    continue
                raw, base = texts[row].encode(), None
                low, high = int(words.first[row]), int(words.first[row + 1])
                own = words_of(pa.array([texts[row]]), ALNUM, lower=True)
                assert high - low == len(own.start)
                out, base = [], 0
                for begin, end in zip(bounds[::2], bounds[1::2]):
                    out.append(raw[base:int(own.start[begin])])
                    base = int(own.end[end - 1])
                texts[row] = b"".join(out + [raw[base:]]).decode()
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, text, pa.array(texts, pa.string())).select(columns)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(found, run, schema)
