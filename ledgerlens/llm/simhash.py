"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints are cut into 23-bit segments and each segment is decoded to the numbers of nearby
codewords, which gives several keys; fingerprints within the wanted distance share a key by the
pigeonhole principle. Equal keys meet in one bucket, where distances are verified.

Links inside 64 bits and 4 differences are all found. Segments A and B have 23
bits, C has 18. Of four differences, either some segment has none and another at most two (key:
one segment as it is, the codeword names of another), or two segments have exactly one each
(key: the decoded number of one with the names of the other, from both sides).

A bucket of up to ``BUCKET`` fingerprints is compared at once and gives a spanning forest, so no
list of all pairs is made. A larger bucket leaves its fingerprints to a second exact way that is
linear in them: two 64-bit fingerprints differ in at most four bits if and only if some value is
within two bits of both, so each of its 2,081 neighbours is named after its smallest owner.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import golay
from ledgerlens.llm.tables import arrow_map, cut, free_name, slices
from ledgerlens.llm.words import Words, words_of
from ledgerlens.operators.components import connected_components

BUCKET = 2048
EDGES = 400_000
_SEEDS = (42,)
_CHUNK = 1 << 16  # shingles whose bits are counted at once


def _single_spaced(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with exactly one space after each, and their new bounds."""
    size = words.end - words.start + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    out = np.full(int(size.sum()), 32, dtype=np.uint8)
    steps = np.zeros(len(words.data) + 1, dtype=np.int8)
    steps[words.start] += 1
    steps[words.end] -= 1
    inside = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
    place = np.ones(len(out), dtype=bool)
    place[end] = False
    out[place] = words.data[inside]
    return out, start, end


def fingerprints(column: pa.Array, shingle: int, seeds: tuple[int, ...] = (42,)) -> np.ndarray:
    """One row of unsigned 64-bit fingerprints per text, one per seed; no words give zero."""
    words = words_of(column, lower=True)
    data, start, end = _single_spaced(words)
    view = memoryview(data)
    out = np.zeros((len(words.first) - 1, len(seeds)), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for row in range(len(out)):
        low, high = int(words.first[row]), int(words.first[row + 1])
        if low == high:
            continue
        total = max(1, high - low - shingle + 1)
        begins = start[low:low + total].tolist()
        ends = end[min(low + shingle, high) - 1:high].tolist()
        for k, seed in enumerate(seeds):
            ones = np.zeros(64, dtype=np.int64)
            for at in range(0, total, _CHUNK):
                hashed = np.array([digest(view[s:e], seed) for s, e in
                                   zip(begins[at:at + _CHUNK], ends[at:at + _CHUNK])], dtype=np.uint64)
                bits = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.int64)
            out[row, k] = np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0]
    return out


def _pack(*parts: tuple[np.ndarray | int, int]) -> np.ndarray:
    """One number from (value, bits) parts; -1 in a part makes the whole -1 (no key)."""
    out, void = np.int64(0), False
    for value, bits in parts:
        value = np.asarray(value, dtype=np.int64)
        void = void | (value < 0)
        out = (out << bits) | (value & ((1 << bits) - 1))
    return np.where(void, -1, out)


def exact_keys(prints: np.ndarray) -> np.ndarray:
    """Keys (columns; -1: none) of one-column fingerprints for up to 4 differing bits."""
    value = prints[:, 0]
    cuts = [(0, 23), (23, 23), (46, 18)]
    segments = [(value >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in cuts]
    many = [golay.names(s) for s in segments]
    one = [golay.decode(s) for s in segments]
    keys, family = [], 0
    for whole, near in ((0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)):
        keys.append(_pack((family, 8), (segments[whole][:, None], 23), (many[near], 12)))
        family += 1
    for x, y in ((0, 1), (0, 2), (1, 2)):
        keys.append(_pack((family, 8), (one[x][:, None], 12), (many[y], 12)))
        keys.append(_pack((family, 8), (many[x], 12), (one[y][:, None], 12)))
        family += 1
    return np.concatenate(keys, axis=1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits between fingerprints; the last axis holds their 64-bit parts."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what links inside one bucket, at most one per fingerprint."""
    todo = np.arange(len(prints))
    edges, front = [], []
    while len(todo):
        if not front:
            front, todo = [todo[0]], todo[1:]
            continue
        here = front.pop(0)  # nearest to the smallest first
        near = _distance(prints[todo], prints[here]) <= radius
        edges += [(here, other) for other in todo[near]]
        front += todo[near].tolist()
        todo = todo[~near]
    return edges


def _bucket_edges(width: int, radius: int):
    """Task: rows sorted by key in, edges out; ``far`` marks a member of a bucket left aside.

    At most ``BUCKET`` rows of one key and one Arrow batch are held.
    """
    columns = [f"p{i}" for i in range(width)]
    schema = pa.schema([pa.field(f"{side}{i}", pa.int64()) for side in "ab" for i in range(width)]
                       + [pa.field("far", pa.bool_())])

    def edges_of(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(keys)
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(edge, n))
        small = np.repeat(sizes <= 16, sizes)
        left, right = [], []
        for shift in range(1, 16):  # small buckets, all at once: each row with its next ones
            rows = np.flatnonzero((keys[shift:] == keys[:-shift]) & small[shift:]) if n > shift else []
            if not len(rows):
                break
            near = _distance(prints[rows], prints[rows + shift]) <= radius
            left.append(rows[near])
            right.append(rows[near] + shift)
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            first = np.full(n, n, dtype=np.int64)
            np.minimum.at(first, b, a)
            # A link to a row that links to the first neighbour as well connects nothing new.
            needed = (a == first[b]) | (_distance(prints[first[b]], prints[a]) > radius)
            left, right = [a[needed]], [b[needed]]
        for at, size in zip(edge[sizes > 16], sizes[sizes > 16]):
            found = _forest(prints[at:at + size], radius)
            if found:
                ends = np.array(found) + at
                left.append(ends[:, 0])
                right.append(ends[:, 1])
        if left:
            a, b = prints[np.concatenate(left)], prints[np.concatenate(right)]
            yield from emit(a, b, False)

    def emit(a: np.ndarray, b: np.ndarray, far: bool) -> Iterator[pa.RecordBatch]:
        if len(a):
            parts = [np.ascontiguousarray(x[:, i]).view(np.int64) for x in (a, b) for i in range(width)]
            yield pa.record_batch([pa.array(p) for p in parts] + [pa.array(np.full(len(a), far))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_keys = np.zeros(0, dtype=np.int64)
        kept = np.zeros((0, width), dtype=np.uint64)
        large = None  # the key of a bucket that has outgrown the limit
        for batch in batches:
            keys = batch.column("key").to_numpy()
            prints = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in columns], axis=1)
            keys, prints = np.concatenate((kept_keys, keys)), np.concatenate((kept, prints))
            if large is not None:
                more = keys == large
                yield from emit(prints[more], prints[more], True)
                keys, prints = keys[~more], prints[~more]
            if not len(keys):
                kept_keys, kept = keys, prints
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            done_keys, done = keys[:last], prints[:last]
            if last:
                starts = np.flatnonzero(np.concatenate(([True], done_keys[1:] != done_keys[:-1])))
                sizes = np.diff(np.append(starts, last))
                over = np.repeat(sizes > BUCKET, sizes)
                for at, size in zip(starts[sizes > BUCKET], sizes[sizes > BUCKET]):
                    yield from emit(done[at:at + size], done[at:at + size], True)
                if not over.all():
                    yield from edges_of(done_keys[~over], done[~over])
            kept_keys, kept = keys[last:], prints[last:]
            if len(kept) > BUCKET:
                large = kept_keys[0]
                yield from emit(kept, kept, True)
                kept_keys, kept = kept_keys[:0], kept[:0]
        if len(kept_keys):
            yield from edges_of(kept_keys, kept)

    return run, ", ".join(f"{side}{i} bigint" for side in "ab" for i in range(width)) + ", far boolean"


def _key_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                piece = batch.slice(at, 4096)
                prints = np.stack([piece.column(f"p{i}").to_numpy().view(np.uint64) for i in range(width)], axis=1)
                keys = np.sort(exact_keys(prints), axis=1)
                fresh = keys >= 0
                fresh[:, 1:] &= keys[:, 1:] != keys[:, :-1]
                row = np.nonzero(fresh)[0]
                yield pa.record_batch([pa.array(keys[fresh])] + [
                    pa.array(np.ascontiguousarray(prints[row, i]).view(np.int64)) for i in range(width)],
                    names=["key"] + [f"p{i}" for i in range(width)])
    return run, "key bigint, " + ", ".join(f"p{i} bigint" for i in range(width))


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All values within two bits of each fingerprint."""
    masks = np.array([0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)],
                     dtype=np.uint64)
    for batch in batches:
        for at in range(0, len(batch), 256):
            prints = batch.column("p0").to_numpy()[at:at + 256].view(np.uint64)
            mids = (prints[:, None] ^ masks[None, :]).ravel()
            yield pa.record_batch([pa.array(mids.view(np.int64)),
                                   pa.array(np.repeat(prints, len(masks)).view(np.int64))], names=["mid", "p0"])


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: (smallest owner, owner) of each value of two or more; rows come sorted by value and owner."""
    mid, low = None, 0
    for batch in batches:
        if not len(batch):
            continue
        mids, prints = (batch.column(c).to_numpy() for c in ("mid", "p0"))
        first = np.concatenate(([mids[0] != mid], mids[1:] != mids[:-1]))
        lows = np.concatenate(([low], prints[first]))[np.cumsum(first)]
        mid, low = mids[-1], lows[-1]
        linked = ~first
        yield pa.record_batch([pa.array(lows[linked]), pa.array(prints[linked])], names=["low", "p0"])


def _far_links(far: DataFrame) -> DataFrame:
    """Links among the fingerprints of large buckets, through the values between them.

    Values are sorted, not joined: their number is not known to the planner, which would send them to the driver.
    """
    mids = arrow_map(far, _between, "mid bigint, p0 bigint").repartition("mid").sortWithinPartitions("mid", "p0")
    return arrow_map(mids, _owned, "low bigint, p0 bigint").distinct()


def _spanning(width: int):
    """Task: of its edges, those that join two parts of what it has seen so far."""
    names = [f"{side}{i}" for side in "ab" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[tuple, tuple] = {}

        def root(node: tuple) -> tuple:
            while (above := parent.setdefault(node, node)) != node:
                parent[node] = parent[above]
                node = above
            return node

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in names]
            kept = []
            for row, ends in enumerate(zip(*columns)):
                a, b = root(ends[:width]), root(ends[width:])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    kept.append(row)
            yield batch.take(pa.array(kept, pa.int64()))

    return run, ", ".join(f"{c} bigint" for c in names)


def spanning(edges: DataFrame, width: int) -> DataFrame:
    """Fewer edges with the same components: each task keeps a forest of at most ``EDGES`` edges."""
    task, schema = _spanning(width)
    return arrow_map(edges.repartition(max(1, -(-edges.count() // EDGES))), task, schema)


def links(prints: DataFrame, radius: int, exact: bool = True) -> DataFrame:
    """Edges (a0.., b0..) that connect the distinct fingerprints of ``prints`` (p0..); all are found."""
    if not exact or radius > 4:
        raise ValueError("the keys are exact and cover 4 differing bits")
    width = len(prints.columns)
    names = [f"{side}{i}" for side in "ab" for i in range(width)]
    rows, key_schema = _key_rows(width)
    key_order = ["key", *prints.columns]  # equal order in all buckets makes equal stars, and few distinct edges
    task, edge_schema = _bucket_edges(width, radius)
    keyed = arrow_map(prints, rows, key_schema).repartition("key").sortWithinPartitions(*key_order)
    edges = cut(arrow_map(keyed, task, edge_schema), "links")
    near = spanning(cut(edges.where("NOT far").select(*names).distinct(), "near"), width)
    far = cut(edges.where("far").select(*[F.col(f"a{i}").alias(f"p{i}") for i in range(width)]).distinct(), "far")
    return near if far.isEmpty() else near.unionByName(_far_links(far).toDF(*names))


def fingerprint_table(docs: DataFrame, text: str, shingle: int, seeds: tuple[int, ...]) -> DataFrame:
    """``docs`` without its text, with fingerprint columns p0.. (signed longs)."""
    others = [c for c in docs.columns if c != text]
    width = len(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            prints = fingerprints(batch.column(text), shingle, seeds)
            yield pa.record_batch(
                [batch.column(c) for c in others]
                + [pa.array(np.ascontiguousarray(prints[:, i]).view(np.int64)) for i in range(width)],
                names=others + [f"p{i}" for i in range(width)])

    fields = [docs.schema[c] for c in others]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"p{i} bigint" for i in range(width)])
    return arrow_map(docs.select(*others, text), run, schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4,
                    radius: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``docs``.

    64-bit fingerprints and all links of up to 4 bits (``radius`` may be less). ``component_id`` is
    the smallest id that links reach. Null and empty texts, and texts without words, have
    fingerprint zero and link like others. Repeated rows are separate rows of one component.
    Rows with a null id keep their fingerprint and never lend their id to a component unless all
    its ids are null. Other columns are not read.
    """
    if radius > 4:
        raise ValueError("the keys cover 4 differing bits")
    parts = ["p0"]
    table = cut(fingerprint_table(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")),
                                  "_text", shingle, _SEEDS), "prints")
    own = cut(table.groupBy(*parts).agg(F.min("_id").alias("_low")), "distinct")
    edges = links(own.select(*parts), radius)
    node = lambda side: F.col(f"{side}0")
    groups = connected_components(edges.select(node("a").alias("src"), node("b").alias("dst")))
    named = own.withColumn("_node", node("p")).join(
        groups.select(F.col("node").alias("_node"), "component"), "_node", "left").select(
        *parts, "_low", F.coalesce("component", "_node").alias("_group"))
    lowest = named.groupBy("_group").agg(F.min("_low").alias("component_id"))
    reached = named.join(lowest, "_group").select(*parts, "component_id")
    shown = F.concat(*[F.lower(F.lpad(F.hex(p), 16, "0")) for p in parts])
    return table.join(reached, parts).select(F.col("_id").alias(id_col), shown.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5,
             similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest id.

    Texts link if they share ``similarity`` of their distinct shingles (Jaccard), which is verified
    on the texts. Candidates come from minimum hashes, made for a similarity of 0.8 or more. Rows
    without words are one group. Of repeated rows with the smallest id one stays; a group whose ids
    are all null keeps one row.
    """
    from ledgerlens.llm import jaccard  # which takes its spanning forests from here

    if similarity < jaccard.LEAST:
        raise ValueError(f"the candidate keys are made for a similarity of {jaccard.LEAST} or more")
    a, b, place = (free_name(docs, n) for n in ("_row_a", "_row_b", "_row_place"))
    keyed = docs.withColumns({a: F.xxhash64(F.lit(0), text), b: F.xxhash64(F.lit(1), id_col)})
    rows = keyed.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
                                 F.col(a).alias("a"), F.col(b).alias("b")).alias("_id"), F.col(text).alias("_text"))
    gone = jaccard.linked(rows, jaccard.candidates(rows, shingle), shingle, similarity).where(
        "_id != component_id").select(F.col("_id.a").alias(a), F.col("_id.b").alias(b)).distinct()
    once = Window.partitionBy(a, b).orderBy(F.lit(0))
    return (keyed.join(gone, [a, b], "left_anti").withColumn(place, F.row_number().over(once))
            .where(F.col(place) == 1).select(*docs.columns))
