"""Removal of repeated passages by fixed-block anchors.

A repeat of ``window`` words contains a whole aligned block of ``(window + 1) // 2`` words of the
text it repeats, so it is enough to index the non-overlapping blocks of every text and to probe
them with every rolling window of that length. Chunks send the distinct truncated hashes of their
windows to hashed buckets, marked where they are blocks; a hash that is a block somewhere and
occurs in two documents is an anchor. Around anchors only, whole windows are hashed with 96 bits
and the smallest document of each is found in a second exchange. A window whose smallest document
is an earlier one is a repeat, and runs of such windows are the maximal repeats around anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm import chunks as C
from ledgerlens.llm.tables import cut
from ledgerlens.llm.words import covered, mix, rolling, window_starts

WINDOW = 13


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order, and for the sorted values the starts of equal runs, and the run of each."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


class _Anchors:
    """Probes of one chunk: its rolling block-sized windows, by truncated hash."""

    def __init__(self, chunk: C.Chunk, block: int, bits: int):
        words = chunk.hashes[chunk.tokens]
        self.place = window_starts(chunk.first, block)
        values = rolling(words, block)[self.place] >> np.uint64(64 - bits)
        self.order, self.runs, run = _distinct(values)
        self.values = values[self.order][self.runs]
        row = chunk.row[self.place]
        aligned = (self.place - chunk.first[row]) % block == 0
        doc = chunk.ids[row][self.order]
        some = len(self.runs) > 0
        self.block = np.logical_or.reduceat(aligned[self.order], self.runs) if some else np.zeros(0, bool)
        self.several = (np.minimum.reduceat(doc, self.runs) < np.maximum.reduceat(doc, self.runs)) if some else np.zeros(0, bool)
        self.run_of = run

    def hit_places(self, hit: np.ndarray) -> np.ndarray:
        """Word positions where an anchor begins, from a flag per distinct value."""
        return self.place[self.order[hit[self.run_of]]]


class _Windows:
    """Windows of one chunk that contain an anchor: distinct hashes and smallest documents."""

    def __init__(self, chunk: C.Chunk, anchors: np.ndarray, window: int, block: int):
        words = chunk.hashes[chunk.tokens]
        start = window_starts(chunk.first, window)
        live = np.zeros(len(words) + 1, dtype=np.int64)
        live[anchors + 1] = 1
        live = np.cumsum(live)
        start = start[live[start + window - block + 1] > live[start]]
        self.start = start
        key = rolling(words, window)[start]
        check = rolling(mix(words + np.uint64(1)), window)[start] >> np.uint64(32)
        order = np.lexsort((check, key))
        key, check = key[order], check[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        runs = np.flatnonzero(new)
        self.order, self.run_of = order, np.cumsum(new) - 1
        self.key, self.check = key[runs], check[runs]
        self.doc = chunk.ids[chunk.row[start]]
        self.low = np.minimum.reduceat(self.doc[order], runs) if len(runs) else np.zeros(0, np.int64)

    def repeated(self, earlier: np.ndarray) -> np.ndarray:
        """Starts of windows that also begin in a document with a smaller id."""
        again = earlier[self.run_of] | (self.doc[self.order] > self.low[self.run_of])
        return self.start[self.order[again]]


def _gather(answers: dict[int, bytes], sizes: Iterator[tuple[int, slice]], n: int) -> np.ndarray:
    flags = np.zeros(n, dtype=bool)
    for bucket, part in sizes:
        flags[part] = C.unpack_flags(C.unpack(answers[bucket])[0], part.stop - part.start)
    return flags


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
                   texts: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row of ``docs``, with ``texts`` also the text.

    A word is removed if a window that covers it also begins in a document with a smaller id;
    windows are judged on the input. Kept words are joined by single spaces. Ids must be whole
    numbers; a null id counts as larger than all others, and rows that share an id leave each
    other alone. Null, empty and short texts lose nothing. Other columns are not read.
    """
    block = (window + 1) // 2
    chunks = C.write_chunks(docs, id_col, text, lower=False, end=False)
    total = C.word_count(chunks, False)
    buckets = C.bucket_count(total)
    bits = min(64, max(32, total.bit_length() + 6))  # enough that few windows meet by chance
    shift = np.uint64(bits - (buckets.bit_length() - 1))

    def by_value(anchors: _Anchors):
        return C.split_sorted((anchors.values >> shift).astype(np.int64) if shift < 64 else np.zeros(len(anchors.values), np.int64), buckets)

    def probe(chunk: C.Chunk, _) -> Iterator[pa.RecordBatch]:
        anchors = _Anchors(chunk, block, bits)
        yield C.messages(chunk.number, ((bucket, C.pack(
            C.gaps(anchors.values[part]), C.pack_flags(anchors.block[part]), C.pack_flags(anchors.several[part])))
            for bucket, part in by_value(anchors)))

    def meet(_, numbers: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
        parts = [C.unpack(p) for p in payloads]
        sizes = [len(p[0]) for p in parts]
        values = np.concatenate([C.ungaps(p[0]) for p in parts])
        flag = lambda k: np.concatenate([C.unpack_flags(p[k], n) for p, n in zip(parts, sizes)])
        order, runs, run = _distinct(values)
        is_block = np.logical_or.reduceat(flag(1)[order], runs)
        several = np.logical_or.reduceat(flag(2)[order], runs) | (np.diff(np.append(runs, len(order))) > 1)
        hit = np.empty(len(order), dtype=bool)
        hit[order] = (is_block & several)[run]
        for number, own in zip(numbers, np.split(hit, np.cumsum(sizes)[:-1])):
            yield number, C.pack(C.pack_flags(own))

    anchored = cut(C.answered(C.chunk_map(chunks, False, probe, C.MESSAGE), meet), "anchors")

    def windows_of(chunk: C.Chunk, row: dict) -> _Windows:
        anchors = _Anchors(chunk, block, bits)
        hit = _gather(row["anchors"], by_value(anchors), len(anchors.values))
        return _Windows(chunk, anchors.hit_places(hit), window, block)

    top = np.uint64(64 - (buckets.bit_length() - 1))

    def by_key(found: _Windows):
        return C.split_sorted((found.key >> top).astype(np.int64) if buckets > 1 else np.zeros(len(found.key), np.int64), buckets)

    def ask(chunk: C.Chunk, row: dict) -> Iterator[pa.RecordBatch]:
        found = windows_of(chunk, row)
        yield C.messages(chunk.number, ((bucket, C.pack(C.gaps(found.key[part]), found.check[part], found.low[part]))
                                        for bucket, part in by_key(found)))

    def smallest(_, numbers: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
        parts = [C.unpack(p) for p in payloads]
        key = np.concatenate([C.ungaps(p[0]) for p in parts])
        check = np.concatenate([p[1].astype(np.uint64) for p in parts])
        low = np.concatenate([p[2].astype(np.int64) for p in parts])
        order = np.lexsort((check, key))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
        least = np.minimum.reduceat(low[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        earlier = np.empty(len(order), dtype=bool)
        earlier[order] = least < low[order]
        for number, own in zip(numbers, np.split(earlier, np.cumsum([len(p[0]) for p in parts])[:-1])):
            yield number, C.pack(C.pack_flags(own))

    asked = C.chunk_map(C.with_answers(chunks, anchors=anchored), False, ask, C.MESSAGE)
    judged = cut(C.answered(asked, smallest), "windows")
    names = [id_col, "n_words", "n_removed", "kept_sha256"] + ["text"] * texts

    def finish(chunk: C.Chunk, row: dict) -> Iterator[pa.RecordBatch]:
        found = windows_of(chunk, row)
        earlier = _gather(row["windows"], by_key(found), len(found.key))
        gone = covered(len(chunk.tokens), found.repeated(earlier), window)
        words, kept = chunk.words(), []
        for low, high in zip(chunk.first[:-1].tolist(), chunk.first[1:].tolist()):
            here = chunk.tokens[low:high][~gone[low:high]].tolist()
            kept.append(b" ".join([words[t] for t in here]))
        removed = np.add.reduceat(np.append(gone, False), chunk.first[:-1], dtype=np.int64) * (np.diff(chunk.first) > 0)
        yield pa.record_batch(
            [pa.array(chunk.ids, mask=chunk.ids == C.NO_ID), pa.array(np.diff(chunk.first)), pa.array(removed),
             pa.array([hashlib.sha256(k).hexdigest() for k in kept])] + [pa.array(kept, pa.binary()).cast(pa.string())] * texts,
            names=names)

    return C.chunk_map(C.with_answers(chunks, anchors=anchored, windows=judged), False, finish,
                       f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", text string" * texts)
