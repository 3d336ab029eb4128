"""Removal of byte strings that occur twice, by suffix arrays built from Lyndon groups.

Equal strings of ``length`` bytes are brought together first. Some positions of a text, chosen by a
hash of the bytes there, are anchors; chunks ask hashed buckets which anchors occur again, and a
string that holds an anchor which does not is no repeat. What is left is cut into pieces: runs of
strings that have the same smallest anchor, where anchors that are rare in the corpus count as
smaller than frequent ones. Equal strings have the same smallest anchor, so all their pieces meet in
one bucket; equal pieces are one entry there, however many copies the corpus holds.

Different pieces of one anchor are sorted together. ``suffix_order`` groups suffixes by their
longest Lyndon prefix: groups are taken in descending order, each suffix points to the nearest
earlier suffix of a smaller group, and what is pointed to moves up to a group whose prefix is longer
by that of the group at hand. One scan then emits the order inside the groups. Nothing is renamed
and no text is sorted twice. Neighbours in this order that agree in ``length`` bytes are repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import chunks as C
from ledgerlens.llm.tables import arrow_map, cut, slices
from ledgerlens.llm.words import covered, mix, text_bytes

LENGTH = 200
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
SPARSE = 4  # one position in 2^4 is an anchor
FREQUENT = 1000  # anchors with more occurrences come last; changes which pieces meet, not what is found
_FACTOR = np.uint64(0xA24BAED4963EE407)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _FACTOR)
NONE, ALL, SOME = 0, 1, 2


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The group of each suffix, the groups in ascending order, and the pointers to the nearest
    earlier suffix of a smaller group (-1: none). ``text`` ends in a number smaller than all others."""
    n = len(text)
    by_value: dict[int, list[int]] = {}
    for i, b in enumerate(text):
        by_value.setdefault(b, []).append(i)
    members = [by_value[b] for b in sorted(by_value)]
    size = [len(m) for m in members]
    below = list(range(-1, len(members) - 1))  # the next smaller group
    above = list(range(1, len(members))) + [-1]
    number = {b: g for g, b in enumerate(sorted(by_value))}
    group = [number[b] for b in text]
    pointer, done = [-1] * n, bytearray(n + 1)  # done[-1] stays 0, so a search ends before the text
    at = len(members) - 1
    while at >= 0:
        own = [s for s in members[at] if group[s] == at]
        for s in own:
            done[s] = 1
        times: dict[int, int] = {}
        for s in own:
            p = s - 1
            while done[p]:
                p = pointer[p]
            pointer[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if len(times) == 1:
            (p, _), = times.items()
            moves = [(0, group[p], [p])] if size[group[p]] > 1 else []
        else:
            sets: dict[tuple[int, int], list[int]] = {}
            for p in sorted(times):
                sets.setdefault((-times[p], group[p]), []).append(p)
            moves = [(t, g, sets[t, g]) for t, g in sorted(sets)]
        for _, g, moved in moves:  # often pointed to first: each new group comes right above the old
            if len(moved) == size[g]:
                continue
            new = len(members)
            members.append(moved)
            size.append(len(moved))
            size[g] -= len(moved)
            for p in moved:
                group[p] = new
            top = above[g]
            above[g], below[top] = new, new
            above.append(top)
            below.append(g)
        at = below[at]
    order, at = [], group[n - 1]
    while at >= 0:
        order.append(at)
        at = above[at]
    return group, order, pointer


def suffix_order(text: list[int]) -> list[int]:
    """The suffix array of ``text``, which ends in a number smaller than all others."""
    group, order, pointer = lyndon_groups(text)
    size = [0] * (max(order) + 1)
    for g in group:
        size[g] += 1
    place, total = [0] * len(size), 0
    for g in order:
        place[g] = total
        total += size[g]
    out = [0] * len(text)
    out[0] = len(text) - 1
    put = bytearray(len(text) + 1)
    put[-1] = put[len(text) - 1] = 1  # a chain ends before the text
    for at in range(len(text)):
        s = out[at] - 1
        while not put[s]:  # suffixes whose Lyndon prefix ends where the emitted one begins
            put[s] = 1
            g = group[s]
            out[place[g]] = s
            place[g] += 1
            s = pointer[s]
    return out


def repeats_among(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, which of its starts begin a string that begins elsewhere in the pieces too."""
    joined = b"\xff".join(pieces)
    symbols = np.append(np.frombuffer(joined, np.uint8).astype(np.int16) + 2, 0)
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    symbols[ends[:-1]] = 1  # pieces end in a number smaller than all bytes, the last one in a smaller one
    begins = np.zeros(len(symbols), dtype=bool)
    for a, b in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist()):
        begins[a:b - length + 1] = True
    order = np.array(suffix_order(symbols.tolist()))
    order = order[begins[order]].tolist()  # equal strings stay neighbours: what lies between them begins alike
    again = np.zeros(len(symbols), dtype=bool)
    last = b""
    for x, y in zip([0, *order], order):
        here = joined[y:y + length]
        if here == last:
            again[x] = again[y] = True
        last = here
    return [again[b - len(p):b - length + 1] for p, b in zip(pieces, ends.tolist())]


@dataclass
class _Chunk:
    """Texts of a chunk: the bytes of document i are ``data[first[i]:first[i + 1]]``."""

    ids: np.ndarray
    first: np.ndarray
    data: np.ndarray

    @classmethod
    def read(cls, body: bytes) -> _Chunk:
        ids, sizes, data = C.unpack(body)
        return cls(ids.astype(np.int64), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), data.astype(np.uint8))


def _grams(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes (a power of two) from each position that has so many."""
    grams, n = _BYTE[data], 1
    while n < width:
        size = max(0, len(grams) - n)
        grams = mix(grams[:size] * _FACTOR + grams[n:n + size])
        n *= 2
    return grams


class _Anchors:
    """Anchors of one chunk: their places and the distinct truncated hashes."""

    def __init__(self, chunk: _Chunk, width: int, bits: int):
        self.grams = _grams(chunk.data, width)
        inside = np.ones(len(self.grams), dtype=bool)
        for end in chunk.first[1:].tolist():
            inside[max(0, end - width + 1):end] = False
        self.place = np.flatnonzero((self.grams >> np.uint64(64 - SPARSE) == 0) & inside)
        hashed = (self.grams[self.place] << np.uint64(SPARSE)) >> np.uint64(64 - bits)
        self.values, self.which, self.times = np.unique(hashed, return_inverse=True, return_counts=True)


def _slide_min(values: np.ndarray, span: int) -> np.ndarray:
    """The smallest of ``span`` values from each position that has so many."""
    n = 1
    while 2 * n <= span:
        values, n = np.minimum(values[:-n], values[n:]), 2 * n
    return np.minimum(values[:len(values) - (span - n)], values[span - n:]) if span > n else values


@dataclass
class _Pieces:
    """Strings of one chunk that may be repeats, in runs with the same smallest anchor.

    Piece j holds the starts ``start[j]`` to ``stop[j] - 1``; ``entry[j]`` is its number among the
    chunk's different pieces, which have a key, bytes, a count, and may hold a string twice.
    """

    start: np.ndarray
    stop: np.ndarray
    entry: np.ndarray
    key: np.ndarray
    raw: list[bytes]
    several: np.ndarray
    folded: np.ndarray


def _pieces(chunk: _Chunk, anchors: _Anchors, level: np.ndarray, length: int, width: int) -> _Pieces:
    """``level`` of each distinct anchor: 0 if it does not occur again, 1 if it does, 2 if often."""
    n = max(0, len(chunk.data) - length + 1)
    level = level[anchors.which]
    lone = np.zeros(len(chunk.data) + 1, dtype=np.int32)
    lone[anchors.place[level == 0] + 1] = 1
    lone = np.cumsum(lone, dtype=np.int32)
    may = lone[length - width + 1:length - width + 1 + n] == lone[:n]
    for end in chunk.first[1:].tolist():
        may[max(0, end - length + 1):end] = False
    none = _Pieces(*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64), [], np.zeros(0, bool), np.zeros(0, bool))
    if not may.any():
        return none
    rank = (anchors.grams >> np.uint64(2)) | np.uint64(3 << 62)  # places that are no anchors come last
    rank[anchors.place] = (anchors.grams[anchors.place] >> np.uint64(2)) | (level.astype(np.uint64) << np.uint64(62))
    least = _slide_min(rank, length - width + 1)[:n]
    change = np.ones(n, dtype=bool)
    change[1:] = (least[1:] != least[:-1]) | ~may[:-1]
    start = np.flatnonzero(change & may)
    breaks = np.append(np.flatnonzero(change | ~may), n)
    stop = breaks[np.searchsorted(breaks, start, side="right")]
    raw, seen, entry = chunk.data.tobytes(), {}, []
    for a, b in zip(start.tolist(), (stop + length - 1).tolist()):
        entry.append(seen.setdefault(raw[a:b], len(seen)))
    entry = np.array(entry)
    _, head, times = np.unique(entry, return_index=True, return_counts=True)
    key = least[start[head]]
    # a string comes twice inside a piece only if the piece's anchor does
    folded = np.array([int(np.count_nonzero(rank[a:b + length - width] == v)) > 1
                       for a, b, v in zip(start[head].tolist(), stop[head].tolist(), key)], dtype=bool)
    return _Pieces(start, stop, entry, key, list(seen), times > 1, folded)


def write_chunks(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(chunk, size, body): texts in chunks of some megabytes, or one text if that is longer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, part in enumerate(slices(batches, "text", CHUNK_BYTES)):
            data, bounds = text_bytes(part.column("text"))
            ids = part.column("id").fill_null(int(C.NO_ID)).to_numpy()
            yield pa.record_batch([pa.array([task << 32 | number]), pa.array([len(data)]),
                                   pa.array([C.pack(ids, np.diff(bounds), data)], pa.binary())], names=["chunk", "size", "body"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    return cut(arrow_map(chosen, run, "chunk bigint, size bigint, body binary"), "texts")


def _per_chunk(chunks: DataFrame, work: Callable[[int, _Chunk, dict], pa.RecordBatch], schema: str) -> DataFrame:
    """``work(number, chunk, answers)`` for every chunk; answers by column, then bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [c for c in batch.schema.names if c not in ("chunk", "size", "body")]
            for i in range(len(batch)):
                answers = {c: {a["bucket"]: a["answer"] for a in (batch.column(c)[i].as_py() or ())} for c in asked}
                yield work(batch.column("chunk")[i].as_py(), _Chunk.read(batch.column("body")[i].as_py()), answers)

    return arrow_map(chunks, run, schema)


def _levels(_, numbers: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """A bucket's answers about anchors: 0 for one that occurs once, 1 for more often, 2 for frequent."""
    parts = [C.unpack(p) for p in payloads]
    values, which = np.unique(np.concatenate([C.ungaps(p[0]) for p in parts]), return_inverse=True)
    times = np.bincount(which, np.concatenate([p[1].astype(np.float64) for p in parts]), len(values))
    level = ((times > 1).astype(np.uint8) + (times > FREQUENT))[which]
    for number, own in zip(numbers, np.split(level, np.cumsum([len(p[0]) for p in parts])[:-1])):
        yield number, C.pack(own)


def _sent(pieces: _Pieces, entries: np.ndarray) -> bytes:
    raw = [pieces.raw[e] for e in entries.tolist()]
    return C.pack(pieces.key[entries], np.array([len(r) for r in raw]), pieces.several[entries].astype(np.uint8),
                  pieces.folded[entries].astype(np.uint8), np.frombuffer(b"".join(raw), np.uint8))


def _judge(length: int) -> Callable[[int, list[int], list[bytes]], Iterator[tuple[int, bytes]]]:
    """A bucket's answers about pieces: none, all or some of their strings are repeats."""
    def answer(_, numbers: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
        groups: dict[int, dict[bytes, list]] = {}  # key, piece: [comes twice, holds its anchor twice, which starts]
        asked = []
        for payload in payloads:
            keys, sizes, several, folded, data = C.unpack(payload)
            ends, raw, own = np.cumsum(sizes, dtype=np.int64), data.tobytes(), []
            for key, a, b, s, f in zip(keys.tolist(), (ends - sizes).tolist(), ends.tolist(), several.tolist(), folded.tolist()):
                group, piece = groups.setdefault(key, {}), raw[a:b]
                if piece in group:
                    group[piece][0] = True
                else:
                    group[piece] = [bool(s), bool(f), None]
                own.append(group[piece])
            asked.append(own)
        for group in groups.values():
            if len(group) > 1 or any(f for _, f, _ in group.values()):
                for state, again in zip(group.values(), repeats_among(list(group), length)):
                    state[2] = again
        for number, own in zip(numbers, asked):
            code = np.array([ALL if twice or (some is not None and some.all()) else
                             NONE if some is None or not some.any() else SOME for twice, _, some in own], np.uint8)
            bits = [some for (_, _, some), c in zip(own, code.tolist()) if c == SOME]
            yield number, C.pack(code, C.pack_flags(np.concatenate(bits)) if bits else np.zeros(0, np.uint8))

    return answer


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, spans, kept) for every row of ``docs``.

    Texts are taken as UTF-8. A byte is removed if a string of ``length`` bytes that covers it also
    begins at another place of this or another row; strings lie inside one row and are judged on the
    input. ``spans`` holds (start, length) of the maximal removed runs, ``kept`` the other bytes,
    which may end inside a character.

    Ids must be whole numbers or null, and may repeat: rows are told apart by their place. Equal rows
    remove each other whole if they are long enough. Null texts count as empty; empty and short texts
    lose nothing. Very long texts are read whole, by one task each. An empty table gives an empty
    one. Other columns are not read.
    """
    width = 1 << max(0, (length // 4).bit_length() - 1)
    chunks = write_chunks(docs, id_col, text)
    size = chunks.agg(F.sum("size")).first()[0] or 0
    expected = size >> SPARSE
    buckets = C.bucket_count(expected)
    bits = min(64 - SPARSE, max(32, expected.bit_length() + 6))  # enough that few anchors meet by chance
    shift = np.uint64(bits - (buckets.bit_length() - 1))
    homes = 1 << max(0, size // BUCKET_BYTES).bit_length()
    home_shift = np.uint64(64 - (homes.bit_length() - 1))

    def by_value(anchors: _Anchors) -> Iterator[tuple[int, slice]]:
        return C.split_sorted((anchors.values >> shift).astype(np.int64), buckets)

    def probe(number: int, chunk: _Chunk, _) -> pa.RecordBatch:
        anchors = _Anchors(chunk, width, bits)
        return C.messages(number, [(b, C.pack(C.gaps(anchors.values[part]), anchors.times[part])) for b, part in by_value(anchors)])

    levels = cut(C.answered(_per_chunk(chunks.select("chunk", "body"), probe, C.MESSAGE), _levels), "anchors")

    def pieces_of(chunk: _Chunk, answers: dict) -> _Pieces:
        anchors = _Anchors(chunk, width, bits)
        level = np.zeros(len(anchors.values), dtype=np.uint8)
        for b, part in by_value(anchors):
            level[part] = C.unpack(answers["levels"][b])[0]
        return _pieces(chunk, anchors, level, length, width)

    def by_home(pieces: _Pieces) -> Iterator[tuple[int, np.ndarray]]:
        home = (mix(pieces.key) >> home_shift).astype(np.int64) if homes > 1 else np.zeros(len(pieces.key), np.int64)
        order = np.argsort(home, kind="stable")
        return ((b, order[part]) for b, part in C.split_sorted(home[order], homes))

    def ask(number: int, chunk: _Chunk, answers: dict) -> pa.RecordBatch:
        pieces = pieces_of(chunk, answers)
        return C.messages(number, [(b, _sent(pieces, entries)) for b, entries in by_home(pieces)])

    leveled = C.with_answers(chunks.select("chunk", "body"), levels=levels)
    judged = cut(C.answered(_per_chunk(leveled, ask, C.MESSAGE), _judge(length)), "pieces")

    def finish(_, chunk: _Chunk, answers: dict) -> pa.RecordBatch:
        pieces = pieces_of(chunk, answers)
        code, some = np.zeros(len(pieces.raw), dtype=np.uint8), {}
        for b, entries in by_home(pieces):
            code[entries], flags = C.unpack(answers["judged"][b])
            mixed = [e for e in entries.tolist() if code[e] == SOME]
            sizes = [len(pieces.raw[e]) - length + 1 for e in mixed]
            some |= dict(zip(mixed, np.split(C.unpack_flags(flags, sum(sizes)), np.cumsum(sizes)[:-1])))
        whole = np.flatnonzero(code[pieces.entry] == ALL)
        starts, sizes = [pieces.start[whole]], [pieces.stop[whole] - pieces.start[whole] + length - 1]
        for j in np.flatnonzero(code[pieces.entry] == SOME).tolist():
            spots = np.flatnonzero(some[int(pieces.entry[j])]) + pieces.start[j]
            starts.append(spots)
            sizes.append(np.full(len(spots), length))
        gone = covered(len(chunk.data), np.concatenate(starts), np.concatenate(sizes))
        return _result(chunk, gone, id_col)

    answered = C.with_answers(leveled, judged=judged)
    return _per_chunk(answered, finish, f"`{id_col}` bigint, n_bytes bigint, spans array<struct<start:bigint,length:bigint>>, kept binary")


def _result(chunk: _Chunk, gone: np.ndarray, id_col: str) -> pa.RecordBatch:
    sizes = np.diff(chunk.first)
    edge = np.zeros(len(gone) + 1, dtype=bool)
    edge[chunk.first] = True
    head = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate(([False], gone[:-1]))))
    tail = np.flatnonzero(gone & (edge[1:] | ~np.concatenate((gone[1:], [False])))) + 1
    row = np.searchsorted(chunk.first, head, side="right") - 1
    spans = pa.StructArray.from_arrays([pa.array(head - chunk.first[row]), pa.array(tail - head)], ["start", "length"])
    kept = chunk.data[~gone].tobytes()
    left = np.concatenate(([0], np.cumsum(~gone, dtype=np.int64)))[chunk.first]
    return pa.record_batch(
        [pa.array(chunk.ids, mask=chunk.ids == C.NO_ID), pa.array(sizes),
         pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)), pa.int32()), spans),
         pa.array([kept[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist())], pa.binary())],
        names=[id_col, "n_bytes", "spans", "kept"])
