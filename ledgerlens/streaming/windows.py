"""The ten window features kept as keyed state, in blocks of events in arrival order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlens.functions.scalar import epoch_micros
from ledgerlens.streaming import bundles

# Kind, id column, counted column, seconds kept.
KINDS = (
    ("user", "payer_id", "payee_id", 3600),
    ("device", "device_id", "payer_id", 600),
    ("ip", "ip_id", "payer_id", 600),
    ("merchant", "merchant_id", "payer_id", 3600),
)
SPANS = {kind: seconds * 1_000_000 for kind, _, _, seconds in KINDS}
SHORT_SECONDS = 300
BLOCK = 512  # events of a queue that are read and written together
SMALL = 2  # blocks of a queue that is read whole
# The next three are fixed as long as a checkpoint lives.
BUCKETS = 256  # groups of the entities of a kind
SHELVES = 16  # values of state that hold the short queues of a bucket
PAGES = 1024  # values of state that hold the counts of a long queue
PAIRS = 1 << 20  # (event, queue entry) pairs looked at together
MISSING_SHARDS = 4  # how many ways events without an id are split; raise with their share

_OUT = ("kind string, partition int, offset bigint, part int, n bigint, total double, others bigint, "
        "n_short bigint, total_short double, event_json string")
_EMPTY = ([], [], [])
_FIGURES = ("n", "total", "others", "n_short", "total_short")


def _trims(us: np.ndarray, at: int, limit: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far the head of the queue has moved after each event.

    ``us`` are times in queue order, ``at`` is the head before the batch, ``limit`` the oldest time
    each event lets stay, ``high`` the tail at that moment. The head leaves while it is too old; it
    stops at the first entry that is not, which is where the running maximum gets there.
    """
    low = np.empty(len(limit), dtype=np.int64)
    begin = 0
    while begin < len(limit):
        top = np.maximum.accumulate(us[at:])
        found = at + np.searchsorted(top, np.maximum.accumulate(limit[begin:]), side="left")
        empty = np.flatnonzero(found > high[begin:])  # an event that is not stored empties the queue
        end = begin + int(empty[0]) + 1 if len(empty) else len(limit)
        low[begin:end] = np.minimum(found[:end - begin], high[begin:end])
        begin, at = end, int(low[end - 1])
    return low


def _distinct(start: dict[str, int], before: int, added: list, add_at: np.ndarray, gone: list, gone_at: np.ndarray,
              events: int) -> tuple[np.ndarray, dict[str, int]]:
    """Distinct values after each event, and the new counts of the values that were touched.

    ``start`` has the counts of all touched values. Event i first adds, then the head leaves.
    """
    values = added + gone
    held = np.array([bool(v) for v in values], dtype=bool)
    when = np.concatenate([2 * add_at, 2 * gone_at + 1])[held]
    delta = np.repeat([1, -1], [len(added), len(gone)])[held]
    names: dict[str, int] = {}
    codes = np.array([names.setdefault(v, len(names)) for v in values if v], dtype=np.int64)
    if not len(codes):
        return np.full(events, before), {}
    names = list(names)
    order = np.lexsort((when, codes))
    code, step = codes[order], delta[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    run = np.cumsum(step)
    base = np.array([start.get(n, 0) for n in names], dtype=np.int64)
    run += np.repeat(base[code[first]] - (run[first] - step[first]), np.diff(np.append(first, len(code))))
    turn = ((run == 1) & (step == 1)).astype(np.int64) - ((run == 0) & (step == -1))
    times = np.sort(when)
    total = np.concatenate([[0], np.cumsum(turn[np.argsort(when[order], kind="stable")])])
    last = run[np.append(first[1:], len(code)) - 1]
    return (before + total[np.searchsorted(times, 2 * np.arange(events) + 1, side="right")],
            dict(zip([names[c] for c in code[first].tolist()], last.tolist())))


def _page(value: str) -> int:
    return crc32(value.encode()) % PAGES


def _shelf(entity: str) -> int:
    return crc32(entity.encode()) % SHELVES


def _recent(us, amount, place, low, high, limit) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of queue entries (at ``place`` in ascending order) not older than each limit."""
    sums = np.concatenate([[0.0], np.cumsum(amount)])
    stop = np.searchsorted(place, high)
    if np.all(us[1:] >= us[:-1]):
        begin = np.maximum(np.searchsorted(us, limit), np.searchsorted(place, low))
        begin = np.minimum(begin, stop)
        return stop - begin, sums[stop] - sums[begin]
    n, total = np.zeros(len(low), dtype=np.int64), np.zeros(len(low))
    for i in range(0, len(low), 256):  # late entries lie anywhere in the queue
        part = slice(i, i + 256)
        some = np.flatnonzero(us >= limit[part].min())
        inside = ((us[some] >= limit[part, None]) & (place[some] >= low[part, None]) & (place[some] < high[part, None]))
        n[part], total[part] = inside.sum(axis=1), inside @ amount[some]
    return n, total


def _sums(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of the stretches from ``low`` up to ``high``, none of them empty."""
    return np.add.reduceat(np.append(values, 0.0), np.column_stack([low, high]).ravel())[::2]


def _recent_of_many(us: np.ndarray, amount: np.ndarray, low: np.ndarray, high: np.ndarray,
                    limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the entries from ``low`` up to ``high`` that are not older than each limit."""
    n, total = np.zeros(len(low), dtype=np.int64), np.zeros(len(low))
    pairs = np.cumsum(high - low)
    begin = 0
    while begin < len(low):
        done = pairs[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(pairs, done + PAIRS, side="right")))
        sizes = (high - low)[begin:end]
        event = np.repeat(np.arange(end - begin), sizes)
        place = np.arange(len(event)) + np.repeat(low[begin:end] - np.cumsum(sizes) + sizes, sizes)
        inside = us[place] >= limit[begin:end][event]
        event, place = event[inside], place[inside]
        n[begin:end] = np.bincount(event, minlength=end - begin)
        total[begin:end] = np.bincount(event, weights=amount[place], minlength=end - begin)
        begin = end
    return n, total


def _queues(held: np.ndarray, sizes: np.ndarray, us: np.ndarray, amount: np.ndarray, other: np.ndarray,
            span: int, short_too: bool) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Figures after each event of many entities that store all their events, and where their queues begin.

    The queues lie one after another, each with its ``held`` entries from before and then its events in
    order of arrival; ``sizes`` counts both. ``other`` are numbers of values, -1 for none.
    """
    entities, ends = np.arange(len(sizes)), np.cumsum(sizes)
    owner = np.repeat(entities, sizes)
    rank = np.arange(len(us)) - np.repeat(ends - sizes, sizes)
    event_at = np.flatnonzero(rank >= held[owner])  # places of the events
    mine, now, high = owner[event_at], us[event_at], event_at + 1

    # Times are replaced by their ranks, raised from entity to entity: one running maximum serves all.
    times, level = np.unique(np.concatenate([us, now - span]), return_inverse=True)
    step = len(times)
    top = np.maximum.accumulate(level[:len(us)] + owner * step)
    low = np.searchsorted(top, np.maximum.accumulate(level[len(us):] + mine * step), side="left")

    # An entry counts as a distinct value from when it is there, and its last like has left, until it leaves.
    order = np.lexsort([owner, other])
    like = (np.diff(owner[order]) == 0) & (np.diff(other[order]) == 0)
    last = np.full(len(us), -1, dtype=np.int64)
    last[order[1:][like]] = order[:-1][like]
    until = np.searchsorted(low, np.arange(len(us)), side="right")
    since = np.maximum(np.searchsorted(event_at, np.arange(len(us))), np.searchsorted(low, last, side="right"))
    counts = (other >= 0) & (since < until)
    turns = (np.bincount(since[counts], minlength=len(now) + 1) - np.bincount(until[counts], minlength=len(now) + 1))
    out = {"n": high - low, "total": _sums(amount, low, high), "others": np.cumsum(turns)[:-1],
           "n_short": np.zeros(len(now), dtype=np.int64), "total_short": np.zeros(len(now))}
    if short_too:
        out["n_short"], out["total_short"] = _recent_of_many(us, amount, low, high, now - SHORT_SECONDS * 1_000_000)
    return out, low[np.cumsum(sizes - held) - 1]


class _Windows(StatefulProcessor):
    """Recent events of the entities of one bucket (or of one shard of the events without an id).

    Many entities come in one call. Those whose queue and events fit into one block are taken
    together, with all figures at once; their queues lie on ``SHELVES`` shelves, so the requests to
    the state do not grow with the entities. An entity with more than that is taken by itself from
    then on.

    As in a queue, an event joins at the tail and the head leaves while it is older than the span;
    so a late event sees what the queue holds at its arrival. The queue is kept in blocks of
    ``BLOCK`` events, each with its count, sum, and oldest and newest time. A batch reads the blocks
    that its events trim, those that reach into the short window, and the last one, and writes what
    has changed; the blocks between are known by their figures. The last block lies with the figures,
    so a queue of few events costs one read and one write a batch. A queue of more than ``SMALL``
    blocks keeps how often each value occurs in it, in ``PAGES`` pages, and only pages of values that come or go
    are looked up.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shelves = handle.getMapState("shelves", "shelf int", "entity array<string>, size array<int>, "
                                          "us array<long>, amount array<double>, other array<string>")
        self.blocks = handle.getMapState("blocks", "entity string, block long",
                                         "us array<long>, amount array<double>, other array<string>")
        self.seen = handle.getMapState("seen", "entity string, page int", "other array<string>, n array<long>")
        self.about = handle.getMapState("about", "entity string",
                                        "first long, off long, others long, counted boolean, n array<long>, "
                                        "total array<double>, oldest array<long>, newest array<long>, "
                                        "us array<long>, amount array<double>, other array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = bundles.read(rows)
        named = batch["entity"].combine_chunks().dictionary_encode()
        code, entities = named.indices.to_numpy(), named.dictionary.to_pylist()
        order = np.lexsort([*(batch[c].to_numpy() for c in ("offset", "partition", "arrived")), code])
        us, amount, own, other = (batch[c].to_numpy()[order].astype(dtype, copy=False) for c, dtype in (
            ("us", np.int64), ("amount", float), ("own", bool), ("other", object)))
        span = SPANS[key[0]]
        ends = np.cumsum(np.bincount(code, minlength=len(entities)))
        short_too = key[0] == "user"

        figures = {c: np.empty(len(batch), dtype=float if c.startswith("total") else np.int64) for c in _FIGURES}
        shelves = {i: self._taken(i) for i in sorted({_shelf(e) for e in entities if e})}
        short = []
        for entity, begin, end in zip(entities, [0, *ends[:-1].tolist()], ends.tolist()):
            of, about = slice(begin, end), None
            if entity:
                shelf = shelves[_shelf(entity)]
                queue = shelf.get(entity, _EMPTY)
                if queue and len(queue[0]) + end - begin <= BLOCK:
                    short.append((entity, begin, end, queue))
                    continue
                if queue is None:
                    about = self.about.getValue((entity,))
                elif queue[0]:
                    about = (0, 0, 0, False, [len(queue[0])], [float(sum(queue[1]))], [min(queue[0])], [max(queue[0])], *queue)
                shelf[entity] = None
            elif self.about.containsKey((entity,)):
                about = self.about.getValue((entity,))
            got = self._figures(entity, about, us[of], amount[of], other[of], own[of], span, short_too)
            for c, values in got.items():
                figures[c][of] = values
        if short:
            self._together(short, us, amount, other, span, short_too, figures, shelves)
        for i, queues in shelves.items():
            self._put(i, queues)
        out = batch.select(["partition", "offset", "event_json"])
        for c, values in figures.items():
            placed = np.empty_like(values)
            placed[order] = values
            out = out.append_column(c, pa.array(placed))
        out = out.append_column("kind", pa.repeat(pa.scalar(key[0]), len(out)))
        yield from bundles.written(out.append_column("part", pa.repeat(pa.scalar(max(-1 - key[1], 0), pa.int32()), len(out))))

    def _taken(self, i: int) -> dict[str, tuple[list, list, list] | None]:
        """The queues on a shelf; None for an entity that is not on it any more, but by itself."""
        if not self.shelves.containsKey((i,)):
            return {}
        entities, sizes, *columns = self.shelves.getValue((i,))
        queues, at = {}, 0
        for entity, n in zip(entities, sizes):
            queues[entity] = tuple(c[at:at + n] for c in columns) if n else None
            at += n
        return queues

    def _put(self, i: int, queues: dict[str, tuple[list, list, list] | None]) -> None:
        columns = ([x for q in queues.values() if q for x in q[c]] for c in range(3))
        self.shelves.updateValue((i,), (list(queues), [len(q[0]) if q else 0 for q in queues.values()], *columns))

    def _together(self, short, us, amount, other, span, short_too, figures, shelves) -> None:
        """Figures and queues of the entities that need one block each."""
        held = np.array([len(q[0]) for *_, q in short], dtype=np.int64)
        events = np.array([e - b for _, b, e, _ in short], dtype=np.int64)
        sizes = held + events
        ends = np.cumsum(sizes)
        new = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) >= np.repeat(held, sizes)
        at = np.concatenate([np.arange(b, e) for _, b, e, _ in short])

        def joined(column: int, now: np.ndarray) -> np.ndarray:
            out = np.empty(len(new), dtype=now.dtype)
            out[new] = now[at]
            out[~new] = [x for *_, q in short for x in q[column]]
            return out

        us, amount, other = joined(0, us), joined(1, amount), joined(2, other)
        codes, _ = pd.factorize(np.array([o or None for o in other], dtype=object))
        got, low = _queues(held, sizes, us, amount, codes, span, short_too)
        for c, values in got.items():
            figures[c][at] = values
        us, amount, other = us.tolist(), amount.tolist(), other.tolist()
        for (entity, *_), b, e in zip(short, low.tolist(), ends.tolist()):
            shelves[_shelf(entity)][entity] = us[b:e], amount[b:e], other[b:e]

    def _figures(self, entity, about, now, amount, other, mine, span, short_too: bool) -> dict:
        """Figures and state of one entity of many events, or of one that does not store them all."""
        first, off, others, counted, sizes, totals, oldest, newest, *tail = about or (0, 0, 0, False, *[[]] * 7)
        sizes, totals, oldest, newest = (np.array(x, dtype=t) for x, t in (
            (sizes, np.int64), (totals, float), (oldest, np.int64), (newest, np.int64)))
        blocks = len(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        kept = int(starts[-1])

        limit, short = now - span, now - SHORT_SECONDS * 1_000_000
        new_us, new_amount = now[mine], amount[mine]
        new_other = [o if isinstance(o, str) else None for o in other[mine].tolist()]
        high = kept + np.cumsum(mine)

        trimmed = int(np.searchsorted(np.maximum.accumulate(newest), limit.max())) + 1 if blocks else 0
        wanted = set(range(min(trimmed, blocks))) | ({blocks - 1} if blocks else set())
        if not counted:
            wanted = set(range(blocks))
        if short_too:
            wanted |= set(np.flatnonzero(newest >= short.min()).tolist())
        read = {j: self.blocks.getValue((entity, first + j)) if j < blocks - 1 else tail for j in sorted(wanted)}
        place = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in read] + [np.arange(kept, kept + len(new_us))]).astype(np.int64)
        us = np.concatenate([np.array(b[0], dtype=np.int64) for b in read.values()] + [new_us])
        amount = np.concatenate([np.array(b[1], dtype=float) for b in read.values()] + [new_amount])
        other = [o for b in read.values() for o in b[2]] + new_other

        # The head stays inside the first blocks read, or all are read and the new events follow.
        reach = int(starts[trimmed]) if trimmed < blocks else kept + len(new_us)
        low = _trims(us[:reach], off, limit, high)
        head_sums = np.concatenate([[0.0], np.cumsum(amount[:reach])])
        new_sums = float(totals.sum()) + np.concatenate([[0.0], np.cumsum(new_amount)])
        total = new_sums[high - kept] - head_sums[low]

        moved = np.diff(low, prepend=off)
        gone = other[off:int(low[-1])]
        pages = {}
        if counted:
            values = {v for v in [*gone, *new_other] if v}
            pages = self._pages(entity, values)
            start = {v: pages[_page(v)].get(v, 0) for v in values}
        else:
            start = Counter(o for o in other[off:kept] if o)
            others = len(start)
        distinct, touched = _distinct(start, others, new_other, np.flatnonzero(mine), gone,
                                      np.repeat(np.arange(len(now)), moved), len(now))
        out = {"n": high - low, "total": total, "others": distinct, "n_short": 0, "total_short": 0.0}
        if short_too:
            out["n_short"], out["total_short"] = _recent(us, amount, place, low, high, short)

        self._store(entity, first, starts, sizes, totals, oldest, newest, read, int(low[-1]), new_us, new_amount, new_other,
                    int(distinct[-1]), counted, pages, start, touched)
        return out

    def _store(self, entity, first, starts, sizes, totals, oldest, newest, read, low, us, amount, other, others, counted, pages, start, touched):
        """Drop the blocks that the head has left, append the new events, and note the figures."""
        blocks, kept = len(sizes), int(starts[-1])
        if low >= kept + len(us):
            if blocks:
                self.about.removeKey((entity,))
            for j in range(blocks - 1):
                self.blocks.removeKey((entity, first + j))
            self._keep(entity, pages, touched)  # all values have left, so all were touched
            return
        dropped = min(int(np.searchsorted(starts[1:], low, side="right")), blocks)
        for j in range(min(dropped, blocks - 1)):
            self.blocks.removeKey((entity, first + j))
        us, amount = us.tolist(), amount.tolist()
        if dropped == blocks:  # what is left of the batch begins a queue of its own
            us, amount, other = us[low - kept:], amount[low - kept:], other[low - kept:]
            low, at = 0, first + blocks
        else:
            low, at = low - int(starts[dropped]), first + blocks - 1
            tail = read[blocks - 1]
            us, amount, other = [*tail[0], *us], [*tail[1], *amount], [*tail[2], *other]
        figures = [x[dropped:max(dropped, blocks - 1)].tolist() for x in (sizes, totals, oldest, newest)]
        for i in range(0, len(us), BLOCK):  # the last block stays with the figures
            part = us[i:i + BLOCK], amount[i:i + BLOCK], other[i:i + BLOCK]
            for f, value in zip(figures, (len(part[0]), float(sum(part[1])), min(part[0]), max(part[0]))):
                f.append(value)
            if i + BLOCK < len(us):
                self.blocks.updateValue((entity, at + i // BLOCK), part)
        if counted:
            self._keep(entity, pages, touched)
        elif len(figures[0]) > SMALL:
            counted = True
            self._keep(entity, {}, {**start, **touched})
        self.about.updateValue((entity,), (first + dropped, low, others, counted, *figures, *part))

    def _pages(self, entity: str, values: Iterable[str]) -> dict[int, dict[str, int]]:
        """The pages that hold the counts of these values."""
        pages = {}
        for page in {_page(v) for v in values}:
            held = self.seen.containsKey((entity, page))
            pages[page] = dict(zip(*self.seen.getValue((entity, page)))) if held else {}
        return pages

    def _keep(self, entity: str, pages: dict[int, dict[str, int]], counts: dict[str, int]) -> None:
        """Write the pages of these values with their new counts; a page without values goes."""
        held = {page for page, values in pages.items() if values}
        for value, n in counts.items():
            pages.setdefault(_page(value), {})[value] = n
        for page in {_page(v) for v in counts}:
            left = {v: n for v, n in pages[page].items() if n}
            if left:
                self.seen.updateValue((entity, page), (list(left), list(left.values())))
            elif page in held:
                self.seen.removeKey((entity, page))

    def close(self) -> None:
        pass


def window_state(events: DataFrame, missing_shards: int = MISSING_SHARDS) -> DataFrame:
    """Partial features per (event, kind, part); put together with ``join_back`` per micro-batch.

    Needs ``arrived``, ``partition`` and ``offset``: events of a micro-batch are taken in order
    of arrival, across partitions by arrival time.

    Events without an id form one group, which may be a large part of the stream. It is split by
    the counted value: every event asks all parts and is stored in one, and the parts' counts,
    sums and distinct counts add up.
    """
    def entry(kind: str, id_col: str, other: str) -> Column:
        entity = F.coalesce(F.col(id_col), F.lit(""))
        home = F.pmod(F.xxhash64(other), F.lit(missing_shards)).cast("int")
        parts = F.when(entity == "", F.sequence(F.lit(0), F.lit(missing_shards - 1))).otherwise(
            F.array(F.lit(0)))
        return F.transform(parts, lambda p: F.struct(
            F.lit(kind).alias("kind"), entity.alias("entity"),
            F.when(entity == "", -1 - p).otherwise(F.pmod(F.xxhash64(entity), F.lit(BUCKETS)).cast("int")).alias("bucket"),
            ((entity != "") | (p == home)).alias("own"),
            F.when((entity != "") | (p == home), F.col(other)).alias("other"),
            F.when((p == 0) & F.lit(kind == "user"), F.to_json(F.struct(*events.columns)))
            .alias("event_json")))

    every = F.flatten(F.array(*[entry(*k[:3]) for k in KINDS]))
    rows = events.withColumn("_k", F.explode(every)).select(
        F.col("_k.*"), "partition", "offset", epoch_micros("arrived").alias("arrived"),
        epoch_micros("timestamp").alias("us"), F.coalesce("amount", F.lit(0.0)).alias("amount"))
    out = bundles.bundled(rows, "kind", "bucket").groupBy("kind", "bucket").transformWithStateInPandas(
        statefulProcessor=_Windows(), outputStructType="rows binary", outputMode="Append", timeMode="None")
    return bundles.opened(out, T._parse_datatype_string(_OUT))


def join_back(partials: DataFrame, event_schema: T.StructType) -> DataFrame:
    """One row per message of a micro-batch with its ``window_features`` struct.

    Messages are told apart by partition and offset; the same event may come twice.
    """
    def add(kind: str, column: str, zero) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(column))), F.lit(zero))

    features = F.struct(
        add("user", "n_short", 0).alias("user_txn_count_5min"),
        add("user", "total_short", 0.0).alias("user_amount_sum_5min"),
        add("user", "n", 0).alias("user_txn_count_1h"),
        add("user", "total", 0.0).alias("user_amount_sum_1h"),
        add("user", "others", 0).alias("user_unique_payee_count_1h"),
        add("device", "others", 0).alias("device_unique_user_count_10min"),
        add("ip", "others", 0).alias("ip_unique_user_count_10min"),
        add("merchant", "n", 0).alias("merchant_txn_count_1h"),
        add("merchant", "total", 0.0).alias("merchant_amount_sum_1h"),
        add("merchant", "others", 0).alias("merchant_unique_user_count_1h"))
    rows = partials.repartition("partition", "offset").groupBy("partition", "offset").agg(
        features.alias("window_features"), F.max("event_json").alias("_json"))
    return rows.select(F.from_json("_json", event_schema).alias("_e"), "window_features").select(
        "_e.*", "window_features")
