"""Frequent phrases by dynamic itemset counting, and collocations among them.

Texts are cut into pieces and words once and written as chunks dealt over a few shards. A step scans
one shard, in a cycle, and counts phrases of several lengths at once: words from step 0, and each
longer phrase from the step after both its subphrases (without its last word, without its first)
have reached the threshold, for one full cycle of the shards; then its count is exact and final. So
lengths are interleaved, and a length need not wait until the one before it is complete.

What has reached the threshold, and in which step, is known to the tasks through one byte array per
length, indexed by a hash of the phrase. Its size is bounded (``MOST_SLOTS``). Phrases that share a
slot are counted earlier than need be, but still for one full cycle, as a slot never changes once
set: collisions cost work, never a count.

Running counts live in hashed buckets as packed arrays. A chunk sends each bucket its distinct
phrases with their counts, so a frequent phrase is one entry per chunk. A phrase leaves its bucket
when its cycle ends; one that stayed under the threshold is forgotten. Phrases are told apart by 96
bits; a bucket remembers one chunk for each, which spells the frequent ones in the end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import chunks as C
from ledgerlens.llm.tables import arrow_map, cut, slices
from ledgerlens.llm.words import mix, rolling, span_hashes, window_starts, words_of
from ledgerlens.session import scratch_path

THRESHOLD, LONGEST, SHARDS = 30, 4, 4
CHUNK_BYTES = 8 << 20
MOST_SLOTS = 1 << 24  # bytes of the array of one length
NEVER = 255
RANGE_BITS = 16  # slots that one row brings to the driver, as bits

# Bytes that end a piece, and those that only part words.
ENDS = np.zeros(256, dtype=bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
INSIDE = ~ENDS
INSIDE[[0x20, 0x09]] = False

CHUNK = "chunk bigint, words bigint, sizes array<struct<lang:string,n:bigint>>, body binary, shard int"
MESSAGE = "k int, bucket int, fresh boolean, payload binary"
STEP = "k int, bucket int, rest binary, done binary, reached array<int>"


def _body(part: pa.RecordBatch) -> tuple[bytes, list[dict]]:
    """One chunk: word numbers, pieces, distinct words and languages of some texts; words by language."""
    words = words_of(part.column("text"), INSIDE, lower=True)
    ends = np.concatenate(([0], np.cumsum(ENDS[words.data], dtype=np.int64)))
    opens = np.ones(len(words.start), dtype=bool)
    opens[1:] = ends[words.start[1:]] > ends[words.end[:-1]]
    opens[words.first[:-1][np.diff(words.first) > 0]] = True
    heads = np.flatnonzero(opens)
    row = np.repeat(np.arange(len(part)), np.diff(words.first))
    coded = part.column("lang").dictionary_encode()
    code, langs = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    _, spot, token = np.unique(words.hash, return_index=True, return_inverse=True)
    vocabulary = b"".join([words.bytes_of(i) for i in spot.tolist()])
    sizes = np.bincount(code[row], minlength=len(langs)).tolist()
    return C.pack(token, np.diff(np.append(heads, len(row))), code[row[heads]], np.frombuffer(vocabulary, np.uint8),
                  (words.end - words.start)[spot], np.frombuffer(json.dumps(langs).encode(), np.uint8)), [
        {"lang": name, "n": n} for name, n in zip(langs, sizes) if n]


def write_shards(docs: DataFrame, text: str, lang: str, shards: int) -> DataFrame:
    """The chunks, written in one folder per shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, part in enumerate(slices(batches, "text", CHUNK_BYTES)):
            body, sizes = _body(part)
            yield pa.record_batch([pa.array([task << 32 | number]), pa.array([sum(s["n"] for s in sizes)], pa.int64()),
                                   pa.array([sizes], pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))),
                                   pa.array([body], pa.binary()), pa.array([(task + number) % shards], pa.int32())],
                                  names=["chunk", "words", "sizes", "body", "shard"])

    chosen = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    path = scratch_path(docs.sparkSession, "pieces")
    arrow_map(chosen, run, CHUNK).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(CHUNK).parquet(path)


@dataclass
class _Pieces:
    """A chunk read back: ``first`` bounds its pieces, ``hash`` is one per word and language."""

    first: np.ndarray
    token: np.ndarray
    code: np.ndarray
    hash: np.ndarray
    words: list[bytes]
    langs: list[str]

    @classmethod
    def read(cls, body: bytes) -> _Pieces:
        token, sizes, code, vocabulary, lengths, langs = C.unpack(body)
        ends = np.cumsum(lengths, dtype=np.int64)
        starts, raw = ends - lengths, vocabulary.tobytes()
        names = json.loads(langs.tobytes())
        name_bytes = [n.encode() for n in names]
        name_ends = np.cumsum([len(b) for b in name_bytes], dtype=np.int64)
        salt = span_hashes(np.frombuffer(b"".join(name_bytes), np.uint8), np.concatenate(([0], name_ends))[:-1], name_ends)
        code = np.repeat(code, sizes)
        spelled = span_hashes(vocabulary, starts, ends)
        return cls(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), token, code,
                   mix(spelled[token] + mix(salt + np.uint64(1))[code]),
                   [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())], names)

    def keys(self, k: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits that tell the phrases of ``k`` words from ``place`` apart: 64 and 32."""
        return rolling(self.hash, k)[place], rolling(mix(self.hash + np.uint64(1)), k)[place] >> np.uint64(32)

    def spelled(self, k: int, place: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Languages and texts of the phrases of ``k`` words from ``place``."""
        columns = [self.token[place + j].tolist() for j in range(k)]
        words = self.words
        phrases = [b" ".join([words[t] for t in row]) for row in zip(*columns)]
        langs = pa.DictionaryArray.from_arrays(pa.array(self.code[place].astype(np.int32)), pa.array(self.langs, pa.string()))
        return langs.cast(pa.string()), pa.array(phrases, pa.binary()).cast(pa.string())


def active(pieces: _Pieces, k: int, reach: np.ndarray, step: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of ``k`` words begin whose cycle covers ``step``, and the step it began."""
    if k == 1:
        return np.arange(len(pieces.hash)), np.zeros(len(pieces.hash), np.int64)
    shift = np.uint64(64 - (len(reach).bit_length() - 1))
    since = reach[(rolling(pieces.hash, k - 1) >> shift).astype(np.int64)].astype(np.int64)
    place = window_starts(pieces.first, k)
    start = np.maximum(since[place], since[place + 1]) + 1
    on = (start <= step) & (step < start + shards)
    return place[on], start[on]


@dataclass
class _Counts:
    """Phrases in ascending order of their key: counts, a chunk that has them, start of their cycle."""

    h: np.ndarray
    check: np.ndarray
    n: np.ndarray
    chunk: np.ndarray
    start: np.ndarray

    def pick(self, which: np.ndarray | slice) -> _Counts:
        return _Counts(self.h[which], self.check[which], self.n[which], self.chunk[which], self.start[which])

    def packed(self) -> bytes | None:
        return C.pack(C.gaps(self.h), self.check, self.n, self.chunk, self.start) if len(self.h) else None

    @classmethod
    def unpacked(cls, payloads: list[bytes]) -> _Counts:
        parts = [C.unpack(p) for p in payloads]
        columns = [np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(1, 5)]
        return cls(np.concatenate([C.ungaps(p[0]) for p in parts]), *columns)


def _heads(h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    return np.flatnonzero(new)


def _scan(pieces: DataFrame, lengths: list[int], step: int, shards: int, buckets: int, known) -> DataFrame:
    """What the chunks of a shard send: their phrases whose cycle covers ``step``, by bucket."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = known.value
        for batch in batches:
            for number, body in zip(batch.column("chunk").to_pylist(), batch.column("body")):
                chunk = _Pieces.read(body.as_py())
                for k in lengths:
                    yield send(chunk, number, k, *active(chunk, k, reach[k - 2], step, shards))

    def send(chunk: _Pieces, number: int, k: int, place: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        h, check = chunk.keys(k, place)
        order = np.argsort(h, kind="stable")
        h, check = h[order], check[order]
        heads = _heads(h, check)
        own = _Counts(h[heads], check[heads].astype(np.int64), np.diff(np.append(heads, len(h))),
                      np.full(len(heads), number), start[order][heads])
        owner = (own.h >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(heads), np.int64)
        sent = [(b, own.pick(part).packed()) for b, part in C.split_sorted(owner, buckets)]
        return pa.record_batch([pa.array([k] * len(sent), pa.int32()), pa.array([b for b, _ in sent], pa.int32()),
                                pa.array([True] * len(sent), pa.bool_()), pa.array([p for _, p in sent], pa.binary())],
                               names=["k", "bucket", "fresh", "payload"])

    return arrow_map(pieces.select("chunk", "body"), run, MESSAGE)


def _merged(sent: DataFrame, step: int, shards: int, threshold: int, longest: int, slots: int) -> DataFrame:
    """Each bucket after ``step``: phrases still being counted, those whose cycle ended at the
    threshold or above, and the slots of those that reached it in this step."""
    shift = np.uint64(64 - (slots.bit_length() - 1))

    def run(table: pa.Table) -> pa.Table:
        k = table.column("k")[0].as_py()
        payloads = table.column("payload").to_pylist()
        old = [p for p, fresh in zip(payloads, table.column("fresh").to_pylist()) if not fresh]
        every = _Counts.unpacked(old + [p for p, fresh in zip(payloads, table.column("fresh").to_pylist()) if fresh])
        carried = len(_Counts.unpacked(old).h) if old else 0
        order = np.lexsort((every.check, every.h))
        h, check = every.h[order], every.check[order]
        heads = _heads(h, check)
        before = every.n.copy()
        before[carried:] = 0
        before = np.add.reduceat(before[order], heads)
        all_ = _Counts(h[heads], check[heads], np.add.reduceat(every.n[order], heads),
                       np.minimum.reduceat(every.chunk[order], heads), every.start[order][heads])
        ended = all_.start + shards - 1 <= step
        reached = (before < threshold) & (all_.n >= threshold) & (k < longest)
        return pa.table([table.column("k")[:1], table.column("bucket")[:1],
                         pa.array([all_.pick(~ended).packed()], pa.binary()),
                         pa.array([all_.pick(ended & (all_.n >= threshold)).packed()], pa.binary()),
                         pa.array([np.unique(all_.h[reached] >> shift).astype(np.int32)], pa.list_(pa.int32()))],
                        names=["k", "bucket", "rest", "done", "reached"])

    return cut(sent.groupBy("k", "bucket").applyInArrow(run, STEP), f"counts{step}")


def _slots(words: int) -> int:
    return min(MOST_SLOTS, 1 << max(RANGE_BITS, (words // 16).bit_length()))


def _reached(merged: DataFrame) -> list:
    """(k, part, bits): the slots that reached the threshold, packed by tasks.

    At most one bit for each slot of a length comes to the driver, whatever the corpus.
    """
    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << RANGE_BITS, dtype=bool)
        bits[table.column("low").to_numpy()] = True
        return pa.table([table.column("k")[:1], table.column("part")[:1], pa.array([np.packbits(bits).tobytes()], pa.binary())],
                        names=["k", "part", "bits"])

    new = merged.select("k", F.explode("reached").alias("slot")).select(
        "k", F.shiftright("slot", RANGE_BITS).alias("part"), (F.col("slot") % (1 << RANGE_BITS)).alias("low")).distinct()
    return new.groupBy("k", "part").applyInArrow(pack, "k int, part int, bits binary").collect()


def _spelled(done: DataFrame, pieces: DataFrame) -> DataFrame:
    """(lang, k, phrase, f) of the phrases in ``done``; each is asked of one chunk that holds it."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, payload in zip(batch.column("k").to_pylist(), batch.column("done").to_pylist()):
                c = _Counts.unpacked([payload])
                yield pa.record_batch([pa.array(c.chunk), pa.array(np.full(len(c.h), k, np.int32)), pa.array(c.h.view(np.int64)),
                                       pa.array(c.check), pa.array(c.n)], names=["chunk", "k", "h", "check", "f"])

    def packed(table: pa.Table) -> pa.Table:
        k, h, check, f = (table.column(c).to_numpy().astype(np.int64) for c in ("k", "h", "check", "f"))
        return pa.table([table.column("chunk")[:1], pa.array([C.pack(k, h.view(np.uint64), check, f)], pa.binary())],
                        names=["chunk", "asked"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, asked in zip(batch.column("body"), batch.column("asked")):
                yield from answers(_Pieces.read(body.as_py()), *C.unpack(asked.as_py()))

    def answers(chunk: _Pieces, lengths, h, check, f) -> Iterator[pa.RecordBatch]:
        for k in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == k)
            mine = mine[np.lexsort((check[mine], h[mine]))]
            place = window_starts(chunk.first, k)
            own, own_check = chunk.keys(k, place)
            # equal 64 bits are one run of the sorted requests, mostly of one entry
            at = np.searchsorted(h[mine], own)
            spot = np.full(len(mine), -1)
            while True:
                live = (at < len(mine)) & (h[mine[np.minimum(at, len(mine) - 1)]] == own)
                if not live.any():
                    break
                same = live & (check[mine[np.minimum(at, len(mine) - 1)]] == own_check)
                spot[at[same]] = place[same]
                at = np.where(live & ~same, at + 1, len(mine))
            langs, phrases = chunk.spelled(k, spot)
            yield pa.record_batch([langs, pa.array(np.full(len(mine), k, np.int32)), phrases, pa.array(f[mine].astype(np.int64))],
                                  names=["lang", "k", "phrase", "f"])

    rows = arrow_map(done.where("done IS NOT NULL").select("k", "done"), listed, "chunk bigint, k int, h bigint, check bigint, f bigint")
    asked = rows.groupBy("chunk").applyInArrow(packed, "chunk bigint, asked binary")
    return cut(arrow_map(pieces.select("chunk", "body").join(asked, "chunk").select("body", "asked"), spell,
                         "lang string, k int, phrase string, f bigint"), "phrases")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD,
                     longest: int = LONGEST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, k, phrase, f) of all phrases of 1 to ``longest`` words with f >= ``threshold``,
    and (lang, n), the number of words of each language.

    A-Z are lower-cased; pieces end at . , ; : ! ? and line breaks; words are parted by spaces and
    tabs; a phrase lies inside one piece. Occurrences may overlap. Null texts count as empty, a null
    language as ``und``. Repeated rows count as often as they come. Very long texts are read whole.
    An empty table, or one without words, gives two empty tables. Other columns are not read.
    """
    if shards * longest >= NEVER:
        raise ValueError("too many shards for steps of one byte")
    spark = docs.sparkSession
    pieces = write_shards(docs, text, lang, shards)
    words = pieces.agg(F.sum("words")).first()[0] or 0
    slots, buckets = _slots(words), C.bucket_count(words)
    reach = [np.full(slots, NEVER, dtype=np.uint8) for _ in range(longest - 1)]
    reached_in: list[set[int]] = [set() for _ in range(longest)]  # steps in which phrases of a length got there
    merged, done, step = None, [], 0
    while lengths := [k for k in range(1, longest + 1) if (
            step < shards if k == 1 else any(r < step <= r + shards for r in reached_in[k - 2]))]:
        known = spark.sparkContext.broadcast(reach)
        sent = _scan(pieces.where(F.col("shard") == step % shards), lengths, step, shards, buckets, known)
        if merged is not None:  # a length that rests has nothing left to count
            sent = sent.unionAll(merged.where("rest IS NOT NULL").select("k", "bucket", F.lit(False), "rest"))
        merged = _merged(sent, step, shards, threshold, longest, slots)
        done.append(merged.select("k", "done"))
        for row in _reached(merged):
            reached_in[row.k - 1].add(step)
            part = reach[row.k - 1][row.part << RANGE_BITS:(row.part + 1) << RANGE_BITS]
            part[np.unpackbits(np.frombuffer(row.bits, np.uint8), count=len(part)).astype(bool) & (part == NEVER)] = step
        known.unpersist()
        step += 1
    every = done[0]
    for table in done[1:]:
        every = every.unionAll(table)
    totals = pieces.select(F.explode("sizes").alias("s")).groupBy("s.lang").agg(F.sum("s.n").alias("n"))
    return _spelled(every, pieces), cut(totals, "totals")


def _exact(value: Column | int) -> Column:
    """A whole number whose products may pass 64 bits."""
    return (F.lit(value) if isinstance(value, int) else value).cast("decimal(19,0)")


def collocations(counts: DataFrame, totals: DataFrame, top: int = 2000, share: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two words or more per language.

    ``a`` is a phrase's count; cut after its first words, ``l`` and ``r`` are the counts of both
    parts, and the score is 2,000,000 * a div (l + r) at the lowest-scoring cut, the earliest on
    ties. Phrases inside a longer one with at least ``share`` hundredths of their count are left
    out. Order: score and count descending, then the phrase by its bytes.
    """
    phrase = F.col("phrase")
    whole = counts.where("k > 1")
    cuts = whole.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "k", "phrase", F.col("f").alias("a"), "j", F.expr("substring_index(phrase, ' ', j)").alias("first"),
        F.expr("substring_index(phrase, ' ', j - k)").alias("rest"))
    one = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    two = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr("(cast(2000000 as decimal(19,0)) * cast(a as decimal(19,0))) "
                   "div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = (cuts.join(one, ["lang", "first"]).join(two, ["lang", "rest"])
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "j", "l", "r")).alias("cut")))
    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), "
                   "i -> array_join(slice(words, i, m), ' '))))")
    longer = (whole.where("k > 2").withColumn("words", F.split(phrase, " "))
              .select("lang", F.explode(inner).alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (_exact(100) * _exact(F.col("longer")) < _exact(share) * _exact(F.col("a"))))
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", "salt").orderBy(*order)  # a language may hold most phrases: first by parts
    rows = (rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
            .withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return rows.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
