"""Chunks of tokenised documents, and questions that chunks ask of hashed buckets.

Some operators must look up every position of the corpus in an index of the corpus. Rows per
position would be far too many to shuffle. Here documents are tokenised once and written as chunks
of some megabytes. A chunk sorts its distinct keys and sends each bucket of the key space one
packed message; a bucket merges its messages and answers each chunk by position, so an answer
needs no keys. A key that is frequent in the whole corpus is one entry per chunk, never one per
occurrence, and buckets grow in number with the corpus, so each stays of bounded size.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import arrow_map, cut
from ledgerlens.llm.words import SPACED, span_hashes, text_bytes, words_of

CHUNK_BYTES = 4 << 20
BUCKET_KEYS = 1_500_000
NO_ID = np.iinfo(np.int64).max  # stands for a null id: larger than all others
END_HASH = np.uint64(0x5BD1E9955BD1E995)


def narrow(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest unsigned type."""
    if a.dtype.kind == "f" or not len(a):
        return a
    top = int(a.max())
    if int(a.min()) < 0:
        return a
    return a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def pack(*arrays: np.ndarray) -> bytes:
    head, body = [struct.pack("<B", len(arrays))], []
    for a in map(narrow, arrays):
        head.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)))
        body.append(a.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    count, at, out = raw[0], 1, []
    kinds = [struct.unpack_from("<2sQ", raw, at + 10 * i) for i in range(count)]
    at += 10 * count
    for kind, n in kinds:
        dtype = np.dtype("<" + kind.decode())
        out.append(np.frombuffer(raw, dtype, n, at))
        at += n * dtype.itemsize
    return out


def pack_flags(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags.astype(bool))


def unpack_flags(packed: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(packed, count=n).astype(bool)


def gaps(ordered: np.ndarray) -> np.ndarray:
    return np.diff(ordered, prepend=ordered.dtype.type(0))


def ungaps(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)


@dataclass
class Chunk:
    """Documents ``ids``; the words of document i are ``tokens[first[i]:first[i + 1]]``."""

    number: int
    ids: np.ndarray
    first: np.ndarray
    tokens: np.ndarray
    vocabulary: bytes
    ends: np.ndarray
    has_end: bool
    marks: np.ndarray

    @property
    def hashes(self) -> np.ndarray:
        """A hash for each entry of the vocabulary; entry 0 is the end of a document, if any."""
        data = np.frombuffer(self.vocabulary, np.uint8)
        starts = np.concatenate(([0], self.ends))[:-1]
        out = span_hashes(data, starts, self.ends)
        if self.has_end:
            out[0] = END_HASH
        return out

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.first))

    def words(self) -> list[bytes]:
        starts = np.concatenate(([0], self.ends))[:-1].tolist()
        return [self.vocabulary[a:b] for a, b in zip(starts, self.ends.tolist())]


def write_chunks(docs: DataFrame, id_col: str, text: str, lower: bool, end: bool,
                 mark: Column | None = None) -> DataFrame:
    """(chunk, body): every text as word numbers, with ``end`` an end token after each.

    Ids must be whole numbers; null texts have no words. ``mark`` is a flag kept per document.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, bounds = text_bytes(batch.column("text"))
            low = 0
            while low < len(batch):
                to = max(low + 1, int(np.searchsorted(bounds, bounds[low] + CHUNK_BYTES, side="right")) - 1)
                part = batch.slice(low, to - low)
                yield pa.record_batch([pa.array([number]), pa.array([_body(part, lower, end)], pa.binary())],
                                      names=["chunk", "body"])
                number, low = number + 1, to

    chosen = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"),
                         F.lit(False).alias("mark") if mark is None else F.coalesce(mark, F.lit(False)).alias("mark"))
    return cut(arrow_map(chosen, run, "chunk bigint, body binary"), "chunks")


def _body(part: pa.RecordBatch, lower: bool, end: bool) -> bytes:
    words = words_of(part.column("text"), SPACED, lower)
    _, spot, which = np.unique(words.hash, return_index=True, return_inverse=True)
    sizes = np.diff(words.first)
    tokens = which.astype(np.int64)
    starts, lengths = words.start[spot], (words.end - words.start)[spot]
    if end:
        closed = np.zeros(len(tokens) + len(sizes), dtype=np.int64)
        closed[np.arange(len(tokens)) + np.repeat(np.arange(len(sizes)), sizes)] = tokens + 1
        tokens, sizes = closed, sizes + 1
    total = np.cumsum(lengths)
    take = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(starts - (total - lengths), lengths)
    ids = part.column("id").fill_null(int(NO_ID)).to_numpy()
    return pack(ids, sizes, tokens, words.data[take], np.concatenate(([0], lengths)) if end else lengths,
                part.column("mark").to_numpy(zero_copy_only=False).astype(np.uint8))


def read_chunk(number: int, body: bytes, end: bool) -> Chunk:
    ids, sizes, tokens, vocabulary, lengths, marks = unpack(body)
    return Chunk(number, ids.astype(np.int64), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))),
                 tokens.astype(np.int64), vocabulary.tobytes(), np.cumsum(lengths, dtype=np.int64), end, marks.astype(bool))


def chunk_map(chunks: DataFrame, end: bool, work: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work(chunk, row)`` for every chunk; ``row`` has the other columns, answers by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [c for c in batch.schema.names if c not in ("chunk", "body")]
            for i in range(len(batch)):
                row = {c: {a["bucket"]: a["answer"] for a in (batch.column(c)[i].as_py() or ())} for c in others}
                yield from work(read_chunk(batch.column("chunk")[i].as_py(), batch.column("body")[i].as_py(), end), row)

    return arrow_map(chunks, run, schema)


def messages(chunk: int, sent: Iterable[tuple[int, bytes]]) -> pa.RecordBatch:
    """What one chunk sends: (bucket, payload) pairs."""
    sent = list(sent)
    return pa.record_batch([pa.array([b for b, _ in sent], pa.int32()), pa.array([chunk] * len(sent), pa.int64()),
                            pa.array([p for _, p in sent], pa.binary())], names=["bucket", "chunk", "payload"])


MESSAGE = "bucket int, chunk bigint, payload binary"


def answered(asked: DataFrame, answer: Callable[[int, list[int], list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """(chunk, bucket, answer): ``answer(bucket, chunks, payloads)`` gives (chunk, bytes) pairs."""
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        out = list(answer(bucket, table.column("chunk").to_pylist(), table.column("payload").to_pylist()))
        return pa.table([pa.array([c for c, _ in out], pa.int64()), pa.array([bucket] * len(out), pa.int32()),
                         pa.array([a for _, a in out], pa.binary())], names=["chunk", "bucket", "answer"])

    return asked.groupBy("bucket").applyInArrow(run, "chunk bigint, bucket int, answer binary")


def with_answers(chunks: DataFrame, **answers: DataFrame) -> DataFrame:
    """``chunks`` with one column of (bucket, answer) lists for each of ``answers``."""
    out = chunks
    for name, given in answers.items():
        out = out.join(given.where("chunk >= 0").groupBy("chunk").agg(
            F.collect_list(F.struct("bucket", "answer")).alias(name)), "chunk", "left")
    return out


def bucket_count(keys: int) -> int:
    """A power of two that leaves about ``BUCKET_KEYS`` keys to a bucket."""
    return 1 << max(0, (keys // BUCKET_KEYS)).bit_length()


def word_count(chunks: DataFrame, end: bool) -> int:
    """All tokens of all chunks."""
    def count(chunk: Chunk, _) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([len(chunk.tokens)])], names=["n"])

    return chunk_map(chunks, end, count, "n bigint").agg(F.sum("n")).first()[0] or 0


def split_sorted(owner: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Slices of entries sorted by bucket; buckets without entries are left out."""
    bounds = np.searchsorted(owner, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        yield b, slice(int(bounds[b]), int(bounds[b + 1]))


