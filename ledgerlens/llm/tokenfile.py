"""Token-id files: independent zstandard frames, a document index and a trailing seek table.

A file is a run of zstandard frames, each with its content checksum, then two skippable frames
that plain decoders pass over: the document index and the seek table of the public seekable
format, whose entries hold each frame's sizes and the low half of its content's XXH64. Frames hold
whole documents up to ``FRAME`` ids; a longer document has frames of its own. A reader fetches the
end of the file, and then only the frames of the documents it wants.

Files are written and read through the file system of their URI, so they lie in the shared folder.
A file's name is new for each attempt of a task; those of lost attempts are in no manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm import tokens
from ledgerlens.llm.tables import arrow_map, cut, text_volume
from ledgerlens.session import scratch_path

FRAME = 1 << 16  # ids
FILE_BYTES = 32 << 20  # of text

# Magic numbers of the zstandard formats, and of the index.
_SKIPPABLE, _INDEX_FRAME, _SEEK_FRAME, _SEEK_END = 0x184D2A50, 0x184D2A51, 0x184D2A5E, 0x8F92EAB1
_INDEX_MAGIC = b"TIDX"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file; ``width`` is the bytes of an id."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.open: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.held and self.held + len(ids) > FRAME:
            self._flush()
        self.ids.append(doc_id)
        self.sizes.append(len(ids))
        for at in range(0, len(ids), FRAME):
            self.open.append(ids[at:at + FRAME])
            self.held += len(self.open[-1])
            if self.held >= FRAME:
                self._flush()

    def _flush(self) -> None:
        if self.held:
            raw = np.concatenate(self.open).astype(f"<u{self.width}").tobytes()
            packed = self.packer.compress(raw)
            self.sink.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.open, self.held = [], 0

    def close(self) -> None:
        self._flush()
        known = np.array([i is not None for i in self.ids], dtype=np.uint8)
        ids = np.array([i or 0 for i in self.ids], dtype="<i8")
        body = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(
            known.tobytes() + ids.tobytes() + np.array(self.sizes, dtype="<u8").tobytes())
        index = _INDEX_MAGIC + struct.pack("<BxxxQ", self.width, len(self.ids)) + body
        self.sink.write(struct.pack("<II", _INDEX_FRAME, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0x80, _SEEK_END)
        self.sink.write(struct.pack("<II", _SEEK_FRAME, len(table)) + table)


class Reader:
    """Reads one file; ``decompressed`` counts the frames that were unpacked."""

    def __init__(self, source):
        self.source, self.decompressed = source, 0
        end = source.size()
        source.seek(end - 9)
        count, kind, magic = struct.unpack("<IBI", source.read(9))
        if magic != _SEEK_END or kind != 0x80:
            raise ValueError("no seek table")
        source.seek(end - 9 - 12 * count)
        frames = np.frombuffer(source.read(12 * count), dtype="<u4").reshape(-1, 3)
        self.checks = frames[:, 2]
        self.at = np.concatenate(([0], np.cumsum(frames[:, 0], dtype=np.int64)))
        source.seek(int(self.at[-1]))
        magic, size = struct.unpack("<II", source.read(8))
        index = source.read(size)
        if magic != _INDEX_FRAME or index[:4] != _INDEX_MAGIC:
            raise ValueError("no document index")
        self.width, docs = struct.unpack("<BxxxQ", index[4:16])
        body = zstandard.ZstdDecompressor().decompress(index[16:])
        self.known = np.frombuffer(body, np.uint8, docs).astype(bool)
        self.ids = np.frombuffer(body, "<i8", docs, offset=docs)
        sizes = np.frombuffer(body, "<u8", docs, offset=9 * docs).astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(sizes)))
        self.tokens = np.concatenate(([0], np.cumsum(frames[:, 1], dtype=np.int64))) // self.width
        self._last: tuple[int, np.ndarray] | None = None

    def frame(self, n: int) -> np.ndarray:
        if self._last is None or self._last[0] != n:
            self.source.seek(int(self.at[n]))
            raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.at[n + 1] - self.at[n])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[n]:
                raise ValueError(f"frame {n} does not match its checksum")
            self.decompressed += 1
            self._last = n, np.frombuffer(raw, dtype=f"<u{self.width}")
        return self._last[1]

    def document(self, n: int) -> np.ndarray:
        low, high = int(self.start[n]), int(self.start[n + 1])
        out = []
        frame = int(np.searchsorted(self.tokens, low, side="right")) - 1
        while low < high:
            base, end = int(self.tokens[frame]), min(int(self.tokens[frame + 1]), high)
            out.append(self.frame(frame)[low - base:end - base])
            low, frame = end, frame + 1
        return np.concatenate(out) if out else np.zeros(0, dtype=f"<u{self.width}")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None,
                      id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of every text in ascending id order; the manifest (part, path, docs, tokens).

    Null texts are empty, null ids come first, rows that repeat an id are ordered by text hash.
    Ids must be whole numbers. An empty table gives an empty manifest. ``tokenizer`` is the path of
    a tokenizers file that executors can read.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = max(1, -(-text_volume(narrow) // FILE_BYTES))
    order = [F.col("id"), F.xxhash64("text")]
    placed = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 if max(tokens.load(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part = TaskContext.get().partitionId()
        system, base = open_folder(folder)
        system.create_dir(base, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
        writer = None
        with system.open_output_stream(f"{base}/{name}", compression=None) as sink:
            for batch in batches:
                writer = writer or Writer(sink, width)
                ids = tokens.encode(batch.column("text"), tokenizer, end_id)
                for i, doc in enumerate(batch.column("id").to_pylist()):
                    writer.add(doc, ids.row(i))
            if writer:
                writer.close()
        if not writer:
            system.delete_file(f"{base}/{name}")
            return
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]),
                               pa.array([len(writer.ids)], pa.int64()), pa.array([sum(writer.sizes)], pa.int64())],
                              names=["part", "path", "docs", "tokens"])

    return cut(arrow_map(placed, run, "part int, path string, docs bigint, tokens bigint"), "manifest")


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files of a manifest.

    ``start`` counts the ids of all documents before, over all files.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    based = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
    spread = based.repartition(max(1, min(manifest.count(), 10_000)), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                folder, _, name = uri.rpartition("/")
                system, root = open_folder(folder)
                with system.open_input_file(f"{root}/{name}") as source:
                    reader = Reader(source)
                    crc = [zlib.crc32(reader.document(n).astype("<u4").tobytes()) for n in range(len(reader.ids))]
                    yield pa.record_batch([pa.array(reader.ids, mask=~reader.known), pa.array(reader.start[:-1] + base),
                                           pa.array(np.diff(reader.start)), pa.array(crc, pa.int64())],
                                          names=["id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(spread, run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def fetch(spark: SparkSession, manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) of the ``wanted`` ids only; other frames stay packed.

    The list of wanted ids is broadcast and must be small; each file looks them up in its index.
    """
    ids = np.array(sorted({r[0] for r in wanted.select(id_col).where(F.col(id_col).isNotNull()).limit(100_001).collect()}),
                   dtype=np.int64)
    if len(ids) > 100_000:
        raise ValueError("ask for at most 100,000 documents at once")
    asked = spark.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                folder, _, name = uri.rpartition("/")
                system, root = open_folder(folder)
                with system.open_input_file(f"{root}/{name}") as source:
                    reader = Reader(source)
                    for n in np.flatnonzero(np.isin(reader.ids, asked.value) & reader.known).tolist():
                        yield pa.record_batch([pa.array([int(reader.ids[n])], pa.int64()),
                                               pa.array([reader.document(n).astype(np.int64)], pa.list_(pa.int64())),
                                               pa.array([reader.decompressed], pa.int64())],
                                              names=["id", "ids", "frames"])

    return arrow_map(manifest, run, "id bigint, ids array<bigint>, frames bigint").withColumnRenamed("id", id_col)
