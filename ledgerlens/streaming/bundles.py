"""Bundles: many rows of a key as one value, so that stateful Python takes columns, not rows.

A keyed processor is handed its input row by row, which costs more than the work on it. A bundle is an
Arrow stream in a binary column ``rows``; bundles are made before the shuffle and opened after the state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TASK_ROWS = 200_000  # rows a task holds while it makes bundles
BUNDLE_ROWS = 4_096  # rows of a bundle at most


def _written(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def written(rows: pa.Table) -> Iterator[pd.DataFrame]:
    """The rows as bundles, one at a time."""
    for batch in rows.to_batches(max_chunksize=BUNDLE_ROWS):
        yield pd.DataFrame({"rows": [_written(batch)]})


def read(frames: Iterable[pd.DataFrame]) -> pa.Table:
    """All rows of a key's bundles."""
    return pa.concat_tables(pa.ipc.open_stream(b).read_all() for f in frames for b in f["rows"])


def bundled(df: DataFrame, *keys: str) -> DataFrame:
    """The keys and ``rows``, bundles of the other columns."""
    fields = [f for f in df.schema if f.name in keys]
    fields.sort(key=lambda f: keys.index(f.name))

    def bundles(held: Sequence[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        code = np.zeros(len(table), dtype=np.int64)
        for k in keys:
            named = table[k].combine_chunks().dictionary_encode(null_encoding="encode")
            code = code * (len(named.dictionary) + 1) + named.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        table = table.take(order)
        code = code[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        cuts = [(a, min(a + BUNDLE_ROWS, b)) for begin, end in zip(first.tolist(), [*first[1:].tolist(), len(code)])
                for a, b in ((x, end) for x in range(begin, end, BUNDLE_ROWS))]
        (rows,) = table.drop_columns(list(keys)).combine_chunks().to_batches()
        named = table.select(list(keys)).take(np.array([a for a, _ in cuts])).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [*(named[k].combine_chunks() for k in keys), pa.array([_written(rows.slice(a, b - a)) for a, b in cuts], pa.binary())],
            names=[*keys, "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TASK_ROWS:
                yield bundles(held)
                held, n = [], 0
        if n:
            yield bundles(held)

    return df.mapInArrow(run, T.StructType([*fields, T.StructField("rows", T.BinaryType())]))


def opened(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of all bundles."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column("rows"):
                for rows in pa.ipc.open_stream(bundle.as_buffer()):
                    yield rows.select(names)

    return df.mapInArrow(run, schema)
