"""Small helpers shared by the text operators: row numbers, typed batches, run folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import cut  # noqa: F401



def documents(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    return df.mapInArrow(work, schema)


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``size`` bytes of text, so that scratch arrays stay small."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        low = 0
        while low < len(batch):
            done = int(ends[low - 1]) if low else 0
            to = max(low + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(low, to - low)
            low = to


def text_volume(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column; one narrow aggregation."""
    return df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
