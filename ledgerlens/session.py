"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "ledgerlens", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators expect; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's checkpoint folder.

    Only a local session without one gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="ledgerlens-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{os.getpid()}-{uuid.uuid4().hex[:12]}"


#: Shuffle files go when the query that made them ends; else they stay until the driver collects its garbage.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_ON_THE_WAY: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block."""
    was = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in was.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def cut(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Besides cutting lineage this pins values that a recomputation could change,
    such as the partition numbers of a sampled range sort. Shuffle files go when it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with settings(spark, LEAN):
        df.write.parquet(path)
    passed = _ON_THE_WAY.get()
    if passed is not None:
        passed.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Shuffle files of streams go when the driver collects its garbage, which it puts off while it has memory."""
    spark._jvm.System.gc()


def drop(table: DataFrame) -> None:
    """Remove a table that ``cut`` has written and nothing reads any more."""
    for path in {os.path.dirname(file) for file in table.inputFiles()}:
        remove(table.sparkSession, path)


STEP_ROWS = 500_000  # rows up to which the steps of a table are one plan


def stepwise(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table after each step of its making and removes the one before.

    So the shuffles of one step are on disk at a time, not those of all. Tables of up to
    ``STEP_ROWS`` rows pass as they are.
    """
    if rows.count() <= STEP_ROWS:
        return lambda df: df
    last: list[DataFrame] = []

    def step(df: DataFrame) -> DataFrame:
        out = cut(df, "step")
        for before in last:
            drop(before)
        last[:] = [out]
        return out

    return step


def settled(spark: SparkSession, build: Callable[[], DataFrame], tag: str = "table") -> DataFrame:
    """What ``build`` makes, written; the tables that were cut on the way to it are removed."""
    outer, passed = _ON_THE_WAY.get(), []
    token = _ON_THE_WAY.set(passed)
    try:
        with settings(spark, LEAN):
            out = cut(build(), tag)
        kept = passed.pop()
    finally:
        _ON_THE_WAY.reset(token)
        for path in passed:
            remove(spark, path)
    if outer is not None:
        outer.append(kept)
    return out
