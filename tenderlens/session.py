"""Lineage barriers that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[list[str]] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one is invented only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared:
            sc.setCheckpointDir(shared)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tenderlens-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the checkpoint folder and cut its lineage.

    What reads it later is pruned and filtered at the scan, starts without the constraints
    of the plan behind it, and knows its size.
    """
    path = _written(df)
    for paths in _open[-1:]:
        paths.append(path)
    # With its schema given, reading it back starts no job.
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def stored_meanwhile(df: DataFrame) -> Iterator[DataFrame]:
    """As ``stored``, for a large table that nothing reads after the block: it is packed closer, and deleted at the end."""
    path = _written(df, compression="zstd")
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        delete_folder(df.sparkSession, path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, **options: str) -> str:
    """The new folder ``df`` was written to. What was shuffled for it is no longer read and is deleted at once, not
    whenever the driver collects its garbage."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4()}"
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def barriers(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``stored`` writes inside this block when it ends.

    For jobs that leave only tables of their own; a DataFrame that still reads a barrier
    must not leave the block.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete_folder(spark, path)


# Rows that one shuffle task takes with ease, and up to which a step is planned as a small one.
TASK_ROWS, SMALL_ROWS = 100_000, 5_000_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` partitioned by ``keys`` into tasks of some ``TASK_ROWS`` of its ``rows``, where the session's shuffle
    partitions would be fewer: what a task sorts and holds then stays the same however many rows there are, and nothing
    spills. Smaller tables stay as they are, for adaptive execution to plan."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def by_shuffle(df: DataFrame) -> DataFrame:
    """One side of a join that grows with the input: its rows go from task to task, never through the driver to all,
    which the size of its compressed files would have Spark do."""
    return df.hint("merge")


@contextmanager
def planned_small(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plan what runs in this block for tables of ``rows`` rows: where these are few, steps that repeat many times take
    few shuffle tasks and one job each, instead of a job and a new plan for every shuffle. Larger ones stay adaptive."""
    if rows > SMALL_ROWS:
        yield
        return
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(min(partitions, rows // TASK_ROWS + 1))}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
