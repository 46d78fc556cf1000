"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.session import TASK_ROWS, barriers, delete_folder, ensure_checkpoint_dir, stored

__all__ = ["barriers", "claim_caches", "components", "digest", "few_files", "keep_cache", "only_result", "scratch", "ship", "shuffle_parts", "stored", "table"]


_caches: dict[str, Callable[[], None]] = {}
_claimed: str | None = None


def keep_cache(name: str, clear: Callable[[], None]) -> None:
    """Name what a module keeps in a Python worker from one task to the next."""
    _caches[name] = clear


def claim_caches(name: str | None) -> None:
    """At the start of a task: drop what other operators left in this worker, which Spark uses again and again. Where
    another operator had the worker before, what it freed goes back to the system too."""
    global _claimed
    for other, clear in _caches.items():
        if other != name:
            clear()
    if name != _claimed:
        _claimed = name
        release_memory()


def release_memory() -> None:
    """Freed memory that Python's, Arrow's and C's allocators still hold goes back to the system, where they can do so."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = f"{tempfile.mkdtemp()}/{package.name}.zip"  # Spark's own file server hands it out
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"


def only_result(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` returns, as a table; the tables that it stores on the way are deleted."""
    path = scratch(spark, "result")
    with barriers(spark):
        build().write.parquet(path)
    return spark.read.parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows at most, for a table of some ``TASK_ROWS`` rows a file, or a file for each core.

    For what a shuffle by an even key gives: else each shuffle partition writes a file however few rows it has, and for
    each file Spark's local file system starts several processes.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def digest(*columns: Column) -> list[Column]:
    """Two independently seeded 64-bit hashes, together a 128-bit key."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]


def _larger_neighbours(edges: DataFrame) -> DataFrame:
    """Large-star: each vertex ties its larger neighbours to the least of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _smaller_neighbours(edges: DataFrame) -> DataFrame:
    """Small-star: each vertex ties itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, root) for every vertex of ``edges`` (columns a, b) but the roots themselves; the
    root is the least id of the component. ``rows``: at most so many edges, if that is known.

    Alternating large-star and small-star until nothing changes: every pass is an
    aggregation and an equi-join on a vertex, the number of edges never grows, and passes
    grow with the logarithm of the diameter. State is a table in the checkpoint folder.
    """
    spark = edges.sparkSession

    def written(df: DataFrame, rows: int | None) -> str:
        path = scratch(spark, "components")
        (df if rows is None else few_files(df, rows)).write.parquet(path)
        return path

    at = written(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows)
    rows = spark.read.parquet(at).count()
    before = None
    while True:
        large = _larger_neighbours(spark.read.parquet(at)).distinct()
        last, at = at, written(_smaller_neighbours(large), rows)
        delete_folder(spark, last)
        state = spark.read.parquet(at)
        now = tuple(state.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == before:
            return state.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now
