"""Stored tables laid out for one kind of read: pages by rank, rows by key, names by part of the name."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.operators.selection import layout_positions

POSITION, CHUNK = "position", "chunk"
CHUNK_ROWS = 50_000
GRAM = 3


# --- pages ---------------------------------------------------------------------------------


def write_ranked(df: DataFrame, path: str, order: Sequence[Column], chunk_rows: int = CHUNK_ROWS) -> None:
    """Store the rows by their place in ``order``, a folder with one file for every ``chunk_rows`` places.

    Places come from a range layout: sizes of the earlier partitions plus the offset in the
    own one, so no task and no driver sorts all rows.
    """
    placed = layout_positions(df, [], order, POSITION).withColumn(CHUNK, F.floor(F.col(POSITION) / chunk_rows))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartition(tasks, CHUNK).sortWithinPartitions(CHUNK, POSITION).write.mode("overwrite").partitionBy(CHUNK).parquet(path)


def stored_page(spark: SparkSession, path: str, limit: int = 50, offset: int = 0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a ranked table, at any depth from the files that hold them: two at most
    while ``limit`` is no more than ``chunk_rows``. Places beyond the last row give no rows."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    first, last = offset // chunk_rows, (offset + max(limit, 1) - 1) // chunk_rows
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [f"{path}/{CHUNK}={c}" for c in range(first, last + 1)]
    there = [f for f in folders if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f))]
    table = spark.read.option("basePath", path).parquet(*(there or [path]))
    place = F.col(POSITION)
    page = table.filter((place >= offset) & (place < offset + limit)) if there else table.limit(0)
    return page.drop(CHUNK).orderBy(POSITION).drop(POSITION)


# --- rows by key ------------------------------------------------------------------------------


def write_clustered(df: DataFrame, path: str, key: str, rows_per_key: float = 1.0, row_group_bytes: int = 16 << 20) -> None:
    """Store rows in ranges of the key with a Bloom filter on it, so that a lookup by key opens one row group:
    those of other ranges fall to their least and greatest key, and a missing key to the filter."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Only to size the filters; more keys than that make them answer "perhaps" more often.
    keys = max(1_000, int(1_000_000 / rows_per_key))
    (
        df.repartitionByRange(tasks, key).sortWithinPartitions(key).write.mode("overwrite")
        .option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(keys))
        .option("parquet.block.size", str(row_group_bytes)).parquet(path)
    )


# --- names by a part ----------------------------------------------------------------------------


def _grams(text: Column) -> Column:
    """Different runs of three characters of the lower-case text."""
    lower = F.lower(text)
    places = F.sequence(F.lit(1), F.greatest(F.char_length(lower) - (GRAM - 1), F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substr(lower, i, F.lit(GRAM))))


def name_grams(df: DataFrame, name: str) -> DataFrame:
    """(gram, name): for each run of three characters the different names that hold it. Far smaller than the table."""
    names = df.select(name).filter(F.col(name).isNotNull()).distinct()
    return names.select(F.explode(_grams(F.col(name))).alias("gram"), F.col(name).alias("name"))


def names_like(grams: DataFrame, part: str) -> DataFrame:
    """Names that hold ``part``, whatever the case; ``%`` and ``_`` in it are wildcards, as in LIKE.

    Names with all runs of three of the part's plain pieces are looked up by equality and
    then matched; only a part without such a run is matched against all names.
    """
    pieces = [p.lower() for p in re.split(r"[%_]", part)]
    wanted = sorted({p[i : i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)})
    if wanted:
        found = grams.filter(F.col("gram").isin(wanted)).groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted))
    else:
        found = grams.select("name").distinct()
    return found.filter(F.col("name").ilike(f"%{part}%")).select("name")


def with_name_like(df: DataFrame, name: str, grams: DataFrame, part: str) -> DataFrame:
    """Rows whose name holds ``part``: each name is matched once, rows only by equality."""
    return df.join(names_like(grams, part).withColumnRenamed("name", name), name, "left_semi").select(*df.columns)
