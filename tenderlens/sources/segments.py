"""Keyed tables as buckets of immutable segments: a batch adds a segment, the newest wins on read.

    of=64/batch=d3/bucket=17/…     rows of batch 3 whose key falls into bucket 17
    of=64/batch=m5/bucket=17/…     that bucket with batches up to 5 merged

A key's rows lie in one bucket, so a batch writes its own rows only and leaves other buckets'
files alone, reading merges buckets that have several segments, and compaction rewrites the
buckets that batches touched. A folder without ``_SUCCESS`` is that of a failed write.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.session import delete_folder

BUCKETS = 64
MAX_SEGMENTS = 4
BUCKET = "bucket"
DELTA, MERGED = "d", "m"
_SEGMENT = re.compile(r"batch=([dm])(\d+)$")


@dataclass(frozen=True)
class Segment:
    """One batch or one merged state within one bucket."""

    number: int
    kind: str
    bucket: int

    def folder(self, path: str, buckets: int) -> str:
        return f"{path}/of={buckets}/batch={self.kind}{self.number}/{BUCKET}={self.bucket}"


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder, none where it does not exist."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []


def _buckets(spark: SparkSession, path: str) -> int | None:
    found = [int(n[3:]) for n in folder_names(spark, path) if n.startswith("of=")]
    return found[0] if found else None


def segments(spark: SparkSession, path: str) -> tuple[int | None, list[Segment]]:
    """(number of buckets, finished segments); names only, no data is read."""
    buckets = _buckets(spark, path)
    found = []
    for name in folder_names(spark, f"{path}/of={buckets}") if buckets else []:
        match, inside = _SEGMENT.match(name), folder_names(spark, f"{path}/of={buckets}/{name}")
        if match and "_SUCCESS" in inside:
            own = [int(n.removeprefix(f"{BUCKET}=")) for n in inside if n.startswith(f"{BUCKET}=")]
            found += [Segment(int(match[2]), match[1], b) for b in own]
    return buckets, found


def _live(found: Sequence[Segment]) -> dict[int, list[Segment]]:
    """Per bucket the newest base and the deltas after it, oldest first."""
    by_bucket: dict[int, list[Segment]] = defaultdict(list)
    for s in sorted(found, key=lambda s: (s.number, s.kind == MERGED)):
        if s.kind == MERGED:
            by_bucket[s.bucket] = [s]
        else:
            by_bucket[s.bucket].append(s)
    return by_bucket


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _last_number(spark: SparkSession, path: str, buckets: int) -> int:
    """The highest number in use, failed writes included, so that their folders are never mixed with new files."""
    return max((int(m[2]) for m in map(_SEGMENT.match, folder_names(spark, f"{path}/of={buckets}")) if m), default=0)


def append_segment(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> int | None:
    """Add a batch: its rows replace all rows of the same keys. The number of buckets is that of the first batch.
    Each bucket's rows are one file. Returns the segment's number, or None for an empty batch."""
    spark = rows.sparkSession
    if rows.isEmpty():
        return None
    buckets = _buckets(spark, path) or buckets
    number = _last_number(spark, path, buckets) + 1
    placed = rows.withColumn(BUCKET, bucket_of(key, buckets))
    placed.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/of={buckets}/batch={DELTA}{number}")
    return number


def _read(spark: SparkSession, path: str, buckets: int, found: Sequence[Segment]) -> DataFrame:
    """Rows of segments, each with the number of its batch. Columns that a segment lacks are null."""
    folders = [s.folder(path, buckets) for s in found]
    rows = spark.read.option("mergeSchema", True).option("basePath", f"{path}/of={buckets}").parquet(*folders)
    return rows.withColumn("_number", F.substring("batch", 2, 20).cast("long")).drop("batch")


def read_segments(
    spark: SparkSession, path: str, key: str, values: Sequence | None = None
) -> DataFrame | None:
    """The table, or None before the first batch. Buckets with one segment are plain scans; of
    those with several only the rows of each key's newest segment count, by one shuffle of
    those buckets. With ``values`` only the buckets that can hold these keys are read."""
    buckets, found = segments(spark, path)
    if not found:
        return None
    live = _live(found)
    if values is not None:
        kind = _read(spark, path, buckets, found[:1]).schema[key].dataType
        wanted = spark.createDataFrame([(v,) for v in values], f"`{key}` {kind.simpleString()}")
        hit = {r[0] for r in wanted.select(bucket_of(key, buckets)).distinct().collect()}
        live = {b: s for b, s in live.items() if b in hit} or {min(live): live[min(live)]}
    plain = [s[0] for s in live.values() if len(s) == 1]
    layered = [s for many in live.values() if len(many) > 1 for s in many]
    parts = [_read(spark, path, buckets, plain)] if plain else []
    if layered:
        of_key = Window.partitionBy(BUCKET, key)
        parts.append(
            _read(spark, path, buckets, layered).withColumn("_newest", F.max("_number").over(of_key))
            .filter(F.col("_number") == F.col("_newest")).drop("_newest")
        )
    table = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return table.drop("_number", BUCKET)


def compact(spark: SparkSession, path: str, key: str, max_segments: int = MAX_SEGMENTS) -> list[int]:
    """Merge the buckets with more than ``max_segments`` segments; the others' files stay as they are.

    The merged state takes the number of the last segment it holds, so a batch written
    meanwhile lies over it. What it replaces is deleted at the next compaction, for readers
    that began before.
    """
    buckets, found = segments(spark, path)
    live = _live(found)
    used = {s for many in live.values() for s in many}
    for old in set(found) - used:
        delete_folder(spark, old.folder(path, buckets))
    due = {b: many for b, many in live.items() if len(many) > max_segments}
    if not due:
        return []
    number = max(s.number for many in due.values() for s in many)
    newest = F.max("_number").over(Window.partitionBy(BUCKET, key))
    merged = _read(spark, path, buckets, [s for many in due.values() for s in many]).withColumn("_newest", newest)
    merged = merged.filter(F.col("_number") == F.col("_newest")).drop("_newest", "_number")
    merged.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/of={buckets}/batch={MERGED}{number}")
    return sorted(due)
