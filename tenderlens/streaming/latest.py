"""The latest sighting of each key and what changed, from a stream whose sightings come in any order.

A streaming aggregation holds the newest sighting of a key in each span of event time and
forgets a span when the watermark has passed it. What an update brings is compared with the
stored latest sightings, so a sighting of an earlier span that comes after a newer one
changes nothing. Partial aggregates go through the shuffle, so a key of many sightings is
no large group.

    latest/          segments: the newest sighting of each key
    changes/batch=7  what micro-batch 7 brought: new, changed, or seen again in the same state
    stream/          the stream's own checkpoint, which numbers the batches
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tenderlens.sources import segments

NEW, CHANGED, SEEN = "new", "changed", "seen"


def newest_by_span(sightings: DataFrame, key: str, order: Sequence[str], late: str, span: str) -> DataFrame:
    """Per key and span of the first ``order`` column the greatest sighting, as a struct.

    Columns after ``order`` break what ties it leaves, so repeated rows and ties have one
    answer in any order of arrival; they must be comparable (no maps). Rows without a time
    have no place in the order and are left out; a null key is a key like others.
    """
    rest = [c for c in sightings.columns if c != key and c not in order]
    spans = F.window(order[0], span).alias("_span")
    return sightings.withWatermark(order[0], late).groupBy(key, spans).agg(F.max(F.struct(*order, *rest)).alias("_row"))


def changes_of(batch: DataFrame, known: DataFrame | None, key: str, order: Sequence[str]) -> DataFrame:
    """The newest sighting of each key of ``batch`` that is later than the known one, with its ``kind`` and the ``previous`` values."""
    newest = batch.groupBy(key).agg(F.max("_row").alias("_row")).select(key, "_row.*")
    values = F.struct(*[c for c in newest.columns if c != key and c not in order])
    place = F.struct(*order)
    if known is None:
        known = newest.limit(0)
    before = known.select(F.col(key).alias("_key"), place.alias("_place"), values.alias("previous"))
    later = newest.join(before, F.col(key).eqNullSafe(F.col("_key")), "left").filter(F.col("_place").isNull() | (place > F.col("_place")))
    kind = F.when(F.col("_place").isNull(), NEW).when(values.eqNullSafe(F.col("previous")), SEEN).otherwise(CHANGED)
    return later.withColumn("kind", kind).drop("_key", "_place")


def _finished(spark: SparkSession, folder: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def apply_batch(batch: DataFrame, number: int, path: str, key: str, order: Sequence[str]) -> None:
    """Write the batch's changes, then the sightings they leave. A batch that is given again takes
    the changes it wrote before, so neither a loss between both writes nor a repeat alters anything."""
    spark, folder = batch.sparkSession, f"{path}/changes/batch={number}"
    if not _finished(spark, folder):
        known = segments.read_segments(spark, f"{path}/latest", key)
        changes_of(batch, known, key, order).write.mode("overwrite").parquet(folder)
    changes = spark.read.parquet(folder).drop("previous", "kind")
    segments.append_segment(changes, f"{path}/latest", key)
    segments.compact(spark, f"{path}/latest", key)


def follow(
    sightings: DataFrame, path: str, key: str, order: Sequence[str], late: str = "7 days", span: str = "1 day"
) -> StreamingQuery:
    """Keep ``path`` up to date with a stream of sightings: all that has landed, then stop.

    ``order`` names the event time and what breaks its ties. A sighting more than ``late``
    behind the newest one counts as long as its span is still held; later ones are dropped,
    and the query's progress counts them (numRowsDroppedByWatermark).
    """
    newest = newest_by_span(sightings, key, order, late, span)

    def run(batch: DataFrame, number: int) -> None:
        apply_batch(batch, number, path, key, order)

    return (
        newest.writeStream.outputMode("update").foreachBatch(run)
        .option("checkpointLocation", f"{path}/stream").trigger(availableNow=True).start()
    )


def read_latest(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    return segments.read_segments(spark, f"{path}/latest", key)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """All changes with the number of their batch."""
    return spark.read.option("basePath", f"{path}/changes").parquet(f"{path}/changes/*")
