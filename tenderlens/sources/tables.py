"""Stored tables: snapshots, upserts, run logs, code states, daily partitions.

A snapshot table is a folder of Parquet versions; readers take the newest finished one,
so a failed or repeated write never leaves a half-replaced table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlens.functions.scalars import parse_number
from tenderlens.session import by_shuffle, delete_folder, spread
from tenderlens.sources.segments import read_segments

STATE_SCHEMA = "code string, state int"
GONE = -1
EMBEDDING_SCHEMA = "text_hash string, model string, embedding array<float>"

LOG_SCHEMAS = {
    "ingestion": "id long, run_at timestamp, state string, rows_in long, rows_out long, cols_dropped int, "
                 "dups long, zero_rows long, detail string",
    "scoring": "id long, run_at timestamp, state string, n_tenders long, detail string",
    "sync": "id long, run_at timestamp, state string, n_listed long, n_queried long, n_upserted long, "
            "n_failed long, detail string",
}


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions under a table folder, oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("v=") and fs.exists(done):
            found.append(int(name[2:]))
    return sorted(found)


def snapshot_exists(spark: SparkSession, path: str) -> bool:
    return bool(_versions(spark, path))


def has_version(spark: SparkSession, path: str, version: int) -> bool:
    return version in _versions(spark, path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest finished version, or None when there is none."""
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/v={versions[-1]}") if versions else None


def write_snapshot(df: DataFrame, path: str, version: int | None = None, partition_by: str | None = None) -> int:
    """Write a new version (the next one unless given) and return it. Readers of older
    versions are not disturbed, so ``df`` may read the table it replaces."""
    if version is None:
        version = max(_versions(df.sparkSession, path), default=-1) + 1
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{path}/v={version}")
    return version


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` finished versions; one older stays for readers that began before."""
    for version in _versions(spark, path)[: -max(keep, 1)]:
        delete_folder(spark, f"{path}/v={version}")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def table_columns(spark: SparkSession, name: str) -> list[str]:
    return spark.table(name).columns if table_exists(spark, name) else []


def project_common_columns(batch: DataFrame, target: DataFrame) -> DataFrame:
    """The batch columns that the target has, in the target's types. Text becomes a number with
    a decimal comma or point; a value that doesn't fit its type ends the job, it is not lost."""
    types = {f.name: f.dataType for f in target.schema}
    given = {f.name: f.dataType for f in batch.schema}
    return batch.select(*[_fitted(c, given[c], types[c]) for c in batch.columns if c in types])


def _fitted(name: str, given: T.DataType, wanted: T.DataType) -> Column:
    value = F.col(name)
    if given == wanted:
        return value
    number = isinstance(given, T.StringType) and isinstance(wanted, (T.DoubleType, T.FloatType))
    fitted = parse_number(value).cast(wanted) if number else value.try_cast(wanted)
    message = F.concat(F.lit(f"column {name}: no {wanted.simpleString()}: "), value.cast("string"))
    return F.when(value.isNotNull() & fitted.isNull(), F.raise_error(message)).otherwise(fitted).cast(wanted).alias(name)


def upsert_by_key(target: DataFrame | None, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the batch replace every target row of the same key. Columns are matched by
    name: extra batch columns are dropped, absent ones become null. Without a target the
    batch is the table."""
    if target is None:
        return batch
    keys = batch.select(key).distinct()
    kept = target.join(by_shuffle(keys), key, "left_anti").select(*target.columns)
    return kept.unionByName(project_common_columns(batch, target), allowMissingColumns=True)


def overlay_offers(
    bulk: DataFrame, updates: DataFrame, key: str = "tender_id", status: str = "status", order: Sequence[str] = ()
) -> DataFrame:
    """Bulk offer lines plus update rows of tenders the bulk lacks, so an update never
    erases bids; the status of an updated tender is the update's. Of several update rows
    the last by ``order`` counts, or by all their columns. Give it stored tables, the bulk is counted."""
    rows = bulk.count()
    bulk, updates = spread(bulk, rows, key), spread(updates, rows, key)
    last = F.struct(*[F.col(c) for c in order or updates.columns])
    newest = updates.groupBy(key).agg(F.max_by(F.col(status), last).alias("_status"))
    refreshed = bulk.join(by_shuffle(newest), key, "left").withColumn(status, F.coalesce("_status", status)).drop("_status")
    extra = updates.join(by_shuffle(bulk.select(key).distinct()), key, "left_anti")
    return refreshed.select(*bulk.columns).unionByName(project_common_columns(extra, bulk), allowMissingColumns=True)


def upsert_embeddings(cache: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Insert or replace embedding cache rows by text hash."""
    return upsert_by_key(cache, rows, "text_hash")


def append_embeddings(rows: DataFrame, path: str) -> None:
    """Add vectors to the stored cache, a folder for each model. What is there stays and is
    not added again, so readers need not look for repeats."""
    new = rows.dropDuplicates(["text_hash", "model"])
    if _has_files(rows.sparkSession, path):
        known = rows.sparkSession.read.schema(EMBEDDING_SCHEMA).parquet(path).select("text_hash", "model")
        new = new.join(known, ["text_hash", "model"], "left_anti")
    new.select("text_hash", "model", "embedding").write.mode("append").partitionBy("model").parquet(path)


def read_embeddings(spark: SparkSession, path: str | None, model: str) -> DataFrame:
    """Stored vectors of one model, one per text; only its folder is read."""
    if path is None or not _has_files(spark, path):
        return spark.createDataFrame([], EMBEDDING_SCHEMA)
    return spark.read.schema(EMBEDDING_SCHEMA).parquet(path).filter(F.col("model") == model)


# --- run logs ------------------------------------------------------------------------


def read_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The run log, empty when nothing has been logged yet."""
    if not _has_files(spark, path):
        return spark.createDataFrame([], LOG_SCHEMAS[kind])
    return spark.read.schema(LOG_SCHEMAS[kind]).parquet(path)


def _has_files(spark: SparkSession, path: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)


def append_run_log(spark: SparkSession, path: str, kind: str, record: Mapping) -> int:
    """Append one record under the next id and return the id."""
    last = read_log(spark, path, kind).agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).first()["id"]
    fields = T.StructType.fromDDL(LOG_SCHEMAS[kind])
    values = {"run_at": datetime.now(), **record, "id": last + 1}
    row = spark.createDataFrame([tuple(values.get(f.name) for f in fields)], fields)
    row.write.mode("append").parquet(path)
    return last + 1


# --- code states -----------------------------------------------------------------------


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Known code states; a missing table counts as empty, a damaged one is an error. The table is one of segments,
    or a snapshot."""
    found = read_segments(spark, path, "code")
    found = read_snapshot(spark, path) if found is None else found
    return spark.createDataFrame([], STATE_SCHEMA) if found is None else found.select("code", "state")


def advance_state(known: DataFrame, processed: DataFrame) -> DataFrame:
    """Merge processed (code, state) into the known states; the processed ones win."""
    return known.join(by_shuffle(processed.select("code")), "code", "left_anti").unionByName(processed.select("code", "state"))


# --- daily partitions --------------------------------------------------------------------


def days_to_sync(last_synced: date | None, today: date) -> list[date]:
    """Yesterday (for late entries) and today, plus every day missed since the last sync."""
    start = today - timedelta(days=1)
    if last_synced is not None:
        start = min(start, last_synced + timedelta(days=1))
    return [start + timedelta(days=i) for i in range((today - start).days + 1)]


def write_days(df: DataFrame, path: str, day: str = "day") -> None:
    """Replace exactly the days present in ``df``; writing a day again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def last_synced_day(spark: SparkSession, path: str, day: str = "day") -> date | None:
    """Newest day stored, from the names of the partition folders; no data is read."""
    if not _has_files(spark, path):
        return None
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    days = [n.removeprefix(f"{day}=") for n in names if n.startswith(f"{day}=")]
    return max((date.fromisoformat(d) for d in days if d != "__HIVE_DEFAULT_PARTITION__"), default=None)
