"""Incremental tender sync: changed codes, their details, upsert, state, log.

Each landed listing is one micro-batch. A batch works on tables written by the previous
one and is skipped if the log already has its listing, so re-delivery changes nothing,
whatever number the stream gives the batch.
Upserts go to a table of updates beside the bulk table: an hourly batch never rewrites the
bulk, and a bulk reload never loses an update. ``current_offers`` shows both as one. Updates,
states and attempts are segments: a listing writes what it brings and leaves the rest alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tenderlens.session import barriers, by_shuffle, stored
from tenderlens.sources import segments, tables
from tenderlens.sources.columns import to_offer_lines
from tenderlens.sources.tender_json import (
    LISTING_FILE_SCHEMA,
    flatten_details,
    in_sector,
    listing_codes,
    read_tender_details,
)


def changed_or_new(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Listed codes whose state is unknown or differs."""
    same = listing["state"].eqNullSafe(F.col("_known_state"))
    before = known.select(F.col("code").alias("_known_code"), F.col("state").alias("_known_state"))
    return listing.join(by_shuffle(before), (listing["code"] == F.col("_known_code")) & same, "left_anti").select("code")


def vanished_codes(active: DataFrame, listing: DataFrame) -> DataFrame:
    """Codes active in our table that the listing no longer has."""
    return active.select("code").distinct().join(by_shuffle(listing.select("code")), "code", "left_anti")


def active_codes(clean: DataFrame, status: str = "Publicada") -> DataFrame:
    return clean.filter(F.col("status") == status).select(F.col("tender_id").cast("string").alias("code")).distinct()


def pending_codes(
    listing: DataFrame, known: DataFrame, active: DataFrame, cap: int | None = None, attempts: DataFrame | None = None
) -> DataFrame:
    """Codes to query this run. With a ``cap`` those come first that were never tried, then those
    whose last try (``attempts``: code, last) is longest ago, so no code waits for ever."""
    pending = changed_or_new(listing, known).unionByName(vanished_codes(active, listing)).distinct()
    if cap is None:
        return pending
    if attempts is None:
        return pending.orderBy("code").limit(cap)
    tried = pending.join(by_shuffle(attempts), "code", "left")
    return tried.orderBy(F.col("last").asc_nulls_first(), "code").limit(cap).select("code")


@dataclass
class SyncResult:
    upserts: DataFrame
    processed: DataFrame
    counts: DataFrame


def sync_batch(listing: DataFrame, pending: DataFrame, details: DataFrame) -> SyncResult:
    """One sync step as DataFrames: flat rows to upsert, codes to mark known, counts.

    ``details`` has code, detail and failed. Failed codes and codes without a detail stay
    unmarked; codes outside the sector are marked but not stored. A processed code absent
    from the listing is marked gone.
    """
    answered = stored(pending.join(by_shuffle(details), "code"))
    found = answered.filter(~F.col("failed") & F.col("detail").isNotNull())
    wanted = found.filter(in_sector(F.col("detail.Comprador.NombreOrganismo")))
    upserts = to_offer_lines(flatten_details(wanted, renamed=False))
    states = listing.select("code", F.col("state").alias("_listed"))
    processed = (
        found.select("code").distinct().join(by_shuffle(states), "code", "left")
        .select("code", F.coalesce("_listed", F.lit(tables.GONE)).alias("state"))
    )
    counts = pending.agg(F.count("*").alias("n_queried")).select(
        listing.agg(F.count("*")).scalar().alias("n_listed"),
        "n_queried",
        upserts.agg(F.count("*")).scalar().alias("n_upserted"),
        answered.agg(F.count_if("failed")).scalar().alias("n_failed"),
    )
    return SyncResult(upserts, processed, counts)


@dataclass(frozen=True)
class SyncPaths:
    """Folders of one sync: landed details, the bulk table (read only), and the updates, states
    and log it keeps, the former in so many ``buckets`` from their first batch on."""

    details: str
    bulk: str
    updates: str
    state: str
    log: str
    buckets: int = segments.BUCKETS


def current_offers(spark: SparkSession, paths: SyncPaths, keep_bids: bool = False) -> DataFrame | None:
    """Bulk offer lines with the updates applied: an updated tender's lines are replaced
    by its update, or with ``keep_bids`` only its status is."""
    bulk, updates = tables.read_snapshot(spark, paths.bulk), segments.read_segments(spark, paths.updates, "tender_id")
    if bulk is None or updates is None:
        return updates if bulk is None else bulk
    return tables.overlay_offers(bulk, updates) if keep_bids else tables.upsert_by_key(bulk, updates, "tender_id")


def _active_now(spark: SparkSession, bulk: DataFrame | None, updates: DataFrame | None) -> DataFrame:
    """Active codes by their newest status; of the bulk only two columns are read."""
    active = spark.createDataFrame([], "code string")
    if updates is not None:
        active = active_codes(updates)
    if bulk is not None:
        listed = active_codes(bulk)
        if updates is not None:
            listed = listed.join(by_shuffle(updates.select(F.col("tender_id").alias("code"))), "code", "left_anti")
        active = active.unionByName(listed)
    return active


def _attempts(spark: SparkSession, paths: SyncPaths) -> DataFrame:
    found = segments.read_segments(spark, f"{paths.state}-attempts", "code")
    return spark.createDataFrame([], "code string, last long") if found is None else found.filter("last IS NOT NULL").select("code", "last")


def apply_listing(
    spark: SparkSession, listing: DataFrame, listing_id: str, paths: SyncPaths, cap: int | None = None, code_from_file: bool = True
) -> bool:
    """Run one listing against the stored tables; returns False when it was already done.

    The log row, which names the listing, is written last: a batch that died half-way is
    repeated, finds its own upserts and states, and logs once. Codes queried without an
    answer are kept with the number of the run, for the order under a ``cap``. Detail files are
    named after their codes, or hold one response a line with the code in it.
    """
    log = tables.read_log(spark, paths.log, "sync")
    if not log.filter(F.col("detail") == listing_id).isEmpty():
        return False
    with barriers(spark):
        listing = stored(listing)
        known, attempts = tables.read_state(spark, paths.state), _attempts(spark, paths)
        bulk, updates = tables.read_snapshot(spark, paths.bulk), segments.read_segments(spark, paths.updates, "tender_id")
        pending = stored(pending_codes(listing, known, _active_now(spark, bulk, updates), cap, attempts))
        result = sync_batch(listing, pending, read_tender_details(spark, paths.details, code_from_file, codes=pending))
        counts = result.counts.first()
        if counts["n_upserted"]:
            batch = result.upserts if updates is None else tables.project_common_columns(result.upserts, updates)
            segments.append_segment(batch, paths.updates, "tender_id", paths.buckets)
        run = log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        tried = pending.join(by_shuffle(result.processed), "code", "left_anti").select("code", F.lit(run).cast("long").alias("last"))
        answered = result.processed.join(by_shuffle(attempts), "code", "left_semi").select("code", F.lit(None).cast("long").alias("last"))
        segments.append_segment(tried.unionByName(answered), f"{paths.state}-attempts", "code", paths.buckets)
        segments.append_segment(result.processed, paths.state, "code", paths.buckets)
    for path, key in ((paths.updates, "tender_id"), (paths.state, "code"), (f"{paths.state}-attempts", "code")):
        segments.compact(spark, path, key)
    tables.append_run_log(spark, paths.log, "sync", {"state": "ok", "detail": listing_id, **counts.asDict()})
    return True


def start_sync(
    spark: SparkSession, listings: str, paths: SyncPaths, checkpoint: str, cap: int | None = None
) -> StreamingQuery:
    """Process the landed listings not seen yet, one file per micro-batch, then stop."""
    stream = (
        spark.readStream.schema(LISTING_FILE_SCHEMA).option("multiLine", True)
        .option("maxFilesPerTrigger", 1).json(listings)
        .select("*", F.concat_ws("@", "_metadata.file_path", "_metadata.file_modification_time").alias("_listing"))
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        # One file in a batch, so one name.
        name = batch.agg(F.max("_listing")).first()[0]
        if name is not None:
            apply_listing(batch.sparkSession, listing_codes(batch), name, paths, cap)

    return (
        stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
