"""Buyer-supplier history as it stood before each tender (no look-ahead)."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.functions.scalars import ratio_or
from tenderlens.operators.selection import HOT_KEY_ROWS, hot_keys, running_positions
from tenderlens.session import barriers, spread, stored
from tenderlens.sources.periods import (
    PERIOD,
    drop_replaced,
    finish_run,
    live_periods,
    month_of,
    next_run,
    read_periods,
    write_periods,
)

PAIR = ("buyer_id", "winner_id")
SUPPLIER = ("winner_id",)
BUYER = ("buyer_id",)
PARTS = ("awards", "counts")


def _numbered(awards: DataFrame, order_by: str, hot_rows: int, within: Sequence[str] = ()) -> DataFrame:
    """Add ``prior_buyer``, ``prior_pair`` and ``prior_supplier``: earlier awards with the same ``within``."""
    order = [F.col(order_by).asc_nulls_first(), F.col("tender_id").asc()]
    hot_pair, hot_supplier, hot_buyer = hot_keys(awards, [(*within, *k) for k in (PAIR, SUPPLIER, BUYER)], hot_rows)
    numbered = running_positions(awards, (*within, *BUYER), order, "prior_buyer", hot_buyer)
    numbered = running_positions(numbered, (*within, *PAIR), order, "prior_pair", hot_pair)
    return running_positions(numbered, (*within, *SUPPLIER), order, "prior_supplier", hot_supplier)


def _with_shares(numbered: DataFrame) -> DataFrame:
    return numbered.select(
        "tender_id",
        "prior_pair",
        "prior_supplier",
        "prior_buyer",
        ratio_or(F.col("prior_pair"), F.col("prior_supplier"), 0.0).alias("supplier_share"),
        ratio_or(F.col("prior_pair"), F.col("prior_buyer"), 0.0).alias("buyer_share"),
    )


def prior_concentration(
    tenders: DataFrame, order_by: str = "published_at", hot_rows: int = HOT_KEY_ROWS
) -> DataFrame:
    """Per awarded tender: earlier awards of the pair, the supplier and the buyer, and
    the pair's share of each. Equal dates are ordered by tender.

    The narrow (tender, buyer, supplier, date) rows are stored once, as several steps read
    them, and numbered three times. The pair window reuses the buyer window's partitioning; keys above ``hot_rows`` leave the
    windows for a range layout.
    """
    awards = stored(
        tenders.filter(F.col("winner_id").isNotNull()).select("tender_id", "buyer_id", "winner_id", order_by)
    )
    return _with_shares(_numbered(awards, order_by, hot_rows))


def add_awards(
    tenders: DataFrame, path: str, order_by: str = "published_at", replaced: DataFrame | None = None,
    hot_rows: int = HOT_KEY_ROWS,
) -> list[int]:
    """Bring tenders into the stored history at ``path``; returns the periods (months) that were numbered anew.

    The history holds each award's number within its month, and how many awards each pair,
    supplier and buyer has in a month. So awards of a month, late ones included, change that
    month's files only: earlier months are neither read nor written, and later ones get what
    they need from the counts. A stored award of the same tender and month is replaced.
    ``replaced`` (tender_id and the old ``order_by``) names awards that moved to another
    month or are no more. A run that fails leaves the history as it was. Nothing happens
    where neither table has a row.
    """
    spark = tenders.sparkSession
    columns = ["tender_id", "buyer_id", "winner_id", order_by, PERIOD]
    with barriers(spark):
        fresh = stored(tenders.withColumn(PERIOD, month_of(order_by)).filter(F.col("winner_id").isNotNull()).select(*columns))
        gone, months = fresh.select("tender_id"), fresh.select(PERIOD)
        if replaced is not None:
            gone = gone.unionByName(replaced.select("tender_id"))
            months = months.unionByName(replaced.select(month_of(order_by)))
        touched = sorted(r[0] for r in months.distinct().collect())
        if not touched:
            return []
        live = live_periods(spark, path)
        drop_replaced(spark, path, PARTS, live)
        known = read_periods(spark, path, "awards", live, touched)
        every = fresh
        if known is not None:
            kept = known.select(*columns).join(stored(gone.distinct()), "tender_id", "left_anti")
            every = stored(kept.select(*columns).unionByName(fresh))
        run = next_run(spark, path, PARTS)
        write_periods(_numbered(every, order_by, hot_rows, (PERIOD,)), path, "awards", run)
        sets = [[PERIOD, *k] for k in (PAIR, SUPPLIER, BUYER)]
        counts = every.groupingSets(sets, PERIOD, *PAIR).agg(F.count("*").alias("n"), F.grouping_id().alias("of"))
        write_periods(counts, path, "counts", run)
        finish_run(spark, path, run, touched)
    return touched


def stored_concentration(spark: SparkSession, path: str, only: Collection[int] | None = None) -> DataFrame | None:
    """What ``prior_concentration`` gives for all awards brought in so far, or for those of some months; None before
    the first. Awards of other months are not read, only their counts: one row for each key and month, so a key's
    window over them is never longer than there are months."""
    live = live_periods(spark, path)
    awards, counts = (read_periods(spark, path, part, live, months) for part, months in (("awards", only), ("counts", None)))
    if awards is None:
        return None
    earlier = Window.partitionBy("of", *PAIR).orderBy(PERIOD).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.sum("n").over(earlier)).filter(F.col("before").isNotNull())
    if only is not None:
        before = before.filter(F.col(PERIOD).isin(list(only)))
    # Stored, so that each join has two shuffles of its own and a hot key's awards can be split.
    before = stored(before.select("of", PERIOD, *PAIR, "before"))
    for of, (name, keys) in {0: ("prior_pair", PAIR), 2: ("prior_supplier", SUPPLIER), 1: ("prior_buyer", BUYER)}.items():
        side = before.filter(F.col("of") == of).select(
            F.col(PERIOD).alias("_period"), *(F.col(k).alias(f"_{k}") for k in keys), F.col("before").alias("_before")
        )
        match = F.col(PERIOD) == F.col("_period")
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
        awards = awards.join(side, match, "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        awards = awards.drop("_period", "_before", *(f"_{k}" for k in keys))
    return _with_shares(awards)


def attach_history(tenders: DataFrame, order_by: str = "published_at", hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Tenders with their history; give it a stored table, it is read and counted."""
    return spread(tenders, tenders.count(), "tender_id").join(prior_concentration(tenders, order_by, hot_rows), "tender_id", "left")
