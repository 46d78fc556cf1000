"""Offer lines to one row per tender, with structural flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.config import HEADER_COLUMNS, LOST, WON, FlagRules
from tenderlens.functions.scalars import (
    TIMESTAMP_FORMATS,
    days_between,
    is_sentinel,
    parse_timestamp,
    ratio_or,
)
from tenderlens.sources.columns import DATE_COLUMNS


def parse_timestamps(
    df: DataFrame,
    columns: Sequence[str] = DATE_COLUMNS,
    formats: Sequence[str] = TIMESTAMP_FORMATS,
) -> DataFrame:
    """Text date columns to timestamps; unreadable values become null."""
    texts = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    return df.withColumns({c: parse_timestamp(F.col(c), formats) for c in columns if c in texts})


def timestamp_failures(
    df: DataFrame, columns: Sequence[str] = DATE_COLUMNS, formats: Sequence[str] = TIMESTAMP_FORMATS
) -> DataFrame:
    """One row: per column, the texts that are neither sentinels nor readable dates."""
    return df.agg(*[
        F.count_if(~is_sentinel(F.col(c)) & parse_timestamp(F.col(c), formats).isNull()).alias(c)
        for c in columns
        if c in df.columns
    ])


def _distinct_counts(offers: DataFrame) -> DataFrame:
    """Per tender the different suppliers and items, and whether a line has none (0 or 1).

    Each line gives a row for its supplier and one for its item, and these are made distinct. Unlike two distinct counts
    in one aggregation this keeps offers that are partitioned by tender where they are.
    """
    no_supplier, no_item = (F.lit(None).cast(offers.schema[c].dataType) for c in ("supplier_id", "item_name"))
    sides = F.inline(F.array(
        F.struct(F.lit(True).alias("bid"), F.col("supplier_id").alias("supplier"), no_item.alias("item")),
        F.struct(F.lit(False).alias("bid"), no_supplier.alias("supplier"), F.col("item_name").alias("item")),
    ))
    return offers.select("tender_id", sides).distinct().groupBy("tender_id").agg(
        F.count("supplier").alias("bidders"),
        F.count("item").alias("items"),
        F.max((F.col("bid") & F.col("supplier").isNull()).cast("int")).alias("null_bidder"),
        F.max((~F.col("bid") & F.col("item").isNull()).cast("int")).alias("null_item"),
    )


def bid_metrics(offers: DataFrame, null_counts_as_bidder: bool = False) -> DataFrame:
    """Distinct bidders and items per tender. A line without a supplier is no bidder unless
    ``null_counts_as_bidder``; a line without an item still counts as one item."""
    bidders = F.col("bidders") + F.col("null_bidder") if null_counts_as_bidder else F.col("bidders")
    return _distinct_counts(offers).select(
        "tender_id", bidders.cast("long").alias("n_bidders"), (F.col("items") + F.col("null_item")).cast("long").alias("n_items")
    )


def assemble_tenders(
    offers: DataFrame,
    row_order: Sequence[str],
    null_counts_as_bidder: bool = False,
) -> DataFrame:
    """One row per tender: header of its first line, bid metrics, winner and losers.

    One conditional aggregation builds everything but the distinct counts. Those run on
    three narrow columns, so only these are doubled, and both sides
    are already partitioned by tender when they meet.
    """
    header = [c for c in HEADER_COLUMNS if c in offers.columns and c != "tender_id"]
    order = F.struct(*row_order)
    won = F.col("outcome") == WON
    lost_bid = F.when((F.col("outcome") == LOST) & (F.col("offer_total") > 0), F.col("offer_total"))
    winner = F.struct("supplier_id", "supplier_name", "supplier_size", "supplier_activity")

    wide = offers.groupBy("tender_id").agg(
        F.min_by(F.struct(*header), order).alias("header"),
        F.coalesce(F.sum("item_qty"), F.lit(0.0)).alias("total_qty"),
        F.min_by(F.when(won, winner), F.when(won, order)).alias("winner"),
        F.when(F.count_if(won) > 0, F.coalesce(F.sum(F.when(won, F.col("offer_total"))), F.lit(0.0)))
        .alias("awarded_amount"),
        F.min(lost_bid).alias("runner_up_amount"),
        F.avg(lost_bid).alias("losing_mean_amount"),
    )
    counts = _distinct_counts(offers)
    bidders = F.col("bidders") + F.col("null_bidder") if null_counts_as_bidder else F.col("bidders")
    return wide.join(counts, "tender_id", "left").select(
        "tender_id",
        *[F.col("header")[c].alias(c) for c in header],
        bidders.cast("long").alias("n_bidders"),
        (F.col("items") + F.col("null_item")).cast("long").alias("n_items"),
        "total_qty",
        F.col("winner.supplier_id").alias("winner_id"),
        F.col("winner.supplier_name").alias("winner_name"),
        F.col("winner.supplier_size").alias("winner_size"),
        F.col("winner.supplier_activity").alias("winner_activity"),
        "awarded_amount",
        "runner_up_amount",
        "losing_mean_amount",
    )


def tier1_flags(tenders: DataFrame, rules: FlagRules = FlagRules()) -> DataFrame:
    """Durations, calendar parts, ratio, margin and the seven structural 0/1 flags."""
    amount, estimate = F.col("awarded_amount"), F.col("estimate")
    published = F.col("published_at")
    ratio = F.when(
        (F.col("estimate_visible") == rules.visible_value) & (estimate > 0), amount / estimate
    )
    return (
        tenders.withColumns({
            "days_open": days_between(F.col("closed_at"), published),
            "days_to_award": days_between(F.col("awarded_at"), F.col("closed_at")),
            "pub_weekday": F.weekday(published) + 1,
            "pub_month": F.month(published),
            "pub_year": F.year(published),
            "award_ratio": ratio,
            "runner_up_margin": F.when(
                F.col("runner_up_amount").isNotNull(),
                ratio_or(F.col("runner_up_amount") - amount, amount, None),
            ),
        })
        .withColumns({
            "single_bidder": (F.col("n_bidders") == 1).cast("int"),
            "short_window": (F.col("days_open") < rules.short_window_days).cast("int"),
            "express_evaluation": (F.col("days_to_award") < rules.express_days).cast("int"),
            "weekend_publication": (F.col("pub_weekday") >= 6).cast("int"),
            "round_amount": F.when(amount > 0, (amount % rules.round_step == 0).cast("int")).otherwise(0),
            "ratio_near_one": F.when(
                F.col("award_ratio").between(rules.ratio_low, rules.ratio_high), 1
            ).otherwise(0),
            "empty_justification": is_sentinel(F.col("justification")).cast("int"),
        })
    )
