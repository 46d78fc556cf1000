"""Bulk ingestion: CSV folders to the clean offer-line table."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from tenderlens.config import CleaningRules
from tenderlens.operators.cleaning import CleaningMetrics, add_row_counts, clean_offers
from tenderlens.session import barriers, stored
from tenderlens.sources.columns import to_offer_lines, unreadable_numbers
from tenderlens.sources.offers_csv import MISFIT, ROW_ORDER, read_offers_csv
from tenderlens.sources.tables import append_run_log, drop_old_versions, write_snapshot


def ingest_offers(
    spark: SparkSession,
    folders: Sequence[str],
    table_path: str,
    log_path: str,
    rules: CleaningRules = CleaningRules(),
) -> CleaningMetrics | None:
    """Read, clean and replace the table, then log the run; None when there is no CSV.

    The typed files are stored as Parquet first, so the profile passes do not parse CSV
    again and read only the columns they need. The table has this package's column names
    and the row order column. Rows that don't fit their header and values that are no number
    are counted, and the counts are logged with the run, whose state is then ``with_losses``.
    """
    with barriers(spark):
        return _ingest(spark, folders, table_path, log_path, rules)


def _ingest(spark, folders, table_path, log_path, rules) -> CleaningMetrics | None:
    frames = [stored(f) for f in read_offers_csv(spark, folders)]
    if not frames:
        return None
    misfits = sum(f.agg(F.count(MISFIT)).first()[0] for f in frames)
    counts = Observation("clean_offers")
    clean, metrics = clean_offers([f.drop(MISFIT) for f in frames], rules, row_order=ROW_ORDER, observation=counts)
    clean = stored(clean)
    write_snapshot(to_offer_lines(clean), table_path)
    drop_old_versions(spark, table_path)
    add_row_counts(metrics, counts.get)
    unread = {c: n for c, n in unreadable_numbers(clean).first().asDict().items() if n and c != "n_rows"}
    losses = {"misfit_rows": misfits, "unreadable_numbers": unread}
    append_run_log(spark, log_path, "ingestion", {
        "state": "with_losses" if misfits or unread else "ok",
        "rows_in": metrics.rows_in,
        "rows_out": metrics.rows_out,
        "cols_dropped": len(metrics.dropped_columns),
        "dups": metrics.duplicate_keys,
        "zero_rows": metrics.zero_rows,
        "detail": json.dumps(losses) if misfits or unread else "",
    })
    return metrics
