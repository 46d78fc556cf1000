"""The composite scoring job: offer lines to scored tenders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tenderlens.config import BASE_FEATURES, DENSE_FEATURES, LEXICAL_FEATURES, ScoringSettings
from tenderlens.operators.embeddings import Encoder, embed_missing
from tenderlens.operators.forest import anomaly_column
from tenderlens.operators.graph import community_features
from tenderlens.operators.history import attach_history
from tenderlens.operators.rules import rule_score
from tenderlens.operators.score import combine_scores, score_summary
from tenderlens.operators.tenders import assemble_tenders, parse_timestamps, tier1_flags
from tenderlens.operators.text import (
    SIDE_A,
    SIDE_B,
    corpus,
    delta_similarity,
    dense_similarity,
    distinct_pairs,
    lexical_similarity,
    pair_lines,
    with_text_hashes,
)
from tenderlens.session import barriers, stored
from tenderlens.sources.tables import (
    append_embeddings,
    append_run_log,
    drop_old_versions,
    read_embeddings,
    read_snapshot,
    write_snapshot,
)


def tender_features(
    offers: DataFrame, row_order: Sequence[str], settings: ScoringSettings = ScoringSettings()
) -> DataFrame:
    """Tender rows with structural flags and history; no text, no graph.

    Tenders are stored before the history reads them, so offer lines are folded once.
    """
    offers = parse_timestamps(offers)
    tenders = tier1_flags(assemble_tenders(offers, row_order, settings.null_counts_as_bidder), settings.flags)
    return attach_history(stored(tenders), settings.history_order)


def attach_lexical(tenders: DataFrame, hashed: DataFrame, lines: DataFrame, settings: ScoringSettings) -> DataFrame:
    """TF-IDF similarity; ``lines`` are the stored pair counts of the hashed offers."""
    similarity = lexical_similarity(hashed, settings.text, distinct_pairs(lines))
    return tenders.join(delta_similarity(lines, similarity, "tfidf"), "tender_id", "left")


def attach_dense(
    tenders: DataFrame,
    hashed: DataFrame,
    lines: DataFrame,
    make_encoder: Callable[[], Encoder],
    model: str,
    cache_path: str | None = None,
    batch_size: int = 64,
) -> DataFrame:
    """Dense similarity through the encoder. New vectors are stored once, in the cache at
    ``cache_path`` when there is one, so a text is encoded in one run only."""
    spark = hashed.sparkSession
    texts = corpus(hashed).select("text_hash", "text")
    cache = read_embeddings(spark, cache_path, model)
    fresh = embed_missing(texts, cache, make_encoder, model, batch_size)
    if cache_path:
        append_embeddings(fresh, cache_path)
        vectors = read_embeddings(spark, cache_path, model)
    else:
        vectors = stored(fresh)
    similarity = dense_similarity(distinct_pairs(lines), vectors.select("text_hash", "embedding"))
    return tenders.join(delta_similarity(lines, similarity, "dense"), "tender_id", "left")


def score_tenders(
    offers: DataFrame,
    row_order: Sequence[str],
    settings: ScoringSettings = ScoringSettings(),
    make_encoder: Callable[[], Encoder] | None = None,
    model: str = "default",
    cache_path: str | None = None,
) -> DataFrame:
    """Offer lines to one scored row per tender.

    The plan is cut where several later steps read the same computed rows: once the first
    rule score exists (graph and forest both start from it), and before the final min-max.
    """
    features = [*BASE_FEATURES, *LEXICAL_FEATURES, *(DENSE_FEATURES if make_encoder else ())]
    tenders = tender_features(offers, row_order, settings)
    hashed = with_text_hashes(offers)
    # Offers are read for their texts once: what follows reads the texts and the counts off this table.
    hashed = stored(pair_lines(hashed, with_text=True))
    lines = hashed.drop(SIDE_A, SIDE_B)
    tenders = attach_lexical(tenders, hashed, lines, settings)
    if make_encoder is not None:
        tenders = attach_dense(tenders, hashed, lines, make_encoder, model, cache_path)
    first = stored(rule_score(tenders, settings.weights))
    anomaly = anomaly_column(first, features, settings.forest)
    ruled = rule_score(community_features(first, settings.graph), settings.weights)
    scored = stored(ruled.withColumn("anomaly", anomaly))
    return combine_scores(scored, settings.rules_share, settings.forest_share)


def run_scoring(
    spark: SparkSession,
    offers: DataFrame,
    row_order: Sequence[str],
    table_path: str,
    log_path: str,
    settings: ScoringSettings = ScoringSettings(),
    **encoder,
) -> dict:
    """Score, replace the scored table and log the run."""
    if offers.isEmpty():
        append_run_log(spark, log_path, "scoring", {"state": "no_data", "n_tenders": 0, "detail": ""})
        return {"state": "no_data", "n_tenders": 0}
    with barriers(spark):
        write_snapshot(score_tenders(offers, row_order, settings, **encoder), table_path)
    drop_old_versions(spark, table_path)
    dense = encoder.get("make_encoder") is not None
    n_features = len(BASE_FEATURES) + len(LEXICAL_FEATURES) + (len(DENSE_FEATURES) if dense else 0)
    summary = score_summary(read_snapshot(spark, table_path), n_features, dense).first().asDict()
    append_run_log(spark, log_path, "scoring", {
        "state": "ok", "n_tenders": summary["n_tenders"], "detail": str(summary),
    })
    return {"state": "ok", **summary}
