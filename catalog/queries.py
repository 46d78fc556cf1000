"""One registered query per operator: ``name -> f(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import bindings as b
from tenderlens.config import BASE_FEATURES, TIER1_FLAGS, CleaningRules
from tenderlens.functions.scalars import half_up, parse_timestamp
from tenderlens.functions.text import text_hash
from tenderlens.operators import cleaning, embeddings, forest, graph, history, reports, rules, score, selection, tenders, text
from tenderlens.plans.score_job import score_tenders
from tenderlens.session import stored
from tenderlens.sources import tables, tender_json
from tenderlens.streaming import sync

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Events are split into what was known before this moment and what is listed from it on.
LISTED_FROM = "2024-01-29 00:00:00"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: half_up(F.col(c), digits) for c in columns})


# --- tenders -----------------------------------------------------------------------------


@query
def tender_assembly(spark, sf):
    built = tenders.assemble_tenders(b.offer_lines(spark, sf), b.ROW_ORDER)
    return rounded(built, "losing_mean_amount")


@query
def bidders_counting_null(spark, sf):
    return tenders.bid_metrics(b.offer_lines(spark, sf), null_counts_as_bidder=True)


@query
def parse_timestamps(spark, sf):
    o = b.table(spark, sf, "orders")
    as_text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).when(
        F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    ).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return tenders.parse_timestamps(o.select("o_orderkey", as_text.alias("published_at")), ["published_at"])


@query
def timestamp_failures(spark, sf):
    o = b.table(spark, sf, "orders")
    as_text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    )
    return tenders.timestamp_failures(o.select(as_text.alias("published_at")), ["published_at"])


@query
def tier1_flags(spark, sf):
    built = tenders.assemble_tenders(b.offer_lines(spark, sf), b.ROW_ORDER)
    flagged = tenders.tier1_flags(built, b.SETTINGS.flags).select(
        "tender_id", "days_open", "days_to_award", "pub_weekday", "pub_month", "pub_year",
        "award_ratio", "runner_up_margin", *TIER1_FLAGS,
    )
    return rounded(flagged, "days_open", "days_to_award", "award_ratio", "runner_up_margin")


@query
def prior_concentration(spark, sf):
    built = tenders.assemble_tenders(b.offer_lines(spark, sf), b.ROW_ORDER)
    return rounded(history.prior_concentration(built), "supplier_share", "buyer_share")


@query
def prior_concentration_hot_keys(spark, sf):
    """The same numbers with most keys sent down the range layout."""
    built = tenders.assemble_tenders(b.offer_lines(spark, sf), b.ROW_ORDER)
    return rounded(history.prior_concentration(built, hot_rows=50), "supplier_share", "buyer_share")


@query
def rule_score(spark, sf):
    ruled = rules.rule_score(b.features(spark, sf), b.SETTINGS.weights)
    return ruled.select("tender_id", *[f for f in TIER1_FLAGS], "flag_captive_supplier", "flag_intense_relation", "rule_score")


@query
def rule_score_community(spark, sf):
    """Second pass of the rule score, with community features from the nation's region."""
    first = stored(rules.rule_score(b.features(spark, sf), b.SETTINGS.weights))
    placed = graph.attach_community_features(first, b.region_communities(spark, sf))
    again = rules.rule_score(placed, b.SETTINGS.weights)
    return again.select("tender_id", "community_id", "flag_hot_community", "rule_score")


# --- read queries --------------------------------------------------------------------------


@query
def institution_ranking(spark, sf):
    return reports.institution_ranking(b.scored(spark, sf))


@query
def pair_ranking(spark, sf):
    return reports.pair_ranking(b.scored(spark, sf))


@query
def pair_ranking_by_id(spark, sf):
    return reports.pair_ranking(b.scored(spark, sf), by_id=True)


@query
def network_edges(spark, sf):
    return reports.network_edges(b.scored(spark, sf))


@query
def network_nodes(spark, sf):
    return reports.network_nodes(reports.network_edges(b.scored(spark, sf)))


@query
def top_communities(spark, sf):
    return graph.top_communities(reports.network_nodes(reports.network_edges(b.scored(spark, sf))), keep=3)


PAGE = ("tender_id", "institution", "winner_name", "awarded_amount", "n_bidders", "risk_score")


@query
def ranked_page(spark, sf):
    kept = reports.optional_filters(b.scored(spark, sf), institution="nation_1", min_score=20.0)
    return reports.ranked_page(kept, limit=50, offset=10).select(*PAGE)


@query
def ranked_page_year(spark, sf):
    kept = reports.optional_filters(b.scored(spark, sf), year=1998, active_only=False)
    return reports.ranked_page(kept, limit=500).select(*PAGE)


@query
def reverse_page(spark, sf):
    page = reports.ranked_page(reports.optional_filters(b.scored(spark, sf)), limit=8)
    return reports.reverse_page(page).select(*PAGE)


@query
def raw_page(spark, sf):
    lines = b.offer_lines(spark, sf)
    page = reports.raw_page(lines, ["tender_id", *b.ROW_ORDER], institution="NATION_2%", year=1997, limit=100, offset=20)
    return page.select("tender_id", "line_no", "supplier_id", "offer_total")


@query
def filtered_count(spark, sf):
    return reports.filtered_count(reports.optional_filters(b.scored(spark, sf), min_score=50.0))


@query
def page_count(spark, sf):
    return reports.page_count(reports.optional_filters(b.scored(spark, sf)))


@query
def point_lookup(spark, sf):
    return reports.point_lookup(b.scored(spark, sf), "tender_id", 77).select(*PAGE)


@query
def risk_bands(spark, sf):
    return b.scored(spark, sf).select("tender_id", "risk_score", reports.risk_band().alias("band"))


@query
def active_flags(spark, sf):
    return reports.active_flags(b.scored(spark, sf)).withColumn("flags", F.array_join("flags", "|"))


@query
def flag_badges(spark, sf):
    return reports.flag_badges(b.scored(spark, sf)).withColumn("badges", F.array_join("badges", "|"))


@query
def highlights(spark, sf):
    return reports.detail_highlights(b.scored(spark, sf))


@query
def labels(spark, sf):
    return reports.display_labels(b.scored(spark, sf), prefix="NATION_", size=12)


@query
def page_kpis(spark, sf):
    return reports.page_kpis(reports.optional_filters(b.scored(spark, sf), active_only=False))


@query
def json_safe_records(spark, sf):
    df = b.scored(spark, sf).select(
        "tender_id",
        "published_at",
        F.when(F.col("n_bidders") == 1, float("nan")).when(F.col("n_bidders") == 2, float("inf"))
        .otherwise(F.col("risk_score")).alias("shaky"),
        "runner_up_amount",
        "winner_name",
    )
    fields = "tender_id long, published_at string, shaky double, runner_up_amount double, winner_name string"
    return reports.json_safe_records(df).select(F.from_json("record", fields).alias("r")).select("r.*")


@query
def last_runs(spark, sf):
    """The newest rows of a log: here the events."""
    log = b.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("run_at"), "event_type")
    return reports.last_runs(log)


# --- cleaning ------------------------------------------------------------------------------


@query
def union_by_name(spark, sf):
    return cleaning.union_by_name(b.raw_frames(spark, sf))


@query
def null_profile(spark, sf):
    profile = cleaning.null_profile(cleaning.union_by_name(b.raw_frames(spark, sf)))
    return rounded(profile, "null_pct")


@query
def drop_sparse_columns(spark, sf):
    return cleaning.drop_sparse_columns(cleaning.union_by_name(b.raw_frames(spark, sf)))


@query
def impute_nulls(spark, sf):
    return cleaning.impute_nulls(cleaning.drop_sparse_columns(b.raw_frames(spark, sf)[0]))


@query
def drop_duplicates(spark, sf):
    df = cleaning.drop_sparse_columns(cleaning.union_by_name(b.raw_frames(spark, sf)))
    return cleaning.drop_duplicate_rows(df, "NroLicitacion")


@query
def duplicate_keys(spark, sf):
    return cleaning.duplicate_key_count(cleaning.union_by_name(b.raw_frames(spark, sf)), "NroLicitacion")


@query
def retype_text(spark, sf):
    return cleaning.retype_numeric_text(b.raw_frames(spark, sf)[0])


@query
def exclude_zero_amounts(spark, sf):
    typed = cleaning.retype_numeric_text(b.raw_frames(spark, sf)[0])
    return cleaning.exclude_zero_amounts(typed, CleaningRules().amount_columns)


@query
def clean_offers(spark, sf):
    return cleaning.clean_offers(b.raw_frames(spark, sf), with_metrics=False)[0]


@query
def clean_metrics(spark, sf):
    m = cleaning.clean_offers(b.raw_frames(spark, sf))[1].to_df(spark)
    return m.select(
        "rows_in", "columns_in", F.array_join("dropped_columns", "|").alias("dropped"),
        F.col("numeric_imputed")["CantidadItem"].alias("median_qty"),
        F.array_join("text_imputed", "|").alias("text_imputed"), F.array_join("date_imputed", "|").alias("date_imputed"),
        "duplicate_keys", F.array_join("retyped_columns", "|").alias("retyped"), "zero_rows", "rows_out", "columns_out",
    )


@query
def exact_medians(spark, sf):
    """Medians by bracket narrowing: the buffers are kept far below the row count."""
    df = b.table(spark, sf, "lineitem")
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    found = selection.exact_quantiles(df, names, direct_limit=500, accuracy=200)
    return df.limit(1).select(*[F.lit(found[c]).alias(c) for c in names])


# --- text ----------------------------------------------------------------------------------


@query
def tfidf_vocab(spark, sf):
    texts = text.corpus(text.with_text_hashes(b.text_lines(spark, sf)))
    vocabulary = text.fit_vocabulary(texts, b.SETTINGS.text)
    return rounded(vocabulary.select("term_id", "term", "n_texts", "occurrences", "idf"), "idf")


@query
def tfidf_pair_similarity(spark, sf):
    hashed = text.with_text_hashes(b.text_lines(spark, sf))
    return rounded(text.lexical_similarity(hashed, b.SETTINGS.text), "similarity")


@query
def delta_similarity(spark, sf):
    hashed = text.with_text_hashes(b.text_lines(spark, sf))
    # Read twice, and far smaller than the texts it is made of.
    lines = stored(text.pair_lines(hashed))
    similarity = text.lexical_similarity(hashed, b.SETTINGS.text, text.distinct_pairs(lines))
    deltas = text.delta_similarity(lines, similarity, "tfidf")
    return rounded(deltas, "sim_won_tfidf", "sim_lost_tfidf", "delta_sim_tfidf")


@query
def text_hashes(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", text_hash(F.col("text")).alias("text_hash"))


def _documents(spark, sf):
    docs = b.table(spark, sf, "documents")
    return docs.select(text_hash(F.col("text")).alias("text_hash"), "text", "lang")


def _english_cache(spark, sf):
    known = _documents(spark, sf).filter(F.col("lang") == "en").select("text_hash").distinct()
    return known.select("text_hash", F.lit("m").alias("model"), F.array(F.lit(1.0).cast("float")).alias("embedding"))


@query
def cache_probe(spark, sf):
    texts = _documents(spark, sf).select("text_hash").distinct()
    cache = _english_cache(spark, sf)
    hits = embeddings.cache_hits(texts, cache, "m").select("text_hash", F.lit(True).alias("hit"))
    return hits.unionByName(embeddings.cache_misses(texts, cache, "m").select("text_hash", F.lit(False).alias("hit")))


@query
def embed_missing(spark, sf):
    """New vectors for the texts the cache lacks, from a small stand-in encoder that counts letters."""

    def letter_encoder():
        letters = "abcdefghijklmnopqrstuvwxyz"

        def count(texts):
            lines = pd.Series(texts).str.lower()
            return np.stack([lines.str.count(c) for c in letters], axis=1).astype(np.float32)

        return count

    docs = _documents(spark, sf)
    texts = docs.groupBy("text_hash").agg(F.first("text").alias("text"))
    return embeddings.embed_missing(texts, _english_cache(spark, sf), letter_encoder, "m")


@query
def dense_similarity(spark, sf):
    vectors = b.table(spark, sf, "embeddings")
    stored = vectors.select(F.col("vec_id").cast("string").alias("text_hash"), "embedding")
    pairs = vectors.select(
        F.col("vec_id").cast("string").alias("a_hash"), (F.col("vec_id") + 1).cast("string").alias("b_hash")
    )
    return rounded(text.dense_similarity(pairs, stored), "similarity")


@query
def delta_similarity_dense(spark, sf):
    vectors = b.table(spark, sf, "embeddings")
    stored = vectors.select(F.col("vec_id").cast("string").alias("text_hash"), "embedding")
    lines = vectors.select(
        F.col("label").alias("tender_id"),
        F.when(F.col("vec_id") % 3 == 0, "won").otherwise("lost").alias("outcome"),
        F.col("vec_id").cast("string").alias("a_hash"), (F.col("vec_id") + 1).cast("string").alias("b_hash"),
    )
    similarity = text.dense_similarity(text.distinct_pairs(lines), stored)
    deltas = text.delta_similarity(text.pair_lines(lines), similarity, "dense")
    return rounded(deltas, "sim_won_dense", "sim_lost_dense", "delta_sim_dense")


# --- graph ---------------------------------------------------------------------------------


@query
def pair_edges(spark, sf):
    return rounded(graph.pair_edges(b.scored(spark, sf)), "mean_score")


@query
def graph_edges(spark, sf):
    return rounded(graph.graph_edges(graph.pair_edges(b.scored(spark, sf))), "score")


@query
def graph_vertices(spark, sf):
    return graph.graph_vertices(graph.pair_edges(b.scored(spark, sf)))


@query
def graph_summary(spark, sf):
    summary = graph.graph_summary(graph.graph_edges(graph.pair_edges(b.scored(spark, sf))))
    return rounded(summary, "density")


@query
def community_stats(spark, sf):
    stats = graph.community_stats(b.scored(spark, sf))
    return rounded(stats, "community_mean_score", "community_single_bidder_rate")


@query
def communities(spark, sf):
    """Communities of the customer-supplier graph (customers as buyers)."""
    built = tenders.assemble_tenders(b.offer_lines(spark, sf, buyer="customer"), b.ROW_ORDER)
    edges = graph.graph_edges(graph.pair_edges(built, "awarded_amount"))
    return graph.communities(stored(edges), b.SETTINGS.graph)


@query
def number_by_size(spark, sf):
    """Group numbering by size on known groups: customers by nation and segment."""
    member = b.table(spark, sf, "customer").select(
        F.concat(F.lit("I:"), "c_custkey").alias("id"),
        F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("comm"),
        F.col("c_custkey").alias("rank"),
    )
    return graph.number_by_size(member)


# --- forest and final score -------------------------------------------------------------------


@query
def split_impute_scale(spark, sf):
    split = forest.temporal_split(b.features(spark, sf), b.SETTINGS.forest.cut_year)
    split = stored(split.select("tender_id", "split", *BASE_FEATURES))
    scaling = forest.fit_scaling(split.filter(F.col("split") == "train"), BASE_FEATURES)
    return rounded(forest.scale(split, scaling), *BASE_FEATURES)


@query
def isolation_scores(spark, sf):
    built = stored(b.features(spark, sf).select("tender_id", "published_at", *BASE_FEATURES))
    return forest.isolation_scores(built, BASE_FEATURES, b.SETTINGS.forest)


@query
def anomaly_rate(spark, sf):
    return forest.anomaly_rate(stored(isolation_scores(spark, sf)), b.SETTINGS.forest.contamination)


@query
def combined_score(spark, sf):
    """The combination with the losers' mean bid standing in for the anomaly score."""
    ruled = rules.rule_score(b.features(spark, sf), b.SETTINGS.weights)
    inputs = stored(ruled.select("tender_id", "rule_score", F.col("runner_up_amount").alias("anomaly")))
    combined = score.combine_scores(inputs)
    return rounded(combined.select("tender_id", "rule_part", "anomaly_part", "risk_score"), "rule_part", "anomaly_part")


@query
def score_contributions(spark, sf):
    return rounded(score.score_contributions(b.scored(spark, sf)), "rule_points", "anomaly_points")


@query
def score_summary(spark, sf):
    return rounded(score.score_summary(b.scored(spark, sf), 11, False), "mean_score")


@query
def score_tenders_full(spark, sf):
    """The whole job: features, text, graph, forest, final score."""
    offers = b.offer_lines(spark, sf, with_text=True)
    return score_tenders(offers, b.ROW_ORDER, b.SETTINGS).select(
        "tender_id", "rule_score", "community_id", "delta_sim_tfidf", "anomaly", "risk_score"
    )


# --- incremental -----------------------------------------------------------------------------


def _known(spark, sf):
    seen = b.code_events(spark, sf).filter(F.col("ts") < F.lit(LISTED_FROM).cast("timestamp"))
    return tender_json.latest_per_key(seen, "code", ["ts", "event_id"]).select("code", "state")


def _listing(spark, sf):
    seen = b.code_events(spark, sf).filter(F.col("ts") >= F.lit(LISTED_FROM).cast("timestamp"))
    return tender_json.latest_per_key(seen, "code", ["ts", "event_id"]).select("code", "state")


@query
def latest_per_key(spark, sf):
    return tender_json.latest_per_key(b.code_events(spark, sf), "code", ["ts", "event_id"])


@query
def active_listing(spark, sf):
    """Listing payloads, one per day, reduced to the last entry of each code."""
    entry = F.struct(F.when(F.col("state") != 4, F.col("code")).alias("CodigoExterno"), F.col("state").alias("CodigoEstado"))
    payloads = b.code_events(spark, sf).select("event_id", F.array(entry).alias("Listado"))
    return tender_json.listing_codes(payloads.withColumnRenamed("event_id", "_order"))


@query
def changed_codes(spark, sf):
    return sync.changed_or_new(_listing(spark, sf), _known(spark, sf))


@query
def vanished_codes(spark, sf):
    return sync.vanished_codes(_known(spark, sf), _listing(spark, sf))


@query
def pending_codes(spark, sf):
    return sync.pending_codes(_listing(spark, sf), _known(spark, sf), _known(spark, sf))


@query
def state_advance(spark, sf):
    return tables.advance_state(_known(spark, sf), _listing(spark, sf))


@query
def upsert_by_key(spark, sf):
    orders = b.table(spark, sf, "orders")
    target = orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    batch = orders.filter(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp")).select(
        "o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"),
        F.col("o_custkey").alias("unknown"),
    )
    return tables.upsert_by_key(target, batch, "o_orderkey")


@query
def overlay_offers(spark, sf):
    lines = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("tender_id"), F.col("l_linenumber").alias("line_no"), F.lit("old").alias("status"),
        F.col("l_quantity").alias("item_qty"),
    )
    updates = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("tender_id"), F.col("o_orderstatus").alias("status"))
    return tables.overlay_offers(lines, updates)


@query
def flatten_details(spark, sf):
    parsed = tender_json.parse_details(b.detail_payloads(spark, sf), "payload")
    return tender_json.flatten_details(parsed)


@query
def detail_items(spark, sf):
    """All lines of the nested details, numbered; a detail without lines stays."""
    parsed = tender_json.parse_details(b.detail_payloads(spark, sf), "payload")
    return tender_json.detail_items(parsed)


@query
def sector_filter(spark, sf):
    parsed = tender_json.parse_details(b.detail_payloads(spark, sf), "payload")
    kept = parsed.filter(tender_json.in_sector(F.col("detail.Comprador.NombreOrganismo"), "DE AUTOMOBILE"))
    return tender_json.flatten_details(kept).select("tender_id", "institution")


@query
def event_json(spark, sf):
    """Scalar JSON of the events, parsed and averaged per type."""
    parsed = b.table(spark, sf, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return parsed.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"))


@query
def days_with_events(spark, sf):
    """The daily partitions a sync would write, with their rows."""
    days = b.table(spark, sf, "events").select(F.to_date("ts").alias("day"))
    return days.groupBy("day").agg(F.count("*").alias("n_rows"))
