"""Read queries over the scored table: pages, rankings, network, labels, KPIs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tenderlens.config import TIER1_FLAGS
from tenderlens.functions.scalars import (
    half_up,
    in_billions,
    in_millions,
    money_label,
    short_institution,
    truncate_label,
)
from tenderlens.operators.graph import buyer_node, supplier_node

PAGE_LIMIT = 500
HIGH_RISK = 70

# Display labels of the flags.
FLAG_LABELS = {
    "single_bidder": "Oferente único",
    "short_window": "Plazo corto",
    "express_evaluation": "Eval. express",
    "weekend_publication": "Pub. finde",
    "round_amount": "Monto redondo",
    "ratio_near_one": "Ratio ≈ 1",
    "empty_justification": "Just. vacía",
}
BADGE_LABELS = {
    "single_bidder": "Oferente único",
    "short_window": "Plazo corto",
    "flag_captive_supplier": "Proveedor cautivo",
    "flag_tailored_spec": "Bases dirigidas",
    "ratio_near_one": "Ratio ≈ 1",
}


# --- filters and pages ----------------------------------------------------------------


def optional_filters(
    df: DataFrame,
    institution: str | None = None,
    year: int | None = None,
    min_score: float | None = None,
    active_only: bool = True,
    active_status: str = "Publicada",
) -> DataFrame:
    """AND of the given filters. Wildcards in ``institution`` keep their LIKE meaning; an
    empty institution or a zero year filters nothing."""
    tests = []
    if institution:
        tests.append(F.col("institution").ilike(f"%{institution}%"))
    if year:
        tests.append(F.col("pub_year") == year)
    if min_score is not None:
        tests.append(F.col("risk_score") >= min_score)
    if active_only:
        tests.append(F.col("status") == active_status)
    return reduce(lambda d, t: d.filter(t), tests, df)


def filtered_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def ranked_page(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Riskiest first, ties by tender; a top-k plan, not a full sort."""
    if not 0 <= limit <= PAGE_LIMIT or offset < 0:
        raise ValueError(f"limit must be 0..{PAGE_LIMIT} and offset >= 0")
    return df.orderBy(F.desc_nulls_last("risk_score"), F.asc("tender_id")).offset(offset).limit(limit)


def raw_page(
    offers: DataFrame, row_order: list[str], institution: str | None = None, year: int | None = None,
    limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of clean offer lines in row order."""
    if not 0 <= limit <= PAGE_LIMIT or offset < 0:
        raise ValueError(f"limit must be 0..{PAGE_LIMIT} and offset >= 0")
    if institution:
        offers = offers.filter(F.col("institution").ilike(f"%{institution}%"))
    if year:
        offers = offers.filter(F.year("published_at") == year)
    return offers.orderBy(*row_order).offset(offset).limit(limit)


def reverse_page(page: DataFrame) -> DataFrame:
    """The rows of one displayed page, least risky first."""
    return page.orderBy(F.asc_nulls_first("risk_score"), F.desc("tender_id"))


def page_count(df: DataFrame, page_size: int = 8, block: int = 10) -> DataFrame:
    """Number of pages (at least one) and of page blocks."""
    pages = F.greatest(F.ceil(F.count("*") / page_size), F.lit(1))
    return df.agg(pages.alias("n_pages")).withColumn("n_blocks", F.ceil(F.col("n_pages") / block))


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value).limit(1)


def last_runs(log: DataFrame, n: int = 10) -> DataFrame:
    return log.orderBy(F.desc("run_at"), F.desc("id")).limit(n)


def json_safe_records(df: DataFrame) -> DataFrame:
    """One JSON string per row: ISO timestamps, no NaN or infinity, nulls kept."""

    def safe(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        return c

    fields = F.struct(*[safe(f).alias(f.name) for f in df.schema])
    return df.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("record"))


# --- per-tender labels -----------------------------------------------------------------


def risk_band(score: str = "risk_score"):
    s = F.col(score)
    return F.when(s >= 80, "high").when(s >= 60, "medium").otherwise("low")


def _active(column: str):
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0)) != 0


def active_flags(df: DataFrame) -> DataFrame:
    """Labels of the active structural flags, their number and percent of seven."""
    labels = F.array_compact(F.array(*[F.when(_active(f), F.lit(FLAG_LABELS[f])) for f in TIER1_FLAGS]))
    return df.select("tender_id", labels.alias("flags")).withColumns({
        "n_flags": F.size("flags"),
        "flags_pct": F.floor(F.size("flags") * 100.0 / len(TIER1_FLAGS) + 0.5),
    })


def flag_badges(df: DataFrame, shown: int = 2) -> DataFrame:
    """First badges of each tender and how many more there are."""
    known = {c: label for c, label in BADGE_LABELS.items() if c in df.columns}
    labels = F.array_compact(F.array(*[F.when(_active(c), F.lit(label)) for c, label in known.items()]))
    return df.select("tender_id", labels.alias("_all")).select(
        "tender_id",
        F.slice("_all", 1, shown).alias("badges"),
        F.greatest(F.size("_all") - shown, F.lit(0)).alias("n_more"),
    )


def detail_highlights(df: DataFrame) -> DataFrame:
    """Which key figures of a tender deserve a warning."""
    def yes(test):
        return F.coalesce(test, F.lit(False))

    share = F.col("supplier_share")
    marks = {
        "one_bidder": F.col("n_bidders") == 1,
        "few_days": F.col("days_open") < 5,
        "high_ratio": F.col("award_ratio") >= 0.98,
        "captive": share > 0.8,
        "nearly_captive": (share > 0.6) & (share <= 0.8),
    }
    if "delta_sim_tfidf" in df.columns:
        marks["copied_text"] = F.col("delta_sim_tfidf") > 0.3
    return df.select("tender_id", *[yes(t).alias(name) for name, t in marks.items()])


def display_labels(df: DataFrame, prefix: str = "Municipalidad de ", size: int = 22) -> DataFrame:
    return df.select(
        "tender_id",
        short_institution(F.col("institution"), prefix).alias("institution_short"),
        truncate_label(F.col("winner_name"), size).alias("supplier_short"),
        F.substring("institution", 1, 50).alias("node_label"),
        in_millions(F.col("awarded_amount")).alias("amount_millions"),
        in_billions(F.col("awarded_amount")).alias("amount_billions"),
        money_label(F.col("awarded_amount")).alias("amount_label"),
    )


def page_kpis(page: DataFrame) -> DataFrame:
    """Counts of high scores, single bidders and captive suppliers over the given rows."""
    rows = F.count("*")

    def pct(n):
        return F.when(rows > 0, F.floor(n * 100.0 / rows + 0.5)).otherwise(0)

    high = F.count_if(F.col("risk_score") >= HIGH_RISK)
    single = F.count_if(F.col("single_bidder") == 1)
    return page.agg(
        rows.alias("n_rows"),
        high.alias("n_high"),
        pct(high).alias("pct_high"),
        single.alias("n_single_bidder"),
        pct(single).alias("pct_single_bidder"),
        F.count_if(F.col("flag_captive_supplier") > 0).alias("n_captive"),
    )


# --- rankings and network ----------------------------------------------------------------


def institution_ranking(scored: DataFrame, min_tenders: int = 10) -> DataFrame:
    return (
        scored.groupBy("institution")
        .agg(
            F.count("*").alias("n_tenders"),
            half_up(F.avg("risk_score"), 1).alias("mean_score"),
            F.count_if(F.col("risk_score") >= HIGH_RISK).alias("n_high"),
            half_up(F.avg("single_bidder") * 100, 1).alias("pct_single_bidder"),
            half_up(F.avg("short_window") * 100, 1).alias("pct_short_window"),
        )
        .filter(F.col("n_tenders") >= min_tenders)
        .orderBy(F.desc("mean_score"), F.asc("institution"))
    )


def pair_ranking(scored: DataFrame, min_awards: int = 5, by_id: bool = False) -> DataFrame:
    """Institution-supplier pairs by score. Labels make the group, as the screen shows
    them; ``by_id`` groups by the identifiers and takes a label of each."""
    aggregates = [
        F.count("*").alias("n_awards"),
        F.sum("awarded_amount").alias("amount"),
        half_up(F.avg("risk_score"), 1).alias("mean_score"),
        half_up(F.max("supplier_share"), 3).alias("share"),
    ]
    won = scored.filter(F.col("winner_id").isNotNull())
    if by_id:
        grouped = won.groupBy("buyer_id", "winner_id").agg(
            F.min_by("institution", "tender_id").alias("institution"),
            F.min_by("winner_name", "tender_id").alias("supplier"),
            *aggregates,
        )
    else:
        grouped = won.groupBy("institution", F.col("winner_name").alias("supplier")).agg(*aggregates)
    return grouped.filter(F.col("n_awards") >= min_awards).orderBy(
        F.desc("mean_score"), F.desc("n_awards"), F.asc("institution"), F.asc("supplier")
    )


def network_edges(scored: DataFrame, min_awards: int = 3, limit: int = 200, by_id: bool = False) -> DataFrame:
    """Most awarded buyer-supplier edges; ties by node id, then label."""
    if not 10 <= limit <= 1000:
        raise ValueError("limit must be 10..1000")
    known = scored.filter(F.col("winner_id").isNotNull() & F.col("buyer_id").isNotNull())
    aggregates = [
        F.count("*").alias("n_awards"),
        F.sum("awarded_amount").alias("amount"),
        half_up(F.avg("risk_score"), 1).alias("mean_score"),
        F.max("community_id").alias("community_id"),
    ]
    if by_id:
        grouped = known.groupBy("buyer_id", "winner_id").agg(
            F.min_by("institution", "tender_id").alias("buyer_label"),
            F.min_by("winner_name", "tender_id").alias("supplier_label"),
            *aggregates,
        )
    else:
        grouped = known.groupBy(
            "buyer_id", F.col("institution").alias("buyer_label"),
            "winner_id", F.col("winner_name").alias("supplier_label"),
        ).agg(*aggregates)
    return (
        grouped.filter(F.col("n_awards") >= min_awards)
        .orderBy(
            F.desc("n_awards"), F.asc("buyer_id"), F.asc("winner_id"),
            F.asc("buyer_label"), F.asc("supplier_label"),
        )
        .limit(limit)
        .select(
            buyer_node(F.col("buyer_id")).alias("source"),
            supplier_node(F.col("winner_id")).alias("target"),
            "buyer_label", "supplier_label", "n_awards",
            F.coalesce("amount", F.lit(0.0)).alias("amount"),
            F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"),
            "community_id",
        )
    )


def network_nodes(edges: DataFrame) -> DataFrame:
    """Nodes of the kept edges (at most a thousand): label and community come from a node's
    first edge in ranking order, suppliers carry no community, degree sums the awards."""
    ranked = edges.withColumn("_rank", F.row_number().over(Window.orderBy(
        F.desc("n_awards"), F.asc("source"), F.asc("target"), F.asc("buyer_label"), F.asc("supplier_label")
    )))
    sides = F.inline(F.array(
        F.struct(F.col("source").alias("id"), F.lit("buyer").alias("kind"), F.col("buyer_label").alias("label"),
                 F.col("community_id").alias("community_id")),
        F.struct(F.col("target").alias("id"), F.lit("supplier").alias("kind"), F.col("supplier_label").alias("label"),
                 F.lit(None).cast(edges.schema["community_id"].dataType).alias("community_id")),
    ))
    return ranked.select("_rank", "n_awards", sides).groupBy("id", "kind").agg(
        F.min_by("label", "_rank").alias("label"),
        F.min_by("community_id", "_rank").alias("community_id"),
        F.sum("n_awards").alias("n_awards"),
    )
