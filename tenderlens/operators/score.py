"""Combining rule and anomaly scores into one 0-100 risk score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.functions.scalars import half_even


def _unit(name: str, bounds: Column) -> Column:
    """Min-max to 0..1; a constant column becomes 0 and a null row 0."""
    low, high = bounds[f"{name}_low"], bounds[f"{name}_high"]
    width = F.when(high > low, high - low).otherwise(1.0)
    return F.coalesce((F.col(name) - low) / width, F.lit(0.0))


def combine_scores(
    tenders: DataFrame,
    rules_share: float = 0.6,
    forest_share: float = 0.4,
    rules: str = "rule_score",
    anomaly: str = "anomaly",
) -> DataFrame:
    """Add rule_part, anomaly_part (the true weighted terms) and risk_score (0-100).

    Bounds and maximum are scalar subqueries over the input, so give it a stored
    or stored table when computing the input is expensive.
    """
    bounds = tenders.agg(F.struct(*[
        e.alias(f"{c}_{s}") for c in (rules, anomaly) for s, e in (("low", F.min(c)), ("high", F.max(c)))
    ]).alias("b")).scalar()
    parts = tenders.withColumns({
        "rule_part": rules_share * _unit(rules, bounds),
        "anomaly_part": forest_share * _unit(anomaly, bounds),
    })
    combined = F.col("rule_part") + F.col("anomaly_part")
    top = parts.agg(F.max(combined).alias("top")).scalar()
    return parts.withColumn(
        "risk_score", half_even(combined / F.when(top > 0, top).otherwise(1.0) * 100, 2)
    )


def score_contributions(scored: DataFrame) -> DataFrame:
    """How much of each tender's risk score came from rules and from the forest."""
    whole = F.col("rule_part") + F.col("anomaly_part")
    share = F.when(whole > 0, F.col("rule_part") / whole).otherwise(0.0)
    return scored.select(
        "tender_id",
        "risk_score",
        (F.col("risk_score") * share).alias("rule_points"),
        (F.col("risk_score") - F.col("risk_score") * share).alias("anomaly_points"),
    )


def score_summary(scored: DataFrame, n_features: int, dense: bool) -> DataFrame:
    return scored.agg(
        F.count("*").alias("n_tenders"),
        F.lit(n_features).alias("n_features"),
        F.lit(dense).alias("dense"),
        F.avg("risk_score").alias("mean_score"),
        F.max("risk_score").alias("max_score"),
    )
