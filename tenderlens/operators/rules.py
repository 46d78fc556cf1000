"""The additive rule score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.config import RuleWeights


def community_threshold(tenders: DataFrame):
    """Mean plus one sample deviation of the community mean over tenders, as a scalar
    subquery: one row feeds the plan, no join."""
    stats = tenders.agg(
        (
            F.coalesce(F.avg("community_mean_score"), F.lit(0.0))
            + F.coalesce(F.stddev_samp("community_mean_score"), F.lit(0.0))
        ).alias("threshold")
    )
    return stats.scalar()


def rule_score(tenders: DataFrame, weights: RuleWeights = RuleWeights()) -> DataFrame:
    """Weighted flags plus history, text and community terms where their columns exist.

    ``flag_*`` columns hold the weight a term added, ``is_*`` whether it applied.
    """
    terms = {
        "captive_supplier": (F.col("supplier_share") > weights.captive_share, weights.captive_supplier),
        "intense_relation": (F.col("prior_pair") >= weights.intense_min_awards, weights.intense_relation),
    }
    if "delta_sim_tfidf" in tenders.columns:
        terms["tailored_spec"] = (
            F.coalesce(F.col("delta_sim_tfidf"), F.lit(0.0)) > weights.tailored_min_delta,
            weights.tailored_spec,
        )
    if "community_mean_score" in tenders.columns:
        terms["hot_community"] = (
            F.coalesce(F.col("community_mean_score"), F.lit(0.0)) > community_threshold(tenders),
            weights.hot_community,
        )
    flagged = tenders.withColumns({
        f"is_{name}": F.coalesce(test, F.lit(False)) for name, (test, _) in terms.items()
    }).withColumns({
        f"flag_{name}": F.when(F.col(f"is_{name}"), F.lit(weight)).otherwise(0.0)
        for name, (_, weight) in terms.items()
    })
    structural = [
        F.coalesce(F.col(flag), F.lit(0)) * F.lit(weight) for flag, weight in weights.flags.items()
    ]
    total = reduce(lambda a, b: a + b, structural + [F.col(f"flag_{name}") for name in terms])
    return flagged.withColumn("rule_score", total)
