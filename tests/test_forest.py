from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlens.config import ForestSettings
from tenderlens.operators import forest

SETTINGS = ForestSettings(n_trees=40, sample_size=64, cut_year=2024)


def points(spark, years=(2022, 2025), n=400):
    rng = np.random.default_rng(7)
    rows = [(i, datetime(years[i % 2], 1, 1), float(a), float(b) if i % 10 else None) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    rows += [(n, datetime(years[1], 6, 1), 30.0, -30.0), (n + 1, None, 0.0, 0.0)]
    return spark.createDataFrame(rows, "tender_id int, published_at timestamp_ntz, a double, b double")


def test_outlier_first_scores_in_range_and_years_required(spark):
    got = forest.isolation_scores(points(spark), ["a", "b", "absent"], SETTINGS).collect()
    assert all(0 < r["anomaly"] <= 1 for r in got)
    assert 400 in {r["tender_id"] for r in sorted(got, key=lambda r: -r["anomaly"])[:5]}
    assert {r["tender_id"] for r in got} == set(range(401))
    assert {r["split"] for r in got} == {"train", "test"}


def test_same_scores_whatever_the_partitions(spark):
    df = points(spark)
    runs = [
        {r["tender_id"]: r["anomaly"] for r in forest.isolation_scores(df.repartition(n), ["a", "b"], SETTINGS).collect()}
        for n in (1, 5)
    ]
    assert runs[0] == pytest.approx(runs[1], rel=1e-9)


def test_without_a_past_everything_trains_once(spark):
    got = forest.isolation_scores(points(spark, years=(2024, 2025)), ["a", "b"], SETTINGS).collect()
    assert len(got) == 402 and {r["split"] for r in got} == {"all"}


def test_scaling_uses_training_medians(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "x double, y double")
    scaling = forest.fit_scaling(df, ["x", "y"])
    assert scaling.fill == {"x": 2.0, "y": 0.0} and scaling.sd["y"] == 1.0
    got = [r["x"] for r in forest.scale(df, scaling).collect()]
    assert got == pytest.approx([-(1.5 ** 0.5), 1.5 ** 0.5, 0.0])


def test_sampling_gives_each_tree_enough_rows(spark):
    few = spark.range(500).select(F.col("id").alias("tender_id"))
    per_tree = forest.sample_rows(few, 500, "tender_id", SETTINGS).groupBy("tree").count().collect()
    assert len(per_tree) == 40 and min(r["count"] for r in per_tree) >= 64
    many = spark.range(20_000).select(F.col("id").alias("tender_id"))
    drawn = forest.sample_rows(many, 20_000, "tender_id", SETTINGS)
    per_tree = drawn.groupBy("tree").count().collect()
    assert len(per_tree) == 40 and min(r["count"] for r in per_tree) >= 64
    assert max(r["count"] for r in per_tree) < 3 * 64


def test_path_lengths():
    assert list(forest.mean_path(np.array([0, 1, 2]))) == [0.0, 0.0, 1.0]
    assert float(forest.mean_path(256)) == pytest.approx(10.244, abs=1e-3)


def test_anomaly_rate_near_contamination(spark):
    scores = forest.isolation_scores(points(spark), ["a", "b"], SETTINGS)
    rate = {r["split"]: r["anomaly_pct"] for r in forest.anomaly_rate(scores, 0.05).collect()}
    assert rate["train"] == pytest.approx(5.0, abs=0.5)


@pytest.mark.parametrize("low, high", [(1.0, np.nextafter(1.0, 2.0)), (-1e308, 1e308), (-np.inf, np.inf), (0.0, 5e-324)])
def test_trees_split_neighbouring_and_extreme_values(low, high):
    rows = np.array([[low], [high]] * 8)
    for seed in range(50):
        nodes = forest._grow(rows, 0, 4, np.random.default_rng(seed))
        assert all(n is not None for n in nodes) and len(nodes) == 3


def test_scores_with_deltas_one_ulp_apart(spark):
    """Similarity deltas that should be equal differ in their last bit."""
    steps = [0.1 + 0.2, 0.3]
    rows = [(i, datetime(2022 + i % 3, 1, 1), steps[i % 2]) for i in range(300)]
    got = forest.isolation_scores(spark.createDataFrame(rows, "tender_id int, published_at timestamp_ntz, a double"), ["a"], SETTINGS)
    assert got.count() == 300


@pytest.mark.parametrize("years", [(2022, 2025), (2024, 2025)])
def test_anomaly_column_is_the_joined_score_without_a_join(spark, years):
    df = points(spark, years).union(spark.createDataFrame([(None, datetime(years[0], 1, 1), 1.0, 2.0)], points(spark).schema))
    scores = forest.isolation_scores(df, ["a", "b", "absent"], SETTINGS).select(F.col("tender_id").alias("id"), "anomaly")
    joined = df.join(scores, F.col("tender_id") == F.col("id"), "left").select("tender_id", "anomaly")
    got = df.withColumn("more", F.lit(1)).select("tender_id", forest.anomaly_column(df, ["a", "b", "absent"], SETTINGS).alias("anomaly"))
    key = lambda r: (r[0] is None, r[0])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, joined.collect()), key=key)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
