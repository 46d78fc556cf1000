"""Pages, lookups and name searches read what they need and no more."""

import pytest
from pyspark.sql import functions as F

from tenderlens.sources import indexes


def rows_scanned(df):
    """Rows that the scans of a collected DataFrame gave out."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        leaf = leaf.plan() if "QueryStage" in leaf.getClass().getSimpleName() else leaf
        metric = leaf.metrics().get("numOutputRows")
        total += metric.get().value() if metric.isDefined() else 0
    return total


def test_pages_at_any_depth_read_two_files_at_most(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1000).select(F.when(F.col("id") % 7 != 0, F.col("id") % 50).alias("score"), "id")
    order = [F.desc_nulls_last("score"), F.asc("id")]
    indexes.write_ranked(df, path, order, 100)
    want = [tuple(r) for r in df.orderBy(*order).collect()]
    for offset, limit in ((0, 30), (890, 20), (895, 100), (990, 50), (1000, 5), (5000, 5), (100, 0)):
        page = indexes.stored_page(spark, path, limit, offset, 100)
        assert [tuple(r) for r in page.collect()] == want[offset : offset + limit]
        assert offset >= 1000 or len(page.inputFiles()) <= 2
    with pytest.raises(ValueError):
        indexes.stored_page(spark, path, 5, -1)


def test_lookup_reads_one_row_group(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(40_000).select(F.concat(F.lit("T-"), F.lpad("id", 8, "0")).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    indexes.write_clustered(df, path, "key", row_group_bytes=64 << 10)
    found = spark.read.parquet(path).filter("key = 'T-00012345'")
    assert len(found.collect()) == 1 and rows_scanned(found) < 10_000
    missing = spark.read.parquet(path).filter("key = 'T-00012345x'")
    assert missing.collect() == [] and rows_scanned(missing) == 0


@pytest.mark.parametrize("part", ["lota", "LO", "o_a", "ota de%a", "%", "ñ", "zzz", "a", "Lota de Arauco y más", "_"])
def test_names_by_part(spark, part):
    names = ["Municipalidad de Lota", "Lota de Arauco", "LOTA", "Ñuñoa", "ab", "", None, "Lota"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    got = indexes.with_name_like(df, "name", indexes.name_grams(df, "name"), part)
    want = df.filter(F.col("name").ilike(f"%{part}%"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
