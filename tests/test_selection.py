import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlens.operators.selection import exact_quantiles, hot_keys, keep_top, layout_positions, running_positions


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_narrowed_quantiles_match_numpy(spark, q):
    rng = np.random.default_rng(1)
    skewed = rng.exponential(size=4001)
    halves = np.repeat([0.0, 1.0], 2000)
    tied = np.concatenate([np.full(3000, 5.0), rng.normal(size=1001)])
    rows = [
        (float(skewed[i]), float(halves[i]) if i < 4000 else None, float(tied[i]), None) for i in range(4001)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    for limit in (20, 10_000):
        got = exact_quantiles(df, ["a", "b", "c", "d"], q, direct_limit=limit, accuracy=100)
        assert got["a"] == pytest.approx(np.quantile(skewed, q), rel=1e-12)
        assert got["b"] == pytest.approx(np.quantile(halves, q))
        assert got["c"] == pytest.approx(np.quantile(tied, q), rel=1e-12)
        assert got["d"] is None


def test_keep_top_breaks_ties_in_order(spark):
    df = spark.range(2000).select((F.col("id") % 7).alias("score"), "id")
    got = keep_top(df, [F.desc("score"), F.asc("id")], 300, F.col("id"), groups=5).collect()
    want = sorted(((r["score"], r["id"]) for r in df.collect()), key=lambda r: (-r[0], r[1]))[:300]
    assert [(r["score"], r["id"]) for r in got] == want


def _brute(rows):
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    seen, out = {}, {}
    for key, _, tie in order:
        out[tie] = seen.get(key, 0)
        seen[key] = out[tie] + 1
    return out


def test_positions_with_one_hot_key_and_null_dates(spark):
    random.seed(3)
    rows = [("hot" if i % 3 == 0 else random.choice("abc") if i % 5 else None, random.choice([None, 1, 2, 3]), i)
            for i in range(900)]
    df = spark.createDataFrame(rows, "k string, day int, id int")
    order = [F.col("day").asc_nulls_first(), F.col("id").asc()]
    want = _brute(rows)
    plain = running_positions(df, ["k"], order, "p")
    laid = layout_positions(df, ["k"], order, "p")
    (hot,) = hot_keys(df, [["k"]], 200)
    assert {r["k"] for r in hot.collect()} == {"hot"}
    mixed = running_positions(df, ["k"], order, "p", hot)
    for result in (plain, laid, mixed):
        assert {r["id"]: r["p"] for r in result.collect()} == want


def test_hot_key_sets_are_told_apart(spark):
    rows = [("b1", "s1")] * 30 + [("b1", "s2")] * 30 + [("b2", "s2")] * 5
    df = spark.createDataFrame(rows, "buyer string, supplier string")
    pair, supplier, buyer, none = hot_keys(df, [["buyer", "supplier"], ["supplier"], ["buyer"], []], 32)
    assert pair is None
    assert [r["supplier"] for r in supplier.collect()] == ["s2"]
    assert [r["buyer"] for r in buyer.collect()] == ["b1"]


def test_global_positions_descending(spark):
    df = spark.createDataFrame([(i, i % 10) for i in range(100)], "id int, size int")
    got = layout_positions(df, [], [F.desc("size"), F.asc("id")], "p").collect()
    want = {i: n for n, (i, _) in enumerate(sorted(((i, i % 10) for i in range(100)), key=lambda r: (-r[1], r[0])))}
    assert {r["id"]: r["p"] for r in got} == want


def test_both_ranks_of_a_median_are_read_off_one_sketch(spark, monkeypatch):
    asked = []
    whole = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda *a: asked.append(a) or whole(*a))
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"))
    assert exact_quantiles(df, ["a", "b"], direct_limit=400) == {"a": 499.5, "b": -499.5}
    assert len(asked) == 2
