import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenderlens.config import CleaningRules
from tenderlens.functions.scalars import parse_number
from tenderlens.operators import cleaning as c

RULES = CleaningRules(key="id", amount_columns=("amount", "net"))
TEXTS = ["12", " 12 ", "1,5", "1.234.567", "1d", "1f", "NaN", "", "abc", "-3e2", ".5", "5.", "+7", "inf", "0x10", "1 2"]


def test_number_text_matches_pandas(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r["t"]: r["n"] for r in df.select("t", parse_number(F.col("t")).alias("n")).collect()}
    want = pd.to_numeric(pd.Series(TEXTS).str.replace(",", "."), errors="coerce")
    for text, value in zip(TEXTS, want):
        assert (got[text] is None) == pd.isna(value), text
        assert got[text] is None or got[text] == value


def test_retype_needs_every_meaningful_value(spark):
    rows = [("1,5", "Sin información", "1.234.567", "a"), ("Sin información", "Sin fecha", "2", "1"), (None, "", "3", "2")]
    df = spark.createDataFrame(rows, "good string, only_sentinels string, thousands string, mixed string")
    assert c.profile(df).numeric_text == ["good"]
    assert [r["good"] for r in c.retype_numeric_text(df).collect()] == [1.5, 0.0, 0.0]


def test_sparse_threshold_is_strict_and_empty_input_drops_nothing(spark):
    df = spark.range(10).select(
        F.when(F.col("id") < 1, 1).alias("ninety"), F.lit(None).cast("int").alias("all"), F.lit("x").alias("none")
    )
    assert c.drop_sparse_columns(df).columns == ["ninety", "none"]
    assert c.drop_sparse_columns(df.limit(0)).columns == ["ninety", "all", "none"]


def test_union_aligns_types_and_absent_columns(spark):
    a = spark.createDataFrame([("1", 1)], "x string, n int")
    b = spark.createDataFrame([(2, 2.5, "z")], "x int, n double, extra string")
    got = c.union_by_name([a, b])
    assert dict(got.dtypes) == {"x": "string", "n": "double", "extra": "string"}
    assert {tuple(r) for r in got.collect()} == {("1", 1.0, None), ("2", 2.5, "z")}
    with pytest.raises(ValueError):
        c.clean_offers([])


def test_clean_whole(spark):
    rows = [
        ("t1", 10.0, "1,0", None, "s1", 0), ("t1", 10.0, "1,0", None, "s1", 1),  # whole-row duplicate
        ("t1", 20.0, "2,0", "2020-01-01", "s2", 2),                               # same key only
        ("t2", None, "0,0", "2020-01-02", None, 3),                               # zero net amount
        ("t3", 40.0, None, "2020-01-03", "s3", 4),                                # placeholder, so 0.0
    ]
    df = spark.createDataFrame(rows, "id string, amount double, net string, Fecha string, who string, row_id long")
    clean, m = c.clean_offers([df], RULES, row_order="row_id")
    assert {(r["id"], r["amount"], r["net"], r["Fecha"], r["who"], r["row_id"]) for r in clean.collect()} == {
        ("t1", 10.0, 1.0, "Sin fecha", "s1", 0), ("t1", 20.0, 2.0, "2020-01-01", "s2", 2),
    }
    assert (m.rows_in, m.rows_out, m.zero_rows, m.duplicate_keys) == (5, 2, 2, 2)
    assert m.numeric_imputed == {"amount": 15.0}
    assert (m.text_imputed, m.date_imputed, m.retyped_columns) == (["net", "who"], ["Fecha"], ["net"])
    assert m.to_df(spark).first()["rows_out"] == 2


def test_duplicates_without_order_keep_distinct_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "id string, n int")
    assert c.drop_duplicate_rows(df, "id").count() == 2
    assert c.drop_duplicate_rows(df, "missing").count() == 3


def test_zero_filter_lets_null_pass(spark):
    df = spark.createDataFrame([(None, 1.0), (0.0, 1.0), (2.0, 3.0)], "amount double, net double")
    assert c.exclude_zero_amounts(df, ["amount", "net"]).count() == 2
    assert c.exclude_zero_amounts(df, ["other"]).count() == 3


def test_impute_exclude(spark):
    df = spark.createDataFrame([(None, None), (4.0, "x")], "amount double, who string")
    rules = CleaningRules(impute_exclude=("amount",))
    got = c.impute_nulls(df, rules).collect()
    assert {(r["amount"], r["who"]) for r in got} == {(None, "Sin información"), (4.0, "x")}
