"""Cleaning of raw offer lines: sparse columns, imputation, duplicates, retyping, zeros.

The schema of the result depends on the data, so the cleaner takes a few profile passes
(one aggregation each, all columns at once) and brings back one row per pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlens.config import NO_DATE, NO_TEXT, SENTINELS, CleaningRules
from tenderlens.functions.scalars import parse_number
from tenderlens.operators.selection import exact_quantiles


@dataclass
class CleaningMetrics:
    """What one cleaning run did."""

    rows_in: int = 0
    columns_in: int = 0
    dropped_columns: list[str] = field(default_factory=list)
    numeric_imputed: dict[str, float] = field(default_factory=dict)
    text_imputed: list[str] = field(default_factory=list)
    date_imputed: list[str] = field(default_factory=list)
    duplicate_keys: int = 0
    retyped_columns: list[str] = field(default_factory=list)
    zero_rows: int = 0
    rows_out: int = 0
    columns_out: int = 0

    def to_df(self, spark: SparkSession) -> DataFrame:
        schema = (
            "rows_in long, columns_in int, dropped_columns array<string>, numeric_imputed map<string,double>, "
            "text_imputed array<string>, date_imputed array<string>, duplicate_keys long, "
            "retyped_columns array<string>, zero_rows long, rows_out long, columns_out int"
        )
        return spark.createDataFrame([tuple(asdict(self).values())], schema)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack inputs whose columns differ; absent columns become null. A column that is
    text in one input and numeric in another becomes text."""
    if not frames:
        raise ValueError("nothing to clean: no inputs")
    kinds: dict[str, set[str]] = {}
    for df in frames:
        for f in df.schema:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())

    def common(kind: set[str]) -> str | None:
        if len(kind) == 1:
            return None
        return "string" if "string" in kind else "double"

    aligned = [
        df.withColumns({
            f.name: _quoted(f.name).cast(target)
            for f in df.schema
            if (target := common(kinds[f.name])) is not None
        })
        for df in frames
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: nulls and their share in percent (0 for an empty input)."""
    names = df.columns
    one = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(_quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)]
    )
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_null")) for i, c in enumerate(names)
    ])
    return one.select("_rows", F.inline(pairs)).select(
        "column_name",
        "n_null",
        F.when(F.col("_rows") > 0, F.col("n_null") / F.col("_rows") * 100).otherwise(0.0).alias("null_pct"),
    )


@dataclass
class Profile:
    """What one pass over the data says about every column."""

    rows: int
    nulls: dict[str, int]
    numeric_text: list[str]


def profile(df: DataFrame, skip: str | None = None) -> Profile:
    """Rows, nulls per column, and the text columns whose every meaningful value is a
    number (decimal comma allowed). One aggregation over all columns."""
    names = [c for c in df.columns if c != skip]
    texts = [c for c in text_columns(df) if c != skip]
    row = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(_quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.count_if(_meaningful(c)).alias(f"t{i}") for i, c in enumerate(texts)],
        *[F.count_if(_meaningful(c) & parse_number(_quoted(c)).isNull()).alias(f"bad{i}") for i, c in enumerate(texts)],
    ).first()
    return Profile(
        row["rows"],
        {c: row[f"n{i}"] for i, c in enumerate(names)},
        [c for i, c in enumerate(texts) if row[f"t{i}"] > 0 and row[f"bad{i}"] == 0],
    )


def sparse_columns(rows: int, nulls: dict[str, int], max_null_pct: float) -> list[str]:
    return [c for c, n in nulls.items() if rows and n / rows * 100 > max_null_pct]


def drop_sparse_columns(df: DataFrame, max_null_pct: float = 90.0) -> DataFrame:
    seen = profile(df)
    return df.drop(*sparse_columns(seen.rows, seen.nulls, max_null_pct))


def is_date_name(name: str, parts: Sequence[str]) -> bool:
    return any(p in name.lower() for p in parts)


def impute_nulls(
    df: DataFrame,
    rules: CleaningRules = CleaningRules(),
    seen: Profile | None = None,
    metrics: CleaningMetrics | None = None,
) -> DataFrame:
    """Numbers to their exact median, dates to one placeholder, other text to another."""
    seen = profile(df) if seen is None else seen
    metrics = CleaningMetrics() if metrics is None else metrics
    gaps = {c for c in df.columns if seen.nulls.get(c) and c not in rules.impute_exclude}
    numbers = [c for c in numeric_columns(df) if c in gaps]
    texts = [c for c in text_columns(df) if c in gaps]
    dates = [c for c in texts if is_date_name(c, rules.date_name_parts)]
    present = {c: seen.rows - seen.nulls[c] for c in numbers}
    medians = {c: m for c, m in exact_quantiles(df, numbers, counts=present).items() if m is not None}
    metrics.numeric_imputed = medians
    metrics.text_imputed = [c for c in texts if c not in dates]
    metrics.date_imputed = dates
    filled = {c: F.coalesce(_quoted(c).cast("double"), F.lit(m)) for c, m in medians.items()}
    filled |= {c: F.coalesce(_quoted(c), F.lit(NO_DATE if c in dates else NO_TEXT)) for c in texts}
    return df.withColumns(filled)


def duplicate_key_count(df: DataFrame, key: str) -> DataFrame:
    """One row: how many rows repeat an earlier key (a null key counts as one value)."""
    return df.groupBy(_quoted(key).alias("k")).count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_keys")
    )


def drop_duplicate_rows(df: DataFrame, key: str, row_order: str | None = None) -> DataFrame:
    """Drop whole-row duplicates, keeping the first by ``row_order`` when one is given.

    A repeated row always repeats its key, so no separate look for repeated keys is
    needed; without the key column the step is skipped.
    """
    if key not in df.columns:
        return df
    if row_order is None:
        return df.distinct()
    rest = [c for c in df.columns if c != row_order]
    return df.groupBy(*[_quoted(c) for c in rest]).agg(F.min(row_order).alias(row_order)).select(*df.columns)


def _meaningful(c: str) -> Column:
    return _quoted(c).isNotNull() & ~_quoted(c).isin(list(SENTINELS))


def retype_numeric_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns that hold only numbers as double; placeholders and nulls become 0.0."""
    columns = profile(df).numeric_text if columns is None else columns
    return df.withColumns({c: F.coalesce(parse_number(_quoted(c)), F.lit(0.0)) for c in columns})


def exclude_zero_amounts(df: DataFrame, amount_columns: Sequence[str]) -> DataFrame:
    """Keep rows whose present amounts differ from zero; a null amount passes, and an
    amount column that stayed text never equals zero."""
    present = [c for c in amount_columns if c in numeric_columns(df)]
    if not present:
        return df
    return df.filter(reduce(lambda a, b: a & b, [_quoted(c).isNull() | (_quoted(c) != 0) for c in present]))


def clean_offers(
    frames: Sequence[DataFrame],
    rules: CleaningRules = CleaningRules(),
    row_order: str | None = None,
    with_metrics: bool = True,
    observation: Observation | None = None,
) -> tuple[DataFrame, CleaningMetrics]:
    """Union, then drop sparse columns, impute, drop duplicates, retype and drop zeros.

    One profile of the raw rows answers every question about the columns: imputing and
    dropping duplicates change neither which columns are sparse nor which text is
    numeric. Counts that only feed the metrics are skipped with ``with_metrics=False``.
    An ``observation`` gathers the row counts while the result is written, which saves a
    second run of the deduplication; pass it to ``add_row_counts`` afterwards.
    """
    df = union_by_name(frames)
    metrics = CleaningMetrics(columns_in=len(df.columns) - (row_order is not None))
    seen = profile(df, skip=row_order)
    metrics.rows_in = seen.rows
    metrics.dropped_columns = sparse_columns(seen.rows, seen.nulls, rules.max_null_pct)
    df = df.drop(*metrics.dropped_columns)
    metrics.retyped_columns = [c for c in seen.numeric_text if c in df.columns]
    df = impute_nulls(df, rules, seen, metrics)
    if with_metrics and rules.key in df.columns:
        metrics.duplicate_keys = duplicate_key_count(df, rules.key).first()["duplicate_keys"]
    df = drop_duplicate_rows(df, rules.key, row_order)
    typed = retype_numeric_text(df, metrics.retyped_columns)
    present = [c for c in rules.amount_columns if c in numeric_columns(typed)]
    zero = reduce(lambda a, b: a | b, [F.coalesce(_quoted(c) == 0, F.lit(False)) for c in present], F.lit(False))
    counts = (F.count(F.lit(1)).alias("rows"), F.count_if(zero).alias("zero"))
    if observation is not None:
        typed = typed.observe(observation, *counts)
    elif with_metrics:
        add_row_counts(metrics, typed.agg(*counts).first().asDict())
    kept = exclude_zero_amounts(typed, rules.amount_columns)
    metrics.columns_out = len(kept.columns) - (row_order is not None)
    return kept, metrics


def add_row_counts(metrics: CleaningMetrics, counts: dict[str, int]) -> None:
    metrics.zero_rows = counts["zero"]
    metrics.rows_out = counts["rows"] - counts["zero"]
