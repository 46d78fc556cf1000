"""Dot products of dense and sparse vectors in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dense_dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot of two ``array<struct<id,w>>`` whose ids are unique within each array.

    Sorting the concatenation puts equal ids side by side, so one pass over neighbours
    finds every common id: n log n instead of a lookup per element.
    """
    merged = F.array_sort(F.concat(a, b))
    start = F.struct(
        F.lit(None).cast("int").alias("id"), F.lit(0.0).alias("w"), F.lit(0.0).alias("total")
    )
    return F.aggregate(
        merged,
        start,
        lambda acc, x: F.struct(
            x["id"].alias("id"),
            x["w"].alias("w"),
            (acc["total"] + F.when(acc["id"] == x["id"], acc["w"] * x["w"]).otherwise(0.0)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
