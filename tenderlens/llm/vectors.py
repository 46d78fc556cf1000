"""Embeddings as bytes: arrays of doubles that tasks can stack without touching each number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.common import ship


def usable(embedding: F.Column) -> F.Column:
    """True for a vector that is not null, not zero, and whose components are all finite numbers."""
    x = embedding.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def as_bytes(rows: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(vec_id, dim, vector) of the usable vectors; ``vector`` is little-endian doubles."""
    ship(rows.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = np.asarray(lists.flatten(), "<f8").tobytes()
            dims = lists.value_lengths().to_numpy()
            ends = np.cumsum(dims) * 8
            vectors = [flat[a:b] for a, b in zip((ends - dims * 8).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())], names=["vec_id", "dim", "vector"]
            )

    kept = rows.filter(usable(F.col(embedding))).select(F.col("vec_id").cast("long"), F.col(embedding).cast("array<double>"))
    return kept.mapInArrow(pack, "vec_id long, dim int, vector binary")


def stacked(vectors, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<f8").reshape(-1, dim)
