"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector's direction is padded, rotated at random, and kept as the signs of its coordinates
with two scalars: its length and its inner product with its own code. Bits and scalars
estimate the inner product with any query and bound the error; only vectors whose upper bound
reaches the k-th best so far are measured exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.llm.common import ship, stored, table
from tenderlens.llm.vectors import as_bytes, stacked

K = 20
BITS_EACH = 2
# Standard deviations of the estimate that the bound allows for.
BOUND = 2.5
QUERY_BLOCK = 2048
CODE_BLOCK = 16384
STEP = 2048
SEED = 7

_rotations: dict[tuple[int, int], np.ndarray] = {}


def code_bits(dim: int) -> int:
    return 64 * BITS_EACH * -(-dim // 64)


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """The first ``dim`` rows of a random rotation of ``code_bits(dim)`` dimensions."""
    if (dim, seed) not in _rotations:
        rng = np.random.default_rng([seed, dim])
        q, r = np.linalg.qr(rng.standard_normal((code_bits(dim), code_bits(dim))))
        _rotations[dim, seed] = (q * np.sign(np.diag(r)))[:dim]
    return _rotations[dim, seed]


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, lengths, inner products of each direction with its code)."""
    length = np.sqrt((x * x).sum(axis=1))
    turned = (x / length[:, None]) @ rotation(x.shape[1])
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def build_index(rows: DataFrame) -> DataFrame:
    """(vec_id, dim, vector, code, length, fit) of every usable vector, stored."""
    ship(rows.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                code, length, fit = encode(stacked(part.column(2).to_pylist(), int(dim)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(fit)],
                    names=["vec_id", "dim", "vector", "code", "length", "fit"],
                )

    return stored(as_bytes(rows).mapInArrow(index, "vec_id long, dim int, vector binary, code binary, length double, fit double"))


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, code: np.ndarray, length: np.ndarray,
    fit: np.ndarray, k: int, bound: float = BOUND,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector id, score) of each query's ``k`` best, others than itself, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, x, code, length, fit = ids[order], x[order], code[order], length[order], fit[order]
    bits = code.shape[1] * 8
    norms = np.sqrt((queries * queries).sum(axis=1))
    turned = ((queries / norms[:, None]) @ rotation(queries.shape[1])).astype(np.float32)
    slack = bound * np.sqrt(np.maximum(1 - fit**2, 0)) / (fit * np.sqrt(bits - 1))
    threshold = np.full(len(queries), -np.inf)
    best_q, best_id, best_s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for at in range(0, len(ids), STEP):
        part = slice(at, at + STEP)
        signs = np.unpackbits(code[part], axis=1).astype(np.float32) * 2 - 1
        estimate = (turned @ signs.T) / (np.sqrt(bits) * fit[part]).astype(np.float32)
        reach = norms[:, None] * length[part]
        if at == 0 and estimate.shape[1] > k + 1:
            # Before any exact score: the k-th lower bound, one more for the query itself.
            lower = (estimate - slack[part]) * reach
            threshold = np.partition(lower, -(k + 1), axis=1)[:, -(k + 1)]
        rows, columns = np.nonzero((estimate + slack[part]) * reach >= threshold[:, None])
        own = query_ids[rows] != ids[part][columns]
        rows, columns = rows[own], columns[own]
        scores = np.concatenate([
            np.einsum("ij,ij->i", queries[rows[i : i + 65536]], x[part][columns[i : i + 65536]])
            for i in range(0, len(rows), 65536)
        ]) if len(rows) else np.empty(0)
        best_q, best_id, best_s = (np.concatenate(z) for z in ((best_q, rows), (best_id, ids[part][columns]), (best_s, scores)))
        sort = np.lexsort((best_id, -best_s, best_q))
        best_q, best_id, best_s = best_q[sort], best_id[sort], best_s[sort]
        starts = np.searchsorted(best_q, np.arange(len(queries) + 1))
        top = np.arange(len(best_q)) - starts[best_q] < k
        full = np.flatnonzero(np.diff(starts) >= k)
        threshold[full] = np.maximum(threshold[full], best_s[starts[full] + k - 1])
        best_q, best_id, best_s = best_q[top], best_id[top], best_s[top]
    return best_q, best_id, best_s


def nearest(index: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, code_block: int = CODE_BLOCK) -> DataFrame:
    """Each query's ``k`` nearest by inner product: query_id, rank (from 1), vec_id, score.

    ``index`` and ``queries`` are rows of ``build_index``. Queries and vectors meet block by
    block, each pair of blocks in a task of its own with bounded memory; a task returns k rows
    for each of its queries. The row of a query's own id is left out; fewer than k others give
    fewer rows. Vectors of different dimension are not compared. Null ids take no part.
    """
    ship(index.sparkSession)
    index, queries = index.filter("vec_id IS NOT NULL"), queries.filter("vec_id IS NOT NULL")
    n, m = index.count(), queries.count()
    chunks, blocks = max(1, -(-n // code_block)), max(1, -(-m // query_block))
    mixed = F.xxhash64("vec_id")

    def dealt(rows: DataFrame, own: str, count: int, other: str, copies: int) -> DataFrame:
        return rows.withColumn(own, F.pmod(mixed, F.lit(count)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    left = dealt(queries.select("vec_id", "dim", "vector"), "block", blocks, "chunk", chunks)
    right = dealt(index, "chunk", chunks, "block", blocks)

    def measure(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        dim = int(q["dim"].iat[0])
        code = np.frombuffer(b"".join(x["code"]), np.uint8).reshape(len(x), -1)
        query_ids = q["vec_id"].to_numpy()
        rows, ids, scores = search_block(
            query_ids, stacked(q["vector"], dim), x["vec_id"].to_numpy(), stacked(x["vector"], dim), code,
            x["length"].to_numpy(), x["fit"].to_numpy(), k,
        )
        return pd.DataFrame({"query_id": query_ids[rows], "vec_id": ids, "score": scores})

    keys = ["dim", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(measure, "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "embeddings"))
    return nearest(index, index.filter("vec_id % 20 = 0"))
