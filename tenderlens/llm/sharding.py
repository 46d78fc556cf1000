"""Uniform shuffle into shards of exact size.

How many rows each input partition sends to each shard is drawn from the distribution that a
uniform permutation of all rows would give (a multivariate hypergeometric matrix). Rows are
then permuted inside their partition, sent by those counts, and permuted again inside their
shard. Nothing but the matrix (input partitions times shards) is in one place.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.llm.common import stored, table

SHARDS = 24
SEED = 20
# Rows that one task permutes inside a shard.
RUN_ROWS = 1 << 18


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among ``n`` drawn without replacement, for populations of any size.

    The inverse of the distribution, summed outwards from the mean over 12 standard
    deviations; terms come from exact ratios of neighbours.
    """
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mean = n * good / total
    sd = math.sqrt(max(mean * (bad / total) * ((total - n) / max(total - 1, 1)), 0.0))
    low, high = max(low, math.floor(mean - 12 * sd) - 2), min(high, math.ceil(mean + 12 * sd) + 2)
    k = np.arange(low, high, dtype=np.float64)
    ratios = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(row_counts: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """Rows sent from each partition to each shard; rows and columns add up to the two arguments."""
    rng = np.random.default_rng(seed)
    left = list(shard_sizes)
    matrix = np.zeros((len(row_counts), len(left)), np.int64)
    for i, rows in enumerate(row_counts):
        behind = sum(left)
        for j, room in enumerate(left):
            behind -= room
            matrix[i, j] = hypergeometric(rng, room, behind, rows)
            rows -= matrix[i, j]
            left[j] -= int(matrix[i, j])
    return matrix


def shuffle_into_shards(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, run_rows: int = RUN_ROWS) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in the shard).

    Shard sizes differ by one at most. Any columns, nulls and repeated rows are carried along
    (shard and slot are replaced if there); an empty table gives no row. The drawn values are
    stored first, so tasks that run again meet the same ones.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark, columns = rows.sparkSession, [c for c in rows.columns if c not in ("shard", "slot")]
    laid = stored(
        rows.select(*columns).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    )
    mixed = lambda n: F.xxhash64(F.lit(seed), F.lit(n), F.col("_row"))
    # One row for each input partition.
    counts = sorted((r["_part"], r["count"]) for r in laid.groupBy("_part").count().collect())
    total = sum(n for _, n in counts)
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    ends = np.cumsum(communication_matrix([n for _, n in counts], sizes, seed), axis=1).tolist()
    plan = spark.createDataFrame([(p, e) for (p, _), e in zip(counts, ends)], "_part int, _ends array<long>")

    permuted = Window.partitionBy("_part").orderBy(mixed(1), "_row")
    sent = (
        laid.withColumn("_place", F.row_number().over(permuted) - 1)
        .join(plan, "_part")
        .withColumn("shard", F.size(F.filter("_ends", lambda end: end <= F.col("_place"))))
        .drop("_ends", "_place")
        .withColumn("_mix", mixed(2))
        .withColumn("_run", F.pmod(mixed(3), F.lit(max(1, -(-total // (shards * run_rows))))))
    )
    runs = sent.groupBy("shard", "_run").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select("shard", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    again = Window.partitionBy("shard", "_run").orderBy("_mix", "_row")
    return (
        sent.withColumn("_at", F.row_number().over(again) - 1)
        .join(bases, ["shard", "_run"])
        .select(*columns, "shard", (F.col("_base") + F.col("_at")).alias("slot"))
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shuffle_into_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
