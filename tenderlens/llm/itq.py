"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations of the principal axes are learnt so that coordinates lie close to their signs, which
gives balanced bits. The bits are cut into keys, one table for each; two vectors meet where
they share a key. Vectors of a bucket are measured in double precision where they met, block
by block, each pair in the first table that it shares, so that no list of pairs is written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.llm.common import components, digest, ship, shuffle_parts, stored, table
from tenderlens.llm.vectors import as_bytes, stacked, usable

COSINE = 0.95
MISSED = 0.02
# About so many rows, chosen by hash, teach the rotations; every row is coded.
SAMPLE = 20_000
ITERATIONS = 40
# Made pairs of each kind that size the tables, and the number of tables from which keys get shorter.
PAIRS = 4_000
TABLES = 256
BLOCK = 1024
SEED = 11


@dataclass
class Tables:
    """Projections (dim x bits each) around a mean; bits in order make ``count`` keys of ``width`` bits."""

    mean: np.ndarray
    projections: list[np.ndarray]
    width: int
    count: int

    def bits(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True)) - self.mean
        cut = [unit @ p > 0 for p in self.projections] or [np.zeros((len(x), 0), bool)]
        return np.concatenate(cut, axis=1)[:, : self.width * self.count]

    def keys(self, x: np.ndarray) -> np.ndarray:
        weights = 1 << np.arange(self.width, dtype=np.int64)
        return self.bits(x).reshape(len(x), self.count, self.width) @ weights


def table_shape(n: int, cosine: float = COSINE, missed: float = MISSED) -> tuple[int, int]:
    """(bits of a key, tables) for vectors whose mean is zero: keys for eight times as many buckets
    as vectors, and so many tables that a pair at the threshold shares none with probability
    ``missed`` at most. ``fitted`` starts from here."""
    width = max(8, min(60, math.ceil(math.log2(max(n, 1))) + 3))
    same = (1 - math.acos(cosine) / math.pi) ** width
    return width, math.ceil(math.log(missed) / math.log1p(-same))


class Learner:
    """Principal axes of a sample, and one quantisation rotation after another, as many as are asked for."""

    def __init__(self, sample: np.ndarray, seed: int = SEED):
        self.rng = np.random.default_rng(seed)
        unit = sample / np.sqrt((sample * sample).sum(axis=1, keepdims=True))
        self.mean, self.dim = unit.mean(axis=0), sample.shape[1]
        centred = unit - self.mean
        self.axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
        self.projected, self.projections = centred @ self.axes, []

    def tables(self, width: int, count: int) -> Tables:
        while len(self.projections) * self.dim < width * count:
            turn = np.linalg.qr(self.rng.standard_normal((self.dim, self.dim)))[0]
            for _ in range(ITERATIONS):
                left, _, right = np.linalg.svd(np.sign(self.projected @ turn).T @ self.projected)
                turn = (left @ right).T
            self.projections.append(self.axes @ turn)
        return Tables(self.mean, self.projections[: -(-width * count // self.dim)], width, count)


def learn(sample: np.ndarray, width: int, count: int, seed: int = SEED) -> Tables:
    return Learner(sample, seed).tables(width, count)


def made_pairs(sample: np.ndarray, cosine: float, n: int = PAIRS, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors of the sample, each with a partner at the cosine: away from it in any direction,
    and in the direction of a difference of two vectors of the sample."""
    rng = np.random.default_rng(seed)
    u = sample[rng.integers(len(sample), size=n)]
    u = u / np.sqrt((u * u).sum(axis=1, keepdims=True))
    if u.shape[1] < 2:
        return [(u, u)]

    def across(w: np.ndarray) -> np.ndarray:
        return w - (w * u).sum(axis=1, keepdims=True) * u

    anywhere = across(rng.standard_normal(u.shape))
    units = sample / np.sqrt((sample * sample).sum(axis=1, keepdims=True))
    apart = across(units[rng.integers(len(sample), size=n)] - units[rng.integers(len(sample), size=n)])
    apart = np.where((apart * apart).sum(axis=1, keepdims=True) > 1e-12, apart, anywhere)
    return [(u, cosine * u + math.sqrt(1 - cosine**2) * w / np.sqrt((w * w).sum(axis=1, keepdims=True))) for w in (anywhere, apart)]


def fitted(sample: np.ndarray, n: int, cosine: float = COSINE, missed: float = MISSED, seed: int = SEED) -> Tables:
    """Tables learnt from the sample of ``n`` vectors that miss no more than ``missed`` of made pairs at
    the threshold. Cuts go through the mean, where pairs lie wider apart the longer it is, so the shape
    comes from pairs that are coded. Where more than ``TABLES`` tables would be needed keys get shorter:
    buckets grow, the promise holds; a key without bits is one bucket of all."""
    learner, kinds = Learner(sample, seed), made_pairs(sample, cosine, seed=seed)
    width, least = table_shape(n, cosine, missed)
    start = learner.tables(width, least)
    agree = [(start.bits(a) == start.bits(b)).mean(axis=1) for a, b in kinds]

    def enough(width: int, count: int) -> bool:
        return all(((1 - np.minimum(p, 1 - 1e-12) ** width) ** count).mean() <= missed for p in agree)

    full = width
    while width and not enough(width, TABLES):
        width -= 1
    count = least if width == full else 1
    while not enough(width, count):
        count += 1
    # Bits of one vector are not independent; what counts is the share of pairs without a key in common.
    while width:
        tables = learner.tables(width, count)
        rates = [(tables.keys(a) != tables.keys(b)).all(axis=1).mean() for a, b in kinds]
        if all(r + 2 * math.sqrt(r * (1 - r) / PAIRS) <= missed for r in rates):
            return tables
        if count < TABLES:
            count = min(TABLES, count + max(1, count // 8))
        else:
            width -= 1
    return learner.tables(0, 1)


def _links_in_groups(group: np.ndarray, side: np.ndarray, table_no: np.ndarray, keys: np.ndarray, x: np.ndarray, weight: np.ndarray, cosine: float):
    """For sorted rows: (least linked row of each, weight of linked rows), each pair in its first shared table.

    ``side`` is 0 or 1 in a group of two blocks, where only pairs across count, and 2 else.
    """
    n = len(group)
    root, total = np.arange(n), np.zeros(n, np.int64)
    norm = np.sqrt((x * x).sum(axis=1))
    found = []
    step = 1
    while step < n:
        i = np.flatnonzero(group[:-step] == group[step:])
        if not len(i):
            break
        j = i + step
        wanted = (side[i] == 2) | (side[i] != side[j])
        i, j = i[wanted], j[wanted]
        for a in range(0, len(i), 32768):
            p, q = i[a : a + 32768], j[a : a + 32768]
            near = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= cosine
            p, q = p[near], q[near]
            first = (keys[p] == keys[q]).argmax(axis=1) == table_no[p]
            found.append((p[first], q[first]))
        step += 1
    if found:
        p, q = (np.concatenate(z) for z in zip(*found))
        np.add.at(total, p, weight[q])
        np.add.at(total, q, weight[p])
        while True:
            low = np.minimum(root[p], root[q])
            new = root.copy()
            np.minimum.at(new, p, low)
            np.minimum.at(new, q, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
    return root, total


def linked_pairs(distinct: DataFrame, dim: int, tables: Tables, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(id, root, n): for each bucket that gave a vector new links, a vector it is tied to and
    the weight of those links. ``distinct`` has id, vector (bytes), weight."""
    spark = distinct.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(tables)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = shared.value.keys(stacked(batch.column(1).to_pylist(), dim))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(keys), pa.list_(pa.int64()))], names=["id", "vector", "weight", "keys"]
            )

    coded = stored(distinct.select("id", "vector", "weight").mapInArrow(code, "id long, vector binary, weight long, keys array<long>"))
    entries = coded.select("id", F.posexplode("keys").alias("t", "key"))
    shared_keys = entries.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    # Most keys have one vector and end here, before vectors move.
    members = entries.join(shared_keys, ["t", "key"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    placed = (
        members.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
        .withColumn("side", F.when(F.col("lo") == F.col("hi"), 2).otherwise((F.col("own") == F.col("hi")).cast("int")))
        .select("id", "t", "key", "lo", "hi", "side")
    )
    groups = ["t", "key", "lo", "hi"]
    laid = (
        placed.join(coded, "id").select(*groups, "side", "id", "weight", "vector", "keys")
        .repartition(shuffle_parts(spark), *groups).sortWithinPartitions(*groups, "id")
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
                if len(held) < 2:
                    continue
            if held is None or not len(held):
                return
            columns = np.stack([held.column(g).to_numpy().astype(np.int64) for g in groups], axis=1)
            changed = np.concatenate([[True], (columns[1:] != columns[:-1]).any(axis=1)])
            # The last group may go on in the next batch.
            end = len(held) if batch is None else int(np.flatnonzero(changed)[-1])
            if not end:
                continue
            done, held = held.slice(0, end), held.slice(end)
            ids = done.column("id").to_numpy()
            keys = np.asarray(done.column("keys").combine_chunks().flatten()).reshape(end, -1)
            root, total = _links_in_groups(
                np.cumsum(changed[:end]), done.column("side").to_numpy(), done.column("t").to_numpy(), keys,
                stacked(done.column("vector").to_pylist(), dim), done.column("weight").to_numpy(), cosine,
            )
            some = total > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root][some]), pa.array(total[some])], names=["id", "root", "n"])

    return laid.mapInArrow(measure, "id long, root long, n long")


def _with_end(batches):
    yield from batches
    yield None


def near_duplicates(rows: DataFrame, cosine: float = COSINE, missed: float = MISSED, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``rows`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Equal vectors are one vector with a weight until the end, so copies cost nothing. Vectors
    that are null, zero or hold null or non-finite components link with nothing, as do vectors
    of different dimension with each other. A repeated row is a vector of its own and links
    with its copy; a null vec_id is never the least of a component.
    """
    d1, d2 = digest(F.col("embedding").cast("array<double>"))
    marked = rows.select(F.col("vec_id").cast("long"), "embedding", F.when(usable(F.col("embedding")), d1).alias("d1"), d2.alias("d2"))
    classes = stored(
        marked.filter("d1 IS NOT NULL AND vec_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    )
    # A class is shown by its row of least id.
    firsts = as_bytes(
        marked.join(classes.select("d1", "d2", F.col("id").alias("vec_id")), ["d1", "d2", "vec_id"], "left_semi").dropDuplicates(["vec_id", "d1", "d2"])
    ).withColumnRenamed("vec_id", "id").dropDuplicates(["id"])
    distinct = stored(firsts.join(classes.select("id", "weight"), "id"))
    tied = None
    # One dimension, or a few.
    for dim, n in sorted((r["dim"], r["count"]) for r in distinct.groupBy("dim").count().collect()):
        same = distinct.filter(F.col("dim") == dim)
        chance = F.pmod(F.xxhash64("id"), F.lit(2**40)) / float(2**40)
        seen = same.filter(chance < sample / n).select("vector").collect()
        if not seen:
            seen = same.select("vector").limit(1).collect()
        tables = fitted(stacked([bytes(r["vector"]) for r in seen], dim), n, cosine, missed)
        found = linked_pairs(same, dim, tables, cosine)
        tied = found if tied is None else tied.union(found)
    result = marked.join(classes, ["d1", "d2"], "left")
    if tied is None:
        return result.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    tied = stored(tied)
    links = tied.groupBy("id").agg(F.sum("n").alias("others"))
    roots = components(tied.select(F.col("id").alias("a"), F.col("root").alias("b")))
    component = F.coalesce("root", "id", "vec_id")
    return (
        result.join(links, "id", "left").join(roots, "id", "left")
        .select(
            "vec_id", F.coalesce(F.col("weight") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).alias("n_links"),
            component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"),
        )
    )


def op3_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
