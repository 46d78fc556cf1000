"""Isolation forest (Liu, Ting and Zhou, 2008) trained on the past, applied to all rows.

Trees are grown in parallel, one small bounded group per tree; the fitted forest is at
most n_trees * (2 * sample_size - 1) node rows, so it can be broadcast to score any
number of rows in vectorised batches.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.config import ForestSettings
from tenderlens.operators.selection import exact_quantiles
from tenderlens.session import stored

NODE_SCHEMA = "tree int, node int, feature int, threshold double, child int, path double"
# The tree functions travel inside the tasks, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EULER_GAMMA = 0.5772156649015329
# Candidates drawn beyond the sample, in standard deviations: chance leaves no tree short of rows.
OVERDRAW = 8.0


def temporal_split(tenders: DataFrame, cut_year: int) -> DataFrame:
    """Add ``split``: train before the year, test from it on, null without a year."""
    year = F.year("published_at")
    return tenders.withColumn("split", F.when(year < cut_year, "train").when(year >= cut_year, "test"))


@dataclass(frozen=True)
class Scaling:
    """Per feature: fill value, mean and population deviation of the training rows."""

    fill: dict[str, float]
    mean: dict[str, float]
    sd: dict[str, float]


def fit_scaling(train: DataFrame, features: Sequence[str]) -> Scaling:
    medians = exact_quantiles(train, features)
    fill = {c: 0.0 if medians[c] is None else float(medians[c]) for c in features}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(fill[c])) for c in features}
    row = train.agg(*[
        e
        for i, c in enumerate(features)
        for e in (F.avg(filled[c]).alias(f"m{i}"), F.stddev_pop(filled[c]).alias(f"s{i}"))
    ]).first()
    return Scaling(
        fill,
        {c: row[f"m{i}"] or 0.0 for i, c in enumerate(features)},
        {c: row[f"s{i}"] or 1.0 for i, c in enumerate(features)},
    )


def scaled_columns(scaling: Scaling) -> dict[str, Column]:
    return {
        c: (F.coalesce(F.col(c).cast("double"), F.lit(fill)) - F.lit(scaling.mean[c])) / F.lit(scaling.sd[c])
        for c, fill in scaling.fill.items()
    }


def scale(df: DataFrame, scaling: Scaling) -> DataFrame:
    """Impute and standardise the features in place."""
    return df.withColumns(scaled_columns(scaling))


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    full = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, full))


def sample_rows(train: DataFrame, rows: int, key: str, settings: ForestSettings) -> DataFrame:
    """Assign training rows to trees by hash, independent of partitioning.

    Every tree draws from all rows, each with the same chance, at any number of rows. A row
    names its trees before it is copied, so little more than sample_size rows per tree leave
    their partition and no other copy is made.
    """
    wanted = settings.sample_size + OVERDRAW * settings.sample_size**0.5
    share = min(1.0, wanted / max(rows, 1))
    # In doubles 2**63 * share is exact enough; every row is in for a share of one.
    limit = F.lit(float(2**63) * (2 * share - 1))

    trees = F.filter(
        F.sequence(F.lit(0), F.lit(settings.n_trees - 1)),
        lambda t: F.xxhash64(F.col(key), t, F.lit(settings.seed)).cast("double") <= limit,
    )
    drawn = train.withColumn("tree", F.explode(trees))
    return drawn.withColumn("_pick", F.xxhash64(key, F.col("tree"), F.lit(settings.seed + 1)))


def _between(low: float, high: float, share: float) -> float:
    """A threshold in [low, high), so that rows lie on both sides even where the two are neighbouring doubles."""
    return min(max(low * (1.0 - share) + high * share, low), float(np.nextafter(high, low)))


def _grow(points: np.ndarray, tree: int, depth_limit: int, rng: np.random.Generator) -> list[tuple]:
    """Node rows of one isolation tree. An inner node names its left child; the right one
    follows it. A leaf is its own child behind an infinite threshold, so descending past
    it changes nothing. Infinite values count as the largest double."""
    points = np.clip(points, -sys.float_info.max, sys.float_info.max)
    nodes: list[tuple | None] = [None]
    todo = [(np.arange(len(points)), 0, 0)]
    while todo:
        rows, depth, node = todo.pop()
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= depth_limit or len(rows) <= 1 or len(varying) == 0:
            nodes[node] = (tree, node, 0, np.inf, node, depth + float(mean_path(len(rows))))
            continue
        feature = int(rng.choice(varying))
        threshold = _between(low[feature], high[feature], rng.random())
        child = len(nodes)
        nodes[node] = (tree, node, feature, threshold, child, 0.0)
        nodes += [None, None]
        above = points[rows, feature] > threshold
        todo.append((rows[above], depth + 1, child + 1))
        todo.append((rows[~above], depth + 1, child))
    return nodes


@dataclass(frozen=True)
class Forest:
    """A fitted forest: one padded row of nodes per tree in each array."""

    features: tuple[str, ...]
    sample_size: int
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    path: np.ndarray

    def nodes(self) -> tuple[np.ndarray, ...]:
        return self.feature, self.threshold, self.child, self.path


def anomaly(points: np.ndarray, nodes: tuple[np.ndarray, ...], depth: int, sample_size: int) -> np.ndarray:
    """Score in (0, 1] per point; higher is more isolated."""
    feature, threshold, child, path = nodes
    total = np.zeros(len(points))
    columns = np.ascontiguousarray(points.T).ravel()
    rows, width = np.arange(len(points)), len(points)
    for t in range(len(feature)):
        node = np.zeros(width, dtype=np.intp)
        for _ in range(depth):
            value = columns.take(feature[t].take(node) * width + rows)
            node = child[t].take(node) + (value > threshold[t].take(node))
        total += path[t].take(node)
    return np.exp2(-total / len(feature) / float(mean_path(sample_size)))


def fit_forest(train: DataFrame, features: Sequence[str], key: str, settings: ForestSettings) -> Forest:
    """Grow the trees on hash samples of the (scaled) training rows."""
    features = list(features)
    n = train.count()
    size = min(settings.sample_size, n)
    if size < 2:
        raise ValueError("an isolation forest needs at least two training rows")
    depth_limit = int(np.ceil(np.log2(size)))
    seed = settings.seed

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_pick").head(size)
        tree = int(frame["tree"].iloc[0])
        points = frame[features].to_numpy(dtype=float)
        nodes = _grow(points, tree, depth_limit, np.random.default_rng([seed, tree]))
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "child", "path"])

    narrow = train.select(key, *features)
    # An explicit task count: growing trees is slow for its few bytes.
    tasks = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = sample_rows(narrow, n, key, settings).drop(key).repartition(min(tasks, settings.n_trees), "tree")
    drawn = stored(drawn)
    short = drawn.groupBy("tree").count().filter(F.col("count") < size).count()
    nodes = drawn.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()

    trees = sorted(nodes["tree"].unique())
    if len(trees) < settings.n_trees or short:
        raise RuntimeError(f"{settings.n_trees - len(trees)} trees without rows, {short} with fewer than {size}")
    width = int(nodes.groupby("tree").size().max())
    slot = nodes["tree"].map({t: i for i, t in enumerate(trees)}).to_numpy()
    at = nodes["node"].to_numpy()

    def padded(column: str, dtype) -> np.ndarray:
        table = np.zeros((len(trees), width), dtype=dtype)
        table[slot, at] = nodes[column].to_numpy()
        return table

    return Forest(
        tuple(features), size, depth_limit,
        padded("feature", np.intp), padded("threshold", float), padded("child", np.intp), padded("path", float),
    )


def apply_forest(df: DataFrame, forest: Forest, carry: Sequence[str] = ("tender_id",)) -> DataFrame:
    """The carried columns and ``anomaly`` for every row. Nothing but those columns and
    the features enters Python, and no shuffle is needed."""
    shared = df.sparkSession.sparkContext.broadcast(forest.nodes())
    depth, size = forest.depth, forest.sample_size
    features, carry = list(forest.features), list(carry)
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in carry)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            points = frame[features].to_numpy(dtype=float)
            yield frame[carry].assign(anomaly=anomaly(points, shared.value, depth, size))

    return df.select(*carry, *features).mapInPandas(score, f"{schema}, anomaly double")


def _fitted(
    tenders: DataFrame, features: Sequence[str], settings: ForestSettings, key: str
) -> tuple[DataFrame, bool, Scaling, Forest]:
    """(the rows to score with key, split and features; whether these are all rows; scaling and forest of the past rows,
    or of all without any)."""
    split = temporal_split(tenders, settings.cut_year).select(key, "split", *features)
    train = split.filter(F.col("split") == "train")
    scored = split.filter(F.col("split").isNotNull())
    without_past = train.isEmpty()
    if without_past:
        train = scored = split.withColumn("split", F.lit("all"))
    scaling = fit_scaling(train, features)
    return scored, without_past, scaling, fit_forest(scale(train, scaling), features, key, settings)


def isolation_scores(
    tenders: DataFrame, features: Sequence[str], settings: ForestSettings = ForestSettings(), key: str = "tender_id"
) -> DataFrame:
    """(key, split, anomaly): trained on the past only, each row scored once.

    Without any past rows the forest is trained on everything, and every row is scored;
    otherwise rows without a publication year get no score.
    """
    features = [f for f in features if f in tenders.columns]
    scored, _, scaling, forest = _fitted(tenders, features, settings, key)
    return apply_forest(scale(scored, scaling), forest, (key, "split"))


def anomaly_column(
    tenders: DataFrame, features: Sequence[str], settings: ForestSettings = ForestSettings(), key: str = "tender_id"
) -> Column:
    """What joining ``isolation_scores`` by ``key`` gives each row, as a column for ``tenders`` or for what was made
    of its rows: only the features enter Python, and the other columns of a wide row stay where they are."""
    features = [f for f in features if f in tenders.columns]
    _, every_row, scaling, forest = _fitted(tenders, features, settings, key)
    shared = tenders.sparkSession.sparkContext.broadcast(forest.nodes())
    depth, size = forest.depth, forest.sample_size

    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(anomaly(np.column_stack(columns), shared.value, depth, size))

    columns = scaled_columns(scaling)
    found = F.pandas_udf(score, "double")(*[columns[f] for f in forest.features])
    return F.when(F.col(key).isNotNull() & (F.lit(every_row) | F.year("published_at").isNotNull()), found)


def anomaly_rate(scores: DataFrame, contamination: float = 0.05) -> DataFrame:
    """Percent of rows per split above the training scores' (1 - contamination) quantile."""
    train = scores.filter(F.col("split").isin("train", "all"))
    cut = exact_quantiles(train, ["anomaly"], 1.0 - contamination)["anomaly"]
    return scores.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        (F.avg((F.col("anomaly") > F.lit(cut)).cast("int")) * 100).alias("anomaly_pct"),
    )
