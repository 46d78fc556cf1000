"""Order statistics, top-k and running positions that hold when one key is huge.

Nothing here gathers an unbounded group in one task: medians narrow a bracket by
aggregation, top-k merges in two steps, and running positions of a hot key are read
off a range-partitioned layout instead of a single window partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.session import stored

# Values an exact step may hold in one aggregation buffer.
DIRECT_LIMIT = 200_000
# Rows of one key that a single window task may sort (it spills, so this is generous).
HOT_KEY_ROWS = 5_000_000


@dataclass
class _Target:
    """One order statistic being narrowed: the rank-th value strictly inside (low, high)."""

    column: str
    rank: int
    inside: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def values(self) -> Column:
        v = F.col(self.column).cast("double")
        keep = v.isNotNull()
        if self.low is not None:
            keep = keep & (v > self.low)
        if self.high is not None:
            keep = keep & (v < self.high)
        return F.when(keep, v)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    q: float = 0.5,
    direct_limit: int = DIRECT_LIMIT,
    accuracy: int = 10_000,
    counts: dict[str, int] | None = None,
) -> dict[str, float | None]:
    """Exact interpolated quantile of every column (null for an all-null column).

    Columns with few values take one ``percentile``. Larger ones shrink an open bracket
    around the wanted rank, by roughly ``accuracy`` per pass over the data, until the
    remaining values fit one buffer. All columns share each pass. Known non-null
    ``counts`` save the counting pass.
    """
    columns = list(columns)
    if not columns:
        return {}
    if counts is None:
        row = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        counts = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    n = counts

    small = [c for c in columns if 0 < n[c] <= direct_limit]
    result: dict[str, float | None] = {c: None for c in columns}
    if small:
        row = df.agg(*[
            F.percentile(F.col(c).cast("double"), F.lit(q)).alias(f"p{i}")
            for i, c in enumerate(small)
        ]).first()
        result.update({c: row[f"p{i}"] for i, c in enumerate(small)})

    large = [c for c in columns if n[c] > direct_limit]
    if large:
        targets = []
        for c in large:
            low_rank = int((n[c] - 1) * q)
            targets += [_Target(c, r, n[c]) for r in (low_rank, min(low_rank + 1, n[c] - 1))]
        _narrow(df, targets, direct_limit, accuracy)
        for c, low, high in zip(large, targets[::2], targets[1::2]):
            share = (n[c] - 1) * q - low.rank0
            result[c] = low.value if share == 0 else low.value + (high.value - low.value) * share
    return result


def _narrow(df: DataFrame, targets: list[_Target], direct_limit: int, accuracy: int) -> None:
    for t in targets:
        t.rank0 = t.rank
    margin = 2.0 / accuracy
    while open_ := [t for t in targets if t.value is None and t.inside > direct_limit]:
        # Ranks inside the same bracket are read off one sketch: the two ranks of a median cost one.
        sketches: dict[tuple, list[_Target]] = {}
        for t in open_:
            sketches.setdefault((t.column, t.low, t.high), []).append(t)
        row = df.agg(*[
            F.percentile_approx(
                same[0].values(),
                [p for t in same for p in (max(0.0, t.rank / t.inside - margin), min(1.0, (t.rank + 1) / t.inside + margin))],
                accuracy,
            ).alias(f"s{i}")
            for i, same in enumerate(sketches.values())
        ]).first()
        found = {id(t): row[f"s{i}"][2 * j : 2 * j + 2] for i, same in enumerate(sketches.values()) for j, t in enumerate(same)}
        brackets = {f"b{i}": found[id(t)] for i, t in enumerate(open_)}
        counts = df.agg(*[
            F.count_if(test).alias(f"{name}{i}")
            for i, t in enumerate(open_)
            for name, test in {
                "below": t.values() < brackets[f"b{i}"][0],
                "at_low": t.values() == brackets[f"b{i}"][0],
                "between": (t.values() > brackets[f"b{i}"][0]) & (t.values() < brackets[f"b{i}"][1]),
                "at_high": t.values() == brackets[f"b{i}"][1],
            }.items()
        ]).first()
        for i, t in enumerate(open_):
            low, high = brackets[f"b{i}"]
            below, at_low = counts[f"below{i}"], counts[f"at_low{i}"]
            between, at_high = counts[f"between{i}"], counts[f"at_high{i}"]
            if t.rank < below:
                t.high, t.inside = low, below
            elif t.rank < below + at_low:
                t.value = low
            elif t.rank < below + at_low + between:
                t.low, t.high = low, high
                t.rank -= below + at_low
                t.inside = between
            elif t.rank < below + at_low + between + at_high:
                t.value = high
            else:
                rest = below + at_low + between + (at_high if high > low else 0)
                t.low = high
                t.rank -= rest
                t.inside -= rest
    last = [t for t in targets if t.value is None]
    if last:
        row = df.agg(*[
            F.array_sort(F.collect_list(t.values()))[t.rank].alias(f"v{i}")
            for i, t in enumerate(last)
        ]).first()
        for i, t in enumerate(last):
            t.value = row[f"v{i}"]


def keep_top(df: DataFrame, order: Sequence[Column], k: int, spread_on: Column, groups: int = 64) -> DataFrame:
    """The first ``k`` rows by ``order``; a per-group cut runs before the final merge,
    so the last task sees at most ``groups * k`` rows however many partitions feed it."""
    slot = Window.partitionBy("_slot").orderBy(*order)
    return (
        df.withColumn("_slot", F.pmod(F.xxhash64(spread_on), F.lit(groups)))
        .withColumn("_rank", F.row_number().over(slot))
        .filter(F.col("_rank") <= k)
        .drop("_slot", "_rank")
        .orderBy(*order)
        .limit(k)
    )


def top_by_count(df: DataFrame, count: str, name: str, k: int) -> DataFrame:
    """The ``k`` rows of greatest ``count``; equal counts are cut in the order of ``name``. Give it a stored table.

    Rows are never sorted together. How many rows have each count says at which count the
    cut falls (there are far fewer different counts than rows); rows above it pass a filter,
    and only rows with just that count are ordered, each task for itself first.
    """
    sizes = df.groupBy(count).agg(F.count("*").alias("_rows"))
    down = Window.orderBy(F.desc(count)).rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        sizes.withColumn("_sum", F.sum("_rows").over(down)).filter(F.col("_sum") >= k)
        .agg(F.max_by(F.struct(F.col(count).alias("at"), (F.col("_sum") - F.col("_rows")).alias("above")), count).alias("c")).first()["c"]
    )
    if cut is None:
        return df
    tied = df.filter(F.col(count) == cut["at"]).orderBy(F.asc(name)).limit(k - cut["above"])
    return df.filter(F.col(count) > cut["at"]).unionByName(tied)


def _renamed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """``df`` with its keys renamed, and the null-safe condition matching them by name."""
    renamed = df.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return renamed, match


def layout_positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add the 0-based position of each row inside its key, for keys of any size.

    Rows are range-partitioned by (keys, order), so a large key spans several partitions.
    A row's position is the size of its key's earlier partitions plus its offset in its
    own; the layout is stored because partition bounds come from a sample.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = df.columns
    sort_key = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    laid = stored(
        df.repartitionByRange(parts, *sort_key)
        .sortWithinPartitions(*sort_key)
        .withColumn("_seq", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_seq", 33))
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        laid.groupBy(*keys, "_part")
        .agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    )
    runs, match = _renamed(runs, [*keys, "_part"])
    return laid.join(runs, match).select(
        *columns, (F.col("_base") + F.col("_seq") - F.col("_first")).alias(name)
    )


def hot_keys(df: DataFrame, key_sets: Sequence[Sequence[str]], limit: int) -> list[DataFrame | None]:
    """Per key set, the keys holding more than ``limit`` rows (None when there are none).

    Each list has at most rows/limit entries, which is what makes it safe to broadcast.
    """
    names = sorted({k for keys in key_sets for k in keys})
    grouped = (
        df.groupingSets([list(keys) for keys in key_sets], *names)
        .agg(F.count("*").alias("_n"), F.grouping_id().alias("_set"))
        .filter(F.col("_n") > limit)
    )
    found = stored(grouped)
    present = {r["_set"] for r in found.select("_set").distinct().collect()}
    result: list[DataFrame | None] = []
    for keys in key_sets:
        bits = sum(1 << i for i, c in enumerate(reversed(names)) if c not in keys)
        result.append(found.filter(F.col("_set") == bits).select(*keys) if bits in present else None)
    return result


def running_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add the number of earlier rows of the same key.

    Ordinary keys use one window; keys listed in ``hot`` take the range layout.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    position = (F.row_number().over(window) - 1).cast("long")
    if hot is None:
        return df.withColumn(name, position)
    listed, match = _renamed(hot, keys)
    ordinary = df.join(F.broadcast(listed), match, "left_anti").withColumn(name, position)
    large = df.join(F.broadcast(listed), match, "left_semi")
    return ordinary.unionByName(layout_positions(large, keys, order, name))
