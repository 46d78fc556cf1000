"""Buyer-supplier graph: weighted edges, modularity communities, community features.

Communities come from repeated parallel local moves followed by contraction. Each sweep is
one job over (vertex, neighbouring community) weights. Up to ``HELD_VERTICES`` vertices the
driver holds which vertex is in which community, sends that to the tasks, which hold the
links, and gets the movers back; above, the state is a table too, sweeps are joins, and only
counters reach the driver. Vertices that are linked never move in the same sweep of the
bipartite level, and a sweep is kept only if modularity rises, so the result does not depend
on task order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tenderlens.config import GraphSettings
from tenderlens.operators.selection import layout_positions
from tenderlens.session import planned_small, stored

MIN_GAIN = 1e-9
# Vertices of a level that the driver holds, some 50 bytes each; a task gets 12 bytes of each.
HELD_VERTICES = 8_000_000
# Links in a row of packed ones, some 4 MB; the links of one vertex are in one row, at most one for each vertex.
PACKED_LINKS = 250_000


# Awards without a buyer id share one node; its name can't be that of a buyer.
NO_BUYER = "I?"


def buyer_node(buyer: Column) -> Column:
    return F.coalesce(F.concat(F.lit("I:"), buyer.cast("string")), F.lit(NO_BUYER))


def supplier_node(supplier: Column) -> Column:
    return F.concat(F.lit("P:"), supplier.cast("string"))


def pair_edges(tenders: DataFrame, score_col: str = "rule_score") -> DataFrame:
    """Awards per (buyer, supplier): count, amount, mean score, first labels (50 chars).
    A missing buyer is a buyer like any other."""
    label = F.col("tender_id")
    return (
        tenders.filter(F.col("winner_id").isNotNull())
        .groupBy("buyer_id", "winner_id")
        .agg(
            F.count("*").alias("n_awards"),
            F.coalesce(F.sum("awarded_amount"), F.lit(0.0)).alias("amount"),
            F.avg(score_col).alias("mean_score"),
            F.substring(F.min_by("institution", label), 1, 50).alias("buyer_label"),
            F.substring(F.min_by("winner_name", label), 1, 50).alias("supplier_label"),
        )
    )


def graph_edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        buyer_node(F.col("buyer_id")).alias("src"),
        supplier_node(F.col("winner_id")).alias("dst"),
        F.col("n_awards").cast("double").alias("weight"),
        "amount",
        F.col("mean_score").alias("score"),
    )


def graph_vertices(pairs: DataFrame) -> DataFrame:
    """Each node once, with its kind and the label of its first edge."""
    sides = F.inline(F.array(
        F.struct(buyer_node(F.col("buyer_id")).alias("id"), F.lit("buyer").alias("kind"),
                 F.col("buyer_label").alias("label"), F.col("winner_id").cast("string").alias("other")),
        F.struct(supplier_node(F.col("winner_id")).alias("id"), F.lit("supplier").alias("kind"),
                 F.col("supplier_label").alias("label"), F.coalesce(F.col("buyer_id").cast("string"), F.lit("")).alias("other")),
    ))
    return pairs.select(sides).groupBy("id", "kind").agg(F.min_by("label", "other").alias("label"))


def graph_summary(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and density 2m / (n (n - 1))."""
    nodes = edges.select(F.inline(F.array(F.struct(F.col("src").alias("id")), F.struct(F.col("dst").alias("id")))))
    counts = nodes.distinct().agg(F.count("*").alias("n_nodes"))
    n, m = F.col("n_nodes"), F.col("n_edges")
    return (
        counts.withColumn("n_edges", edges.agg(F.count("*").alias("n")).scalar())
        .withColumn("density", F.when(n > 1, 2.0 * m / (n * (n - 1))).otherwise(0.0))
    )


# --- communities -------------------------------------------------------------------


@dataclass
class _Level:
    """A graph of integer vertices: both directions of every edge, and vertex degrees.

    ``links``: src, dst, w with src != dst. ``vertices``: v, degree, loop (twice the
    weight inside the vertex), colour (0/1).
    """

    links: DataFrame
    vertices: DataFrame
    total: float


def _first_level(edges: DataFrame) -> tuple[_Level, DataFrame]:
    named = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    ends = F.inline(F.array(
        F.struct(F.col("src").alias("id"), F.lit(0).alias("colour"), F.col("weight").alias("w")),
        F.struct(F.col("dst").alias("id"), F.lit(1).alias("colour"), F.col("weight").alias("w")),
    ))
    nodes = named.select(ends).groupBy("id", "colour").agg(F.sum("w").alias("degree"))
    index = stored(layout_positions(nodes, [], [F.asc("id")], "v"))
    src = index.select(F.col("id").alias("src"), F.col("v").alias("src_v"))
    dst = index.select(F.col("id").alias("dst"), F.col("v").alias("dst_v"))
    numbered = named.join(src, "src").join(dst, "dst")
    links = numbered.select(F.inline(F.array(
        F.struct(F.col("src_v").alias("src"), F.col("dst_v").alias("dst"), F.col("weight").alias("w")),
        F.struct(F.col("dst_v").alias("src"), F.col("src_v").alias("dst"), F.col("weight").alias("w")),
    )))
    links = stored(links)
    total = index.agg(F.sum("degree").alias("t")).first()["t"] or 0.0
    vertices = index.select("v", "degree", F.lit(0.0).alias("loop"), "colour")
    return _Level(links, vertices, total), index.select("v", "id")


def _proposals(level: _Level, state: DataFrame, resolution: float) -> DataFrame:
    """Per vertex: weight into its own community, that community's total, and the best
    other community with its gain over staying. ``state``: v, degree, loop, colour, comm."""
    totals = state.groupBy("comm").agg(F.sum("degree").alias("comm_total"))
    placed = state.join(totals, "comm")
    near = placed.select(F.col("v").alias("dst"), F.col("comm").alias("to_comm"), F.col("comm_total").alias("to_total"))
    reach = (
        level.links.join(near, "dst")
        .groupBy(F.col("src").alias("v"), "to_comm")
        .agg(F.sum("w").alias("k"), F.max("to_total").alias("to_total"))
    )
    joined = placed.join(reach, "v", "left")
    pull = F.col("degree") * F.lit(resolution / level.total)
    own = F.col("to_comm") == F.col("comm")
    score = F.col("k") - pull * F.col("to_total")
    best = F.struct(score.alias("score"), (-F.col("to_comm")).alias("tie"))
    summed = joined.groupBy("v", "degree", "loop", "colour", "comm", "comm_total").agg(
        F.coalesce(F.max(F.when(own, F.col("k"))), F.lit(0.0)).alias("k_own"),
        F.max(F.when(~own & F.col("to_comm").isNotNull(), best)).alias("best"),
    )
    stay = F.col("k_own") - pull * (F.col("comm_total") - F.col("degree"))
    return summed.select(
        "v", "degree", "loop", "colour", "comm", "comm_total", "k_own",
        (-F.col("best.tie")).alias("best_comm"),
        F.coalesce(F.col("best.score") - stay, F.lit(0.0)).alias("gain"),
    )


@dataclass
class _Position:
    """An evaluated assignment: its proposals, modularity and movers per colour."""

    proposals: DataFrame
    modularity: float
    movers: tuple[int, int]

    def state(self) -> DataFrame:
        return self.proposals.select("v", "degree", "loop", "colour", "comm")


def _evaluate(level: _Level, state: DataFrame, resolution: float) -> _Position:
    willing = F.col("gain") > MIN_GAIN
    # Summed up while the table is written, so a sweep is one job.
    seen = Observation()
    proposals = stored(_proposals(level, state, resolution).observe(
        seen,
        F.sum(F.col("k_own") + F.col("loop")).alias("inside"),
        F.sum(F.col("degree") * F.col("comm_total")).alias("squares"),
        F.count_if(willing & (F.col("colour") == 0)).alias("m0"),
        F.count_if(willing & (F.col("colour") == 1)).alias("m1"),
    ))
    row = seen.get
    total = level.total
    modularity = row["inside"] / total - resolution * row["squares"] / (total * total)
    return _Position(proposals, modularity, (row["m0"], row["m1"]))


def _moved(position: _Position, colour: int, least_gain: float) -> DataFrame:
    move = (F.col("colour") == colour) & (F.col("gain") > MIN_GAIN) & (F.col("gain") >= least_gain)
    return position.proposals.select(
        "v", "degree", "loop", "colour",
        F.when(move, F.col("best_comm")).otherwise(F.col("comm")).alias("comm"),
    )


def _top_quarter_gain(position: _Position, colour: int) -> float:
    movers = position.proposals.filter((F.col("colour") == colour) & (F.col("gain") > MIN_GAIN))
    return movers.agg(F.percentile_approx("gain", 0.75).alias("g")).first()["g"]


class _Joined:
    """Sweeps of a level as joins of its links and a table of its vertices."""

    def __init__(self, level: _Level, resolution: float):
        self.level, self.resolution = level, resolution

    def start(self) -> _Position:
        return _evaluate(self.level, self.level.vertices.withColumn("comm", F.col("v")), self.resolution)

    def moved(self, position: _Position, colour: int, least_gain: float = 0.0) -> _Position:
        return _evaluate(self.level, _moved(position, colour, least_gain), self.resolution)

    def top_quarter_gain(self, position: _Position, colour: int) -> float:
        return _top_quarter_gain(position, colour)

    def step(self, position: _Position) -> DataFrame:
        """(v, comm) of every vertex."""
        return position.proposals.select("v", "comm")

    def contract(self, position: _Position) -> _Level:
        return _contract(self.level, position)


@dataclass
class _HeldPosition:
    """As ``_Position``, by places of vertices in their order: every vertex's community, the vertices that would gain
    by moving, where to, and how much."""

    comm: np.ndarray
    willing: np.ndarray
    best: np.ndarray
    gains: np.ndarray
    modularity: float
    movers: tuple[int, int]


_LINK_ROWS = "src binary, n_links binary, degree binary, dst binary, w binary"


def _packed_links(level: _Level, ids: np.ndarray, degree: np.ndarray) -> DataFrame:
    """The links, stored in rows of some ``PACKED_LINKS``: the vertices they leave, how many leave each, and where to.
    Vertices are named by their place in ``ids``."""
    spark, most = level.links.sparkSession, PACKED_LINKS
    shared = spark.sparkContext.broadcast((ids, degree))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, degree = shared.value

        def row(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
            at = np.searchsorted(ids, src[first])
            n_links = np.diff(np.r_[first, len(src)])
            columns = [at.astype("i4"), n_links.astype("i4"), degree[at], np.searchsorted(ids, dst).astype("i4"), w]
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], "binary") for c in columns], [c.split()[0] for c in _LINK_ROWS.split(", ")])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("src", "dst", "w")))
            if sum(len(x[0]) for x in held) >= most and held[-1][0][0] != held[-1][0][-1]:
                src, dst, w = (np.concatenate(c) for c in zip(*held))
                cut = np.searchsorted(src, src[-1])  # the last vertex may go on in the next batch
                yield row(src[:cut], dst[:cut], w[:cut])
                held = [(src[cut:], dst[cut:], w[cut:])]
        if held:
            yield row(*(np.concatenate(c) for c in zip(*held)))

    parts = -(-level.links.count() // most)
    ordered = level.links.repartitionByRange(max(1, parts), "src").sortWithinPartitions("src", "dst")
    rows = stored(ordered.mapInArrow(packed, _LINK_ROWS))
    shared.destroy()
    return rows


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Each row of packed links: vertices, links of each, their degrees, and where links lead with their weights."""
    kinds = ("i4", "i4", "f8", "i4", "f8")
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield tuple(np.frombuffer(x, k) for x, k in zip(row, kinds))


def _sums(rows: np.ndarray, columns: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights summed up by (row, column), both below ``n``, in their order."""
    key = rows.astype("i8") * n + columns
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first] // n, key[first] % n, np.add.reduceat(w[order], first)


def _best_moves(src, n_links, degree, dst, w, comm, totals, pull) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Of the vertices ``src``: their weight into their own communities in all, and for each that gains by moving its
    place, the best community (of equal ones the first) and the gain; as ``_proposals``."""
    at, to, k = _sums(np.repeat(np.arange(len(src)), n_links), comm[dst], w, len(comm))
    pull, home = degree * pull, comm[src]
    own = to == home[at]
    k_own = np.zeros(len(src))
    k_own[at[own]] = k[own]
    at, to = at[~own], to[~own]
    if not len(at):
        return k_own.sum(), src[:0], comm[:0], degree[:0]
    score = k[~own] - pull[at] * totals[to]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    top = np.maximum.reduceat(score, first)
    best = np.flatnonzero(score == np.repeat(top, np.diff(np.r_[first, len(at)])))
    best = best[np.r_[True, at[best][1:] != at[best][:-1]]]
    at = at[first]
    gain = top - (k_own[at] - pull[at] * (totals[home[at]] - degree[at]))
    willing = gain > MIN_GAIN
    return k_own.sum(), src[at[willing]], to[best][willing].astype(comm.dtype), gain[willing]


class _Held:
    """Sweeps of a level whose vertices the driver holds in arrays; its links are stored once, in packed rows."""

    def __init__(self, level: _Level, resolution: float):
        self.level, self.resolution = level, resolution
        self.spark = level.links.sparkSession
        vertices = level.vertices.select("v", "degree", "loop", "colour").toArrow()
        ids, degree, loop, colour = (c.to_numpy() for c in vertices.columns)
        order = np.argsort(ids)
        self.ids, self.degree, self.loop, self.colour = ids[order], degree[order], loop[order], colour[order]
        self.links = _packed_links(level, self.ids, self.degree)

    def start(self) -> _HeldPosition:
        return self._evaluate(np.arange(len(self.ids), dtype="i4"))

    def moved(self, position: _HeldPosition, colour: int, least_gain: float = 0.0) -> _HeldPosition:
        move = (self.colour[position.willing] == colour) & (position.gains >= least_gain)
        comm = position.comm.copy()
        comm[position.willing[move]] = position.best[move]
        return self._evaluate(comm)

    def top_quarter_gain(self, position: _HeldPosition, colour: int) -> float:
        gains = position.gains[self.colour[position.willing] == colour]
        at = math.ceil(0.75 * len(gains)) - 1
        return float(np.partition(gains, at)[at])

    def step(self, position: _HeldPosition) -> DataFrame:
        """(v, comm) of every vertex."""
        return self.spark.createDataFrame(pa.table({"v": self.ids, "comm": self.ids[position.comm]}))

    def _evaluate(self, comm: np.ndarray) -> _HeldPosition:
        total = self.level.total
        totals = np.bincount(comm, self.degree, len(comm))
        pull = self.resolution / total
        shared = self.spark.sparkContext.broadcast((comm, totals))

        def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            comm, totals = shared.value
            for row in _unpacked(batches):
                inside, *found = _best_moves(*row, comm, totals, pull)
                columns = [pa.array([float(inside)]), *(pa.array([x.tobytes()], "binary") for x in found)]
                yield pa.RecordBatch.from_arrays(columns, ["inside", "v", "best", "gain"])

        rows = self.links.mapInArrow(moves, "inside double, v binary, best binary, gain binary").toArrow().to_pydict()
        shared.destroy()
        willing, best, gains = (
            np.frombuffer(b"".join(rows[c]), kind) for c, kind in (("v", "i4"), ("best", "i4"), ("gain", "f8"))
        )
        modularity = (
            (math.fsum(rows["inside"]) + self.loop.sum()) / total
            - self.resolution * np.dot(self.degree, totals[comm]) / (total * total)
        )
        second = int(np.count_nonzero(self.colour[willing]))
        return _HeldPosition(comm, willing, best, gains, float(modularity), (len(willing) - second, second))

    def contract(self, position: _HeldPosition) -> _Level:
        """As ``_contract``: links are summed up in their rows before they are shuffled."""
        shared = self.spark.sparkContext.broadcast((position.comm, self.ids))

        def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            comm, ids = shared.value
            for src, n_links, _, dst, w in _unpacked(batches):
                a, b, w = _sums(np.repeat(comm[src], n_links), comm[dst], w, len(comm))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], ids[b], w)], ["src", "dst", "w"])

        partial = self.links.mapInArrow(between, "src long, dst long, w double")
        links = stored(partial.groupBy("src", "dst").agg(F.sum("w").alias("w")))
        shared.destroy()
        inside = links.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("v"), "w")
        at = np.unique(position.comm)
        sums = (np.bincount(position.comm, x, len(self.ids))[at] for x in (self.degree, self.loop))
        held = self.spark.createDataFrame(pa.table(dict(zip(("v", "degree", "loop"), (self.ids[at], *sums)))))
        vertices = held.join(inside, "v", "left").select(
            "v", "degree", (F.col("loop") + F.coalesce("w", F.lit(0.0))).alias("loop"),
            F.pmod(F.xxhash64("v"), F.lit(2)).cast("int").alias("colour"),
        )
        return _Level(links.filter(F.col("src") != F.col("dst")), stored(vertices), self.level.total)


def _settle(level: _Level, settings: GraphSettings, held: int = HELD_VERTICES) -> tuple[_Joined | _Held, _Position | _HeldPosition]:
    """Move colours in turn until neither raises modularity enough. A bound on sweeps that is
    reached is an error, not an early result."""
    sweeps = (_Held if level.vertices.count() <= held else _Joined)(level, settings.resolution)
    position = sweeps.start()
    idle, colour = 0, 0
    for sweep in count():
        if idle == 2 or position.movers == (0, 0):
            break
        if settings.max_sweeps is not None and sweep >= settings.max_sweeps:
            raise RuntimeError(f"communities: modularity still rises after {sweep} sweeps of a level")
        before = position.modularity
        if position.movers[colour]:
            tried = sweeps.moved(position, colour)
            if tried.modularity <= before + MIN_GAIN and position.movers[colour] > 1:
                tried = sweeps.moved(position, colour, sweeps.top_quarter_gain(position, colour))
            if tried.modularity > before + MIN_GAIN:
                position = tried
        idle = 0 if position.modularity >= before + settings.min_rise else idle + 1
        colour = 1 - colour
    return sweeps, position


def _contract(level: _Level, position: _Position) -> _Level:
    """Communities become vertices; weight inside them becomes their loop."""
    state = position.proposals.select("v", "comm")
    a = state.select(F.col("v").alias("src"), F.col("comm").alias("src_comm"))
    b = state.select(F.col("v").alias("dst"), F.col("comm").alias("dst_comm"))
    links = (
        level.links.join(b, "dst").join(a, "src")
        .filter(F.col("src_comm") != F.col("dst_comm"))
        .groupBy(F.col("src_comm").alias("src"), F.col("dst_comm").alias("dst"))
        .agg(F.sum("w").alias("w"))
    )
    vertices = position.proposals.groupBy(F.col("comm").alias("v")).agg(
        F.sum("degree").alias("degree"), F.sum(F.col("loop") + F.col("k_own")).alias("loop")
    ).withColumn("colour", F.pmod(F.xxhash64("v"), F.lit(2)).cast("int"))
    return _Level(stored(links), stored(vertices), level.total)


def connected_parts(links: DataFrame, member: DataFrame) -> DataFrame:
    """(v, comm) with every community's connected parts as communities of their own, named by their least vertex.

    ``links`` (src, dst) hold both directions, ``member`` is (v, comm). Apart from each other, parts share no
    weight, so modularity never falls. Only links inside communities are kept. A round gives every vertex the
    least name among its own and its neighbours', then that of the vertex it is named by; so names travel twice as
    far in each round, and rounds grow with the logarithm of a part's extent in all but odd cases.
    """
    side = member.select(F.col("v").alias("_v"), F.col("comm").alias("_comm"))
    inside = (
        links.join(member.withColumnsRenamed({"v": "src", "comm": "_own"}), "src").join(side, F.col("dst") == F.col("_v"))
        .filter(F.col("_own") == F.col("_comm")).select("src", "dst")
    )
    inside = stored(inside)
    state = stored(member.select("v", F.col("v").alias("part")))
    while True:
        near = state.select(F.col("v").alias("dst"), F.col("part").alias("_near"))
        least = inside.join(near, "dst").groupBy(F.col("src").alias("v")).agg(F.min("_near").alias("_near"))
        hooked = stored(state.join(least, "v", "left").select("v", "part", F.least("part", "_near").alias("_new")))
        if hooked.filter(F.col("_new") < F.col("part")).isEmpty():
            return state.select("v", F.col("part").alias("comm"))
        # A vertex that names many others is one row here; the many are spread by adaptive execution.
        named = hooked.select(F.col("v").alias("_new"), F.col("_new").alias("_next"))
        state = stored(hooked.join(named, "_new").select("v", F.col("_next").alias("part")))


def communities(
    edges: DataFrame, settings: GraphSettings = GraphSettings(), held: int = HELD_VERTICES
) -> DataFrame:
    """(id, community) for every node, communities numbered by size, largest first.

    Equal sizes are ordered by their smallest node id. Every community is connected: what moves and
    contraction left apart is split at the end. A level of more than ``held`` vertices is swept by joins.
    """
    level, names = _first_level(edges)
    links = level.links
    if level.total == 0:
        return names.select("id", F.lit(0).cast("int").alias("community"))
    member = names.select("id", F.col("v").alias("comm"), F.col("v").alias("rank"))
    reached = None
    for depth in count():
        if settings.max_levels is not None and depth >= settings.max_levels:
            raise RuntimeError(f"communities: modularity still rises after {depth} levels")
        with planned_small(edges.sparkSession, level.links.count()):
            sweeps, position = _settle(level, settings, held)
        if reached is not None and position.modularity <= reached + MIN_GAIN:
            break
        last = reached is not None and position.modularity < reached + settings.min_rise
        reached = position.modularity
        step = sweeps.step(position).select(F.col("v").alias("comm"), F.col("comm").alias("next"))
        member = stored(member.join(step, "comm").select("id", "rank", F.col("next").alias("comm")))
        if last:
            break
        level = sweeps.contract(position)
    parts = connected_parts(links, member.select(F.col("rank").alias("v"), "comm"))
    return number_by_size(member.select("id", "rank").join(parts.withColumnRenamed("v", "rank"), "rank"))


def number_by_size(member: DataFrame) -> DataFrame:
    """Relabel ``comm`` to 0.. by member count; ``rank`` breaks ties."""
    sizes = member.groupBy("comm").agg(F.count("*").alias("size"), F.min("rank").alias("least"))
    ranked = layout_positions(sizes, [], [F.desc("size"), F.asc("least")], "community")
    return member.join(ranked.select("comm", F.col("community").cast("int")), "comm").select("id", "community")


def modularity(edges: DataFrame, assignment: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of an (id, community) assignment."""
    a = assignment.select(F.col("id").alias("src"), F.col("community").alias("a"))
    b = assignment.select(F.col("id").alias("dst"), F.col("community").alias("b"))
    placed = edges.join(a, "src").join(b, "dst")
    per = (
        placed.select(F.inline(F.array(
            F.struct(F.col("a").alias("c"), F.col("weight").alias("w"), (F.col("a") == F.col("b")).alias("same")),
            F.struct(F.col("b").alias("c"), F.col("weight").alias("w"), (F.col("a") == F.col("b")).alias("same")),
        )))
        .groupBy("c")
        .agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("same"), F.col("w")).otherwise(0.0)).alias("inside"))
    )
    total = F.sum("degree")
    squares = F.sum(F.col("degree") * F.col("degree"))
    return per.agg((F.sum("inside") / total - resolution * squares / (total * total)).alias("modularity"))


# --- features -----------------------------------------------------------------------


def attach_community_features(
    tenders: DataFrame, assignment: DataFrame, score_col: str = "rule_score", fit_until: int | None = None
) -> DataFrame:
    """Add community_id (-1 outside the graph), its mean score and single-bidder rate.

    ``fit_until`` takes the statistics from tenders published before that year only.
    """
    # Both small sides are stored: each join then has two shuffles of its own, so adaptive
    # execution can split a buyer or a community that holds most tenders.
    buyers = stored(assignment.filter(F.col("id").startswith("I")).select(
        F.col("id").alias("_buyer"), F.col("community").alias("community_id")
    ))
    placed = (
        tenders.join(buyers, buyer_node(F.col("buyer_id")) == F.col("_buyer"), "left")
        .drop("_buyer")
        .withColumn("community_id", F.coalesce("community_id", F.lit(-1)))
    )
    stats = stored(community_stats(placed, score_col, fit_until))
    return placed.join(stats.drop("n_tenders"), "community_id", "left")


def community_stats(placed: DataFrame, score_col: str = "rule_score", fit_until: int | None = None) -> DataFrame:
    known = placed.filter(F.col("community_id") >= 0)
    if fit_until is not None:
        known = known.filter(F.col("pub_year") < fit_until)
    return known.groupBy("community_id").agg(
        F.count("tender_id").alias("n_tenders"),
        F.avg(score_col).alias("community_mean_score"),
        F.avg("single_bidder").alias("community_single_bidder_rate"),
    )


def community_features(
    tenders: DataFrame, settings: GraphSettings = GraphSettings(), score_col: str = "rule_score"
) -> DataFrame:
    """Build the graph, find its communities and attach their features to each tender."""
    seen = tenders if settings.fit_until is None else tenders.filter(F.col("pub_year") < settings.fit_until)
    assignment = communities(graph_edges(pair_edges(seen, score_col)), settings)
    return attach_community_features(tenders, assignment, score_col, settings.fit_until)


def top_communities(nodes: DataFrame, keep: int = 7) -> DataFrame:
    """Communities with the most buyer nodes; the rest share the slot -1."""
    sizes = (
        nodes.filter((F.col("kind") == "buyer") & (F.col("community_id") >= 0))
        .groupBy("community_id")
        .agg(F.count("*").alias("n_buyers"))
    )
    best = sizes.orderBy(F.desc("n_buyers"), F.asc("community_id")).limit(keep).select("community_id", F.lit(1).alias("_kept"))
    return (
        sizes.join(F.broadcast(best), "community_id", "left")
        .select("n_buyers", F.when(F.col("_kept") == 1, F.col("community_id")).otherwise(-1).alias("slot"))
        .groupBy("slot")
        .agg(F.sum("n_buyers").alias("n_buyers"))
    )
