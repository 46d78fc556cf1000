import random

import pytest
from pyspark.sql import functions as F

from tenderlens.config import GraphSettings
from tenderlens.operators import graph
from tenderlens.session import stored


def planted(spark):
    """Two dense blocks joined by one thin edge, and a separate pair."""
    rows = [(f"I:{b}{i}", f"P:{b}{j}", 3.0) for b in "ab" for i in range(4) for j in range(3 if b == "a" else 2)]
    rows += [("I:a0", "P:b0", 1.0), ("I:z", "P:z", 2.0)]
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def test_planted_blocks_are_found_and_numbered_by_size(spark):
    got = {r["id"]: r["community"] for r in graph.communities(planted(spark)).collect()}
    blocks = [{i for i, c in got.items() if c == k} for k in range(3)]
    assert [len(b) for b in blocks] == [7, 6, 2]
    assert all(i[2] == "a" for i in blocks[0]) and all(i[2] == "b" for i in blocks[1]) and blocks[2] == {"I:z", "P:z"}


def _sequential(edges, seed):
    """Plain sequential local moving with contraction, for comparison on small graphs."""
    rng = random.Random(seed)
    nodes = sorted({v for e in edges for v in e[:2]})
    home = {v: v for v in nodes}
    links, loops = {}, {v: 0.0 for v in nodes}
    for a, b, w in edges:
        links.setdefault(a, {})[b] = links.setdefault(b, {}).get(a, 0.0) + w
        links[a][b] = links[b][a] = w
    total = 2 * sum(w for _, _, w in edges)
    while True:
        degree = {v: sum(links.get(v, {}).values()) + loops[v] for v in loops}
        comm, tot = {v: v for v in loops}, dict(degree)
        moved_any, moving = False, True
        while moving:
            moving = False
            order = sorted(loops)
            rng.shuffle(order)
            for v in order:
                near = {}
                for u, w in links.get(v, {}).items():
                    near[comm[u]] = near.get(comm[u], 0.0) + w
                tot[comm[v]] -= degree[v]
                def gain(c):
                    return near.get(c, 0.0) - degree[v] * tot[c] / total
                best = max([comm[v], *near], key=lambda c: (gain(c), c == comm[v]))
                if gain(best) > gain(comm[v]) + 1e-9:
                    comm[v], moving, moved_any = best, True, True
                tot[comm[v]] += degree[v]
        home = {n: comm[h] for n, h in home.items()}
        if not moved_any:
            return home
        fresh, loop = {}, {c: 0.0 for c in set(comm.values())}
        for v, near in links.items():
            for u, w in near.items():
                a, b = comm[v], comm[u]
                if a == b:
                    loop[a] += w
                else:
                    fresh.setdefault(a, {})[b] = fresh.setdefault(a, {}).get(b, 0.0) + w
        for v, w in loops.items():
            loop[comm[v]] += w
        links, loops = fresh, loop


def test_modularity_close_to_sequential(spark):
    rng = random.Random(5)
    edges = {}
    for _ in range(420):
        block = rng.randrange(5)
        other = block if rng.random() < 0.75 else rng.randrange(5)
        key = (f"I:{block}_{rng.randrange(8)}", f"P:{other}_{rng.randrange(6)}")
        edges[key] = edges.get(key, 0.0) + 1.0
    rows = [(a, b, w) for (a, b), w in edges.items()]
    df = spark.createDataFrame(rows, "src string, dst string, weight double")
    ours = graph.modularity(df, graph.communities(df)).first()[0]
    best = max(
        graph.modularity(df, spark.createDataFrame(
            [(n, str(c)) for n, c in _sequential(rows, s).items()], "id string, community string")).first()[0]
        for s in range(3)
    )
    assert ours >= best - 0.02


def test_result_does_not_depend_on_partitions(spark):
    edges = planted(spark)
    a = graph.communities(edges.repartition(1)).orderBy("id").collect()
    b = graph.communities(edges.repartition(7)).orderBy("id").collect()
    assert a == b


def test_empty_graph(spark):
    empty = spark.createDataFrame([], "src string, dst string, weight double")
    assert graph.communities(empty, GraphSettings()).count() == 0


def test_features_outside_the_graph(spark):
    tenders = spark.createDataFrame(
        [(1, "b1", "s1", "Inst", "Sup", 10.0, 4.0, 1, 2020), (2, "b1", None, "Inst", None, None, 2.0, 0, 2021),
         (3, "b9", None, "Other", None, None, 9.0, 1, 2021)],
        "tender_id int, buyer_id string, winner_id string, institution string, winner_name string, awarded_amount double, "
        "rule_score double, single_bidder int, pub_year int",
    )
    got = {r["tender_id"]: r for r in graph.community_features(tenders).collect()}
    assert (got[1]["community_id"], got[1]["community_mean_score"], got[1]["community_single_bidder_rate"]) == (0, 3.0, 0.5)
    assert got[2]["community_id"] == 0
    assert (got[3]["community_id"], got[3]["community_mean_score"]) == (-1, None)
    past = {r["tender_id"]: r for r in graph.community_features(tenders, GraphSettings(fit_until=2021)).collect()}
    assert past[2]["community_mean_score"] == 4.0


def test_vertices_take_their_first_label(spark):
    pairs = spark.createDataFrame(
        [("b", "s2", 1, 1.0, 1.0, "late", "S2"), ("b", "s1", 1, 1.0, 1.0, "early", "S1")],
        "buyer_id string, winner_id string, n_awards long, amount double, mean_score double, buyer_label string, supplier_label string",
    )
    got = {r["id"]: (r["kind"], r["label"]) for r in graph.graph_vertices(pairs).collect()}
    assert got == {"I:b": ("buyer", "early"), "P:s1": ("supplier", "S1"), "P:s2": ("supplier", "S2")}
    summary = graph.graph_summary(graph.graph_edges(pairs)).first()
    assert (summary["n_nodes"], summary["n_edges"], summary["density"]) == (3, 2, pytest.approx(2 / 3))


def _parts_of(edges, assignment):
    """Connected parts of each community by plain search."""
    near = {}
    for a, b in edges:
        if assignment[a] == assignment[b]:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    part = {}
    for v in sorted(assignment):
        todo = [] if v in part else [v]
        while todo:
            u = todo.pop()
            if u not in part:
                part[u] = v
                todo += near.get(u, ())
    return part


def test_connected_parts_equal_plain_search(spark):
    rng = random.Random(11)
    chain = [(i, i + 1) for i in range(0, 60)]
    edges = chain + [(rng.randrange(70, 140), rng.randrange(70, 140)) for _ in range(60)]
    edges = sorted({(a, b) for a, b in edges if a != b})
    assignment = {v: (0 if v <= 40 or 50 <= v <= 60 else 1 + v % 3) for v in range(140)}
    links = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src long, dst long")
    member = spark.createDataFrame(list(assignment.items()), "v long, comm long")
    got = {r["v"]: r["comm"] for r in graph.connected_parts(links, member).collect()}
    assert got == _parts_of(edges, assignment)
    assert graph.connected_parts(links.limit(0), member.limit(0)).count() == 0


def test_every_community_is_connected(spark):
    rng = random.Random(21)
    edges = sorted({(f"I:{rng.randrange(40)}", f"P:{rng.randrange(60)}") for _ in range(110)})
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src string, dst string, weight double")
    got = {r["id"]: r["community"] for r in graph.communities(df).collect()}
    assert len(set(_parts_of(edges, got).values())) == len(set(got.values()))


def test_sweeps_of_small_graphs_are_planned_small(spark):
    from tenderlens.session import SMALL_ROWS, planned_small

    keys = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(k) for k in keys]
    with planned_small(spark, 1000):
        assert [spark.conf.get(k) for k in keys] == ["false", "1"]
    with planned_small(spark, SMALL_ROWS + 1):
        assert [spark.conf.get(k) for k in keys] == before
    assert [spark.conf.get(k) for k in keys] == before


def test_a_sweep_of_a_small_graph_is_one_job_beside_its_broadcasts(spark):
    from tenderlens.session import planned_small

    rows = [(f"I:{i % 7}", f"P:{i % 5}", 1.0) for i in range(35)]
    level, _ = graph._first_level(spark.createDataFrame(rows, "src string, dst string, weight double"))
    start = stored(level.vertices.withColumn("comm", F.col("v")))
    sc = spark.sparkContext
    with planned_small(spark, 70):
        sc.setJobGroup("sweep-of-test", "")
        graph._evaluate(level, start, 1.0)
    jobs = sc.statusTracker().getJobIdsForGroup("sweep-of-test")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 4  # three small sides are broadcast; a job for each shuffle, the sums and the schema came on top


def _random_edges(spark, n=300):
    rng = random.Random(3)
    rows = sorted({(f"I:{rng.randrange(n // 3)}", f"P:{rng.randrange(n // 2)}") for _ in range(n)})
    return spark.createDataFrame([(a, b, 1.0 + i % 4) for i, (a, b) in enumerate(rows)], "src string, dst string, weight double")


def test_held_sweeps_give_the_communities_of_joined_ones(spark, monkeypatch):
    monkeypatch.setattr(graph, "PACKED_LINKS", 50)  # several rows of links, so vertices are cut apart
    edges = stored(_random_edges(spark))
    held, joined = (sorted(map(tuple, graph.communities(edges, held=n).collect())) for n in (10**6, 0))
    assert held == joined


def test_a_held_sweep_shuffles_nothing(spark):
    level, _ = graph._first_level(_random_edges(spark))
    sweeps, position = graph._settle(level, GraphSettings())
    assert isinstance(sweeps, graph._Held)
    sc = spark.sparkContext
    sc.setJobGroup("held-sweep-of-test", "")
    again = sweeps.moved(position, 0)
    jobs = sc.statusTracker().getJobIdsForGroup("held-sweep-of-test")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert [len(sc.statusTracker().getJobInfo(j).stageIds) for j in jobs] == [1]
    assert again.comm.dtype.itemsize == 4 and len(again.comm) == level.vertices.count()
