"""Neighbours, near-duplicate vectors and documents, shards, components, pipeline: brute force beside each."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from tenderlens.llm import itq, registry, rotated_codes, sharding, weighted_minhash
from tenderlens.llm import common, weighted_minhash
from tenderlens.llm.common import components

VECTORS = "vec_id long, embedding array<float>, label string"


def union_find(n_or_ids, pairs):
    parent = {i: i for i in n_or_ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = np.random.default_rng(3)
    pairs = {
        "path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 40)] + [(100, 101)],
        "random": [tuple(map(int, p)) for p in rng.integers(0, 120, (80, 2))], "none": [],
    }[shape]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union_find({x for p in pairs for x in p}, pairs)
    assert {i: got.get(i, i) for i in want} == want


@pytest.fixture
def many_partitions(spark):
    own = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_small_tables_of_near_duplicates_are_few_files(many_partitions, monkeypatch):
    """Each file costs processes of its own, which for a moment count as much memory as the executor."""
    spark, cores = many_partitions, many_partitions.sparkContext.defaultParallelism
    pairs = [(i, i + 1) for i in range(0, 1200, 2)]
    found = components(spark.createDataFrame(pairs, "a long, b long"))
    assert len(found.inputFiles()) <= cores and {(r["root"], r["id"]) for r in found.collect()} == set(pairs)

    words = [f"w{i}" for i in range(40)]
    rows = [(k, " ".join([f"t{k // 3}", *words[k // 3 % 20 :], *(f"u{k // 3}x{i}" for i in range(40)), f"e{k % 3}"])) for k in range(300)]
    files = []
    stored = weighted_minhash.stored
    monkeypatch.setattr(weighted_minhash, "stored", lambda df: files.append(len((out := stored(df)).inputFiles())) or out)
    classes = weighted_minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in classes.collect()} == {k: k - k % 3 for k in range(300)}
    # Of the tables that it stores, only those whose joins adaptive execution may split are a file for each partition.
    assert sum(n > cores for n in files) <= 4, files


def test_memory_goes_back_when_another_operator_takes_a_worker(monkeypatch):
    given = []
    monkeypatch.setattr(common, "_claimed", "one")
    monkeypatch.setattr(common, "release_memory", lambda: given.append(1))
    for name in ("one", "two", "two", "one"):
        common.claim_caches(name)
    assert len(given) == 2
    monkeypatch.undo()
    common.release_memory()


# --- vectors -----------------------------------------------------------------------------


def clustered(seed=0, n=400, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[50:90] = x[50] + 0.1 * rng.standard_normal((40, dim))
    x[90:120] = x[90] + 0.2 * rng.standard_normal((30, dim))
    x[120:140] = x[120]
    return x.astype(np.float32)


def vector_rows(spark, x):
    bad = [None, [0.0] * x.shape[1], [float("nan")] * x.shape[1], [float("inf")] + [1.0] * (x.shape[1] - 1), [None] + [1.0] * (x.shape[1] - 1), []]
    rows = [(i, [float(v) for v in r], "l") for i, r in enumerate(x)]
    return spark.createDataFrame(rows + [(1000 + 20 * i, b, None) for i, b in enumerate(bad)], VECTORS)


def test_nearest_against_brute_force(spark):
    x = clustered()
    x[:40] *= 5
    index = rotated_codes.build_index(vector_rows(spark, x).withColumns({"code": F.lit(1), "dim": F.lit("d")}))
    got = defaultdict(list)
    for r in rotated_codes.nearest(index, index.filter("vec_id % 20 = 0"), query_block=8, code_block=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    y = x.astype(np.float64)
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        scores = y @ y[q]
        order = [i for i in np.lexsort((np.arange(len(y)), -scores)) if i != q][:20]
        assert len(found) == 20 and len({v for v, _ in found}) == 20 and q not in {v for v, _ in found}
        assert np.allclose([s for _, s in found], [scores[v] for v, _ in found], rtol=0, atol=1e-9)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        hits += len(set(order) & {v for v, _ in found})
    assert hits >= 0.97 * 20 * len(got)


def test_op2_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    y = np.array([r["embedding"] for r in rows], np.float64)
    want = set()
    for q in range(0, len(y), 20):
        scores = y @ y[q]
        scores[q] = -np.inf
        want |= {(q, int(v)) for v in np.lexsort((np.arange(len(y)), -scores))[:20]}
    got = {(r["query_id"], r["vec_id"]) for r in registry.QUERIES["op2_rotated_codes"](spark, SF).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.98 * len(want)


def test_few_vectors_and_empty_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], "a"), (20, [1.0, 0.0], "a"), (3, [0.5, 0.5], "b")], VECTORS)
    index = rotated_codes.build_index(few)
    got = rotated_codes.nearest(index, index.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    empty = rotated_codes.build_index(few.filter("false"))
    assert rotated_codes.nearest(empty, empty).count() == 0
    assert itq.near_duplicates(few.filter("false")).count() == 0
    none = itq.near_duplicates(few.withColumn("embedding", F.lit(None).cast("array<float>"))).collect()
    assert {(r["n_links"], r["component_id"] == r["vec_id"], r["kept"]) for r in none} == {(0, True, True)}


def test_code_estimates_stay_in_their_bounds():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    code, length, fit = rotated_codes.encode(x)
    bits = code.shape[1] * 8
    turned = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ rotated_codes.rotation(64)
    estimate = turned @ (np.unpackbits(code, axis=1) * 2.0 - 1).T / (np.sqrt(bits) * fit)
    true = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / length[:, None]).T
    slack = rotated_codes.BOUND * np.sqrt(1 - fit**2) / (fit * np.sqrt(bits - 1))
    assert (np.abs(estimate - true) <= slack).mean() > 0.97 and abs((estimate - true).mean()) < 0.01


def test_near_duplicate_vectors_against_brute_force(spark):
    x = clustered()
    rows = vector_rows(spark, x).withColumns({"id": F.lit("i"), "key": F.lit(None).cast("int")})
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    want = union_find(range(len(y)), zip(*map(lambda a: a.tolist(), np.nonzero(near))))
    got = {r["vec_id"]: r for r in itq.near_duplicates(rows).collect()}
    assert len(got) == len(x) + 6
    found, true = sum(got[i]["n_links"] for i in range(len(x))), int(near.sum())
    assert 0.97 * true <= found <= true
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(len(x)))
    assert sum(got[i]["component_id"] == want[i] for i in want) >= 0.98 * len(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(1000, 1120, 20))


def test_blocks_count_each_pair_once(spark):
    x = clustered()[:140]
    rows = vector_rows(spark, x)
    distinct = spark.createDataFrame([(i, bytearray(r.astype("<f8").tobytes()), 1) for i, r in enumerate(x[:120])], "id long, vector binary, weight long")
    tables = itq.learn(x.astype(np.float64), 8, 12)
    sums = []
    for block in (7, 1000):
        tied = itq.linked_pairs(distinct, x.shape[1], tables, block=block).collect()
        total = Counter()
        for r in tied:
            total[r["id"]] += r["n"]
        sums.append(total)
    assert sums[0] == sums[1] and sum(sums[0].values()) > 500
    assert rows.count() == 146


def test_table_shape_meets_its_promise():
    for n in (10, 50_000, 10**9):
        width, count = itq.table_shape(n)
        same = (1 - np.arccos(0.95) / np.pi) ** width
        assert (1 - same) ** count <= itq.MISSED and 2**width >= n


def off_centre(norm, n=1500, dim=64, cosine=0.951, seed=8):
    """n pairs at the cosine; the mean of all unit vectors has about the norm."""
    rng = np.random.default_rng(seed)

    def spread():
        z = rng.standard_normal((n, dim))
        return z / np.linalg.norm(z, axis=1, keepdims=True)

    u = np.sqrt(1 - norm**2) * spread()
    u[:, 0] += norm
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = spread()
    w -= (w * u).sum(axis=1, keepdims=True) * u
    return np.concatenate([u, cosine * u + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w, axis=1, keepdims=True)])


@pytest.mark.parametrize("norm", [0.0, 0.7, 0.85])
def test_tables_meet_their_promise_around_any_mean(spark, norm):
    y = off_centre(norm)
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    rows = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(y)], "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: r for r in itq.near_duplicates(rows).collect()}
    found, true = sum(r["n_links"] for r in got.values()), int(near.sum())
    assert true >= len(y) and 0.97 * true <= found <= true
    if norm < 0.8:
        want = union_find(range(len(y)), zip(*map(lambda a: a.tolist(), np.nonzero(near))))
        assert sum(got[i]["component_id"] == want[i] for i in want) >= 0.97 * len(want)


def test_fitted_tables_shorten_keys_rather_than_miss_pairs():
    y = off_centre(0.95, 1000)
    tables = itq.fitted(y, 100_000)
    assert tables.count <= itq.TABLES and tables.width < itq.table_shape(100_000)[0]
    for a, b in itq.made_pairs(y, 0.95, seed=77):
        assert (tables.keys(a) != tables.keys(b)).all(axis=1).mean() <= 0.03
    same = itq.fitted(np.ones((1, 3)), 1)
    assert (same.keys(np.ones((1, 3))) == same.keys(np.full((1, 3), 2.0))).any()


# --- documents ---------------------------------------------------------------------------


def plain_similarity(a, b):
    sets = []
    for text in (a, b):
        w = re.findall(r"\w+", (text or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    union = sets[0] | sets[1]
    return len(sets[0] & sets[1]) / len(union) if union else 0.0


def test_samples_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    w = rng.integers(1, 5, 300).astype(np.float32)
    v = w.copy()
    v[:60], w[240:] = 0, 0
    x, y = (weighted_minhash.signature(h[m > 0], m[m > 0], 4096) for m in (w, v))
    true = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    assert abs((x == y).mean() - true) < 0.03
    z = weighted_minhash.signature(h[w > 0], 2 * w[w > 0], 4096)
    assert abs((x == z).mean() - 0.5) < 0.03
    assert (weighted_minhash.signature(h[w > 0], w[w > 0], 64, chunk=50) == weighted_minhash.signature(h[w > 0], w[w > 0], 64)).all()


def test_near_duplicates_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r["class_id"] for r in registry.QUERIES["op8_weighted_minhash"](spark, SF).collect()}
    assert len(got) == len(docs)
    texts = {d["doc_id"]: d["text"] for d in docs}
    links = [(a, b, plain_similarity(texts[a], texts[b])) for a in texts for b in texts if a < b]
    for a, b, s in links:
        if s >= 0.82:
            assert got[a] == got[b], (a, b, s)
    loose = union_find(texts, [(a, b) for a, b, s in links if s >= 0.78])
    assert all(loose[i] == loose[c] and c <= i for i, c in got.items())


def test_classes_of_large_groups_and_odd_texts(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    base = [str(w) for w in rng.choice(words, 200)]
    texts = [" ".join(base)] * 30
    for i in range(60):  # near copies of the base, close to it and a little less to each other
        copy = list(base)
        copy[int(rng.integers(200))] = f"new{i}"
        texts.append(" ".join(copy))
    shared = " ".join(str(w) for w in rng.choice(words, 60))  # a passage that unlike texts share
    texts += [shared + " " + " ".join(str(w) for w in rng.choice(words, 90)) for _ in range(60)]
    texts += [None, None, "", "...", "one two", "One, two!", "three"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:3] + [(None, "one two", "en", "s", 0), (5, "unlike the others with this id", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"id": F.lit("x"), "root": F.lit(1), "t1": F.lit("y")})
    classes = weighted_minhash.near_duplicate_classes(docs).collect()
    assert len(classes) == docs.count()
    of = defaultdict(set)
    for r in classes:
        of[r["doc_id"]].add(r["class_id"])
    assert all(of[i] == {0} for i in range(90) if i != 5) and of[5] == {0, 5}
    assert all(of[i] == {i} for i in range(90, 154))
    assert of[154] == of[155] == {154} and of[156] == {156} and of[None] == {154}
    kept = weighted_minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [0, 5, *range(90, 155), 156]
    assert weighted_minhash.drop_near_duplicates(docs.filter("false")).count() == 0


# --- shards ------------------------------------------------------------------------------


def test_hypergeometric_moments_and_edges():
    rng = np.random.default_rng(6)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.15 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.35
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3
    big = sharding.hypergeometric(rng, 10**12, 23 * 10**12, 10**6)
    assert abs(big - 10**6 / 24) < 12 * 200


def test_matrix_margins():
    rows, sizes = [100, 0, 7, 1, 392], [167, 167, 166]
    matrix = sharding.communication_matrix(rows, sizes, 1)
    assert matrix.sum(axis=1).tolist() == rows and matrix.sum(axis=0).tolist() == sizes and (matrix >= 0).all()
    assert (sharding.communication_matrix(rows, sizes, 2) != matrix).any()


@pytest.mark.parametrize("run_rows", [5, 1 << 18])
def test_shards(spark, run_rows):
    docs = spark.createDataFrame([(i % 7 if i < 500 else None, "same") for i in range(1001)], "doc_id long, text string").withColumns(
        {"slot": F.lit("clash"), "_n": F.lit(1)}
    ).repartition(5)
    got = sharding.shuffle_into_shards(docs, 24, run_rows=run_rows).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(24)) and {len(s) for s in slots.values()} == {41, 42}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    assert sharding.shuffle_into_shards(docs.filter("false")).count() == 0


def test_op4(spark):
    import zlib

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.QUERIES["op4_sharding"](spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in texts.items()}
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and {r["law"] for r in got} == {"rows"}


# --- pipeline ----------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline
    from tenderlens.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", None), (9002, "12 34 !", "en", "s", 7), (9003, "", None, "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
            assert docs.select("doc_id").distinct().count() == docs.count()
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").distinct().collect()}
    assert ids(seen["language"]) == set(range(200))
    lines = {r["doc_id"]: r["text"] for r in seen["line_dedup"].collect()}
    counts = Counter(key for t in lines.values() for key in {x.strip().lower() for x in t.split("\n")} if key)
    assert max(counts.values()) < 10
    kept = [lines[i] for i in ids(seen["near_duplicates"])]
    assert len(kept) < len(lines)
    assert not any(plain_similarity(a, b) >= 0.82 for i, a in enumerate(kept) for b in kept[:i])
    assert ids(seen["secrets"]) == ids(seen["near_duplicates"]) == ids(seen["packing"])
    assert seen["secrets"].filter(F.col("text").rlike('token = "[0-9a-f]{40}"')).count() == 0
