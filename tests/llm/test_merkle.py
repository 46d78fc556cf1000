"""op12 against a plain Python tree, with nulls, ties, lone leaves, one source, one row and none."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tenderlens.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    fields = [*row[:4], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def brute(rows):
    """Rows of op12 for documents (doc_id, source, lang, n_chars, text)."""
    first = lambda v: (v is not None, v if v is not None else 0)
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((first(r[0]), leaf_of(r, r[4]), r))

    def climb(digests):
        """(root, for each leaf its runs: (digests before, digests after) level by level)."""
        at, ways = list(range(len(digests))), [[] for _ in digests]
        while len(digests) > 1:
            for i, way in enumerate(ways):
                run = at[i] // 3 * 3
                way.append(("".join(digests[run : at[i]]), "".join(digests[at[i] + 1 : run + 3])))
                at[i] //= 3
            digests = [h(*digests[i : i + 3]) for i in range(0, len(digests), 3)]
        return digests[0], ways

    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by_source[s], key=lambda x: x[:2])) for s in order}
    climbed = {s: climb([x[1] for x in trees[s]]) for s in order}
    root, tops = climb([climbed[s][0] for s in order]) if order else (None, [])
    out = []
    for s, top in zip(order, tops):
        for (_, leaf, r), way in zip(trees[s], climbed[s][1]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = leaf_of(r, r[4].replace("\n", "") if tampered and r[4] is not None else r[4])
            for before, after in way + top:
                folded = h(before, folded, after)
            out.append((r[0], leaf, climbed[s][0], root, h(*(b + a for b, a in way + top)), folded, folded == root))
    return out


def documents(n, sources, seed=0):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "a\nb", "ñ\n", "plain", "x" * 50_000 + "\n"])
    return [(rng.choice([None, rng.randrange(n)]) if i % 9 == 0 else i, rng.choice(sources), rng.choice([None, "en"]), rng.choice([None, 5]), text()) for i in range(n)]


@pytest.mark.parametrize("n, sources", [
    (100, ["web", "web", "web", "books", None, "élan", "Z"]), (40, [None]), (31, [str(i) for i in range(200)]), (1, ["a"]), (2, ["a"]), (4, ["a"]), (0, ["a"]),
])
def test_matches_plain_python(spark, tmp_path, n, sources):
    rows = documents(n, sources, n)
    rows += rows[:3]  # repeated rows
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in merkle.op12_merkle(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_a_shuffle_instead_of_a_broadcast_gives_the_same(spark, tmp_path, monkeypatch):
    rows = documents(60, ["a", "b"])
    spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(merkle, "LISTED", 0)
    got = [tuple(r) for r in merkle.op12_merkle(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_a_changed_leaf_or_step_does_not_verify(spark):
    rows = spark.createDataFrame([(i, h(str(i))) for i in range(30)], "id long, digest string")
    proofs = merkle.manifest(rows, F.lit(None).cast("string"), F.col("id"), F.col("digest"))
    wrong = F.transform("path", lambda s: F.struct(F.reverse(s["before"]).alias("before"), s["after"].alias("after")))
    hexed = F.lower(F.hex("leaf"))
    seen = proofs.select(
        (merkle.fold(hexed, F.col("path")) == F.lower(F.hex("root"))).alias("right"),
        (merkle.fold(F.sha2("leaf", 256), F.col("path")) == F.lower(F.hex("root"))).alias("leaf"),
        (F.col("group").isNull() & (merkle.fold(hexed, wrong) == F.lower(F.hex("root")))).alias("path"),
    ).collect()
    assert len(seen) == 30 and all(r["right"] and not r["leaf"] for r in seen) and sum(r["path"] for r in seen) < 30
