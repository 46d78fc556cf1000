"""Segments: newest wins, untouched buckets keep their files, failed writes and readers."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tenderlens.sources import segments

ROWS = "key string, item int, mark string"


def rows(spark, mark, keys, items=1):
    return spark.createDataFrame([(k, i, mark) for k in keys for i in range(items)], ROWS)


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def seen(spark, path, **kw):
    return sorted(tuple(r) for r in segments.read_segments(spark, path, "key", **kw).select("key", "item", "mark").collect())


def test_newest_rows_of_a_key_replace_all_others(spark, tmp_path):
    path = str(tmp_path / "t")
    assert segments.read_segments(spark, path, "key") is None and segments.append_segment(rows(spark, "x", []), path, "key") is None
    keys = [f"k{i}" for i in range(40)] + [None]
    segments.append_segment(rows(spark, "a", keys, items=3), path, "key", 8)
    before = files(path)
    segments.append_segment(rows(spark, "b", ["k1", "k2", None]), path, "key")
    segments.append_segment(rows(spark, "c", ["k2", "new"], items=2).drop("item").withColumn("extra", F.lit(1)), path, "key")
    assert all(files(path)[f] == t for f, t in before.items())  # a batch changes no file
    want = sorted([(k, i, "a") for k in keys if k not in ("k1", "k2", None) for i in range(3)] + [("k1", 0, "b")], key=repr)
    want += [(None, 0, "b"), ("k2", None, "c"), ("k2", None, "c"), ("new", None, "c"), ("new", None, "c")]

    def check():
        got = segments.read_segments(spark, path, "key").select("key", "item", "mark").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)

    check()
    touched = segments.compact(spark, path, "key", 1)
    assert 0 < len(touched) <= 5
    check()
    # Merged buckets are new files, and no other file changed; what they replaced goes with the next compaction.
    after = files(path)
    assert {f for f in after if f not in before and "batch=m" in str(f)} and all(after[f] == t for f, t in before.items() if f in after)
    assert segments.compact(spark, path, "key", 1) == []
    left = {str(f).split("bucket=")[1].split("/")[0] for f in files(path) if "batch=d1" in str(f)}
    assert left.isdisjoint(map(str, touched)) and left
    check()
    assert seen(spark, path, values=["k3"])[0][0] is not None
    lookup = segments.read_segments(spark, path, "key", values=["k1"])
    assert [tuple(r) for r in lookup.filter("key = 'k1'").select("key", "item", "mark").collect()] == [("k1", 0, "b")]
    assert lookup.count() < len(want)


def test_a_failed_write_is_not_read_nor_written_over(spark, tmp_path):
    path = str(tmp_path / "t")
    segments.append_segment(rows(spark, "a", ["x"]), path, "key", 4)
    segments.append_segment(rows(spark, "b", ["x"]), path, "key")
    (tmp_path / "t" / "of=4" / "batch=d2" / "_SUCCESS").unlink()
    assert seen(spark, path) == [("x", 0, "a")]
    assert segments.append_segment(rows(spark, "c", ["x"]), path, "key") == 3
    assert seen(spark, path) == [("x", 0, "c")]


@pytest.mark.parametrize("batches", [7])
def test_many_batches_stay_few_segments(spark, tmp_path, batches):
    path = str(tmp_path / "t")
    for i in range(batches):
        segments.append_segment(rows(spark, str(i), [f"k{j}" for j in range(i, 8)]), path, "key", 2)
        segments.compact(spark, path, "key", 3)
    assert seen(spark, path) == [(f"k{j}", 0, str(min(j, batches - 1))) for j in range(8)]
    _, found = segments.segments(spark, path)
    assert max(len(s) for s in segments._live(found).values()) <= 3
