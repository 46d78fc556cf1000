"""Latest sightings from a stream: any order of arrival, late rows, expiry and repeated batches."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tenderlens.streaming import latest

SIGHTINGS = "code string, ts timestamp, no long, state int"
ORDER = ["ts", "no"]
START = datetime(2024, 1, 1)


def land(spark, folder, rows):
    spark.createDataFrame(rows, SIGHTINGS).coalesce(1).write.mode("append").parquet(folder)


def follow(spark, folder, path, **kw):
    stream = spark.readStream.schema(SIGHTINGS).option("maxFilesPerTrigger", 1).parquet(folder)
    query = latest.follow(stream, path, "code", ORDER, **kw)
    query.awaitTermination()
    return query


def state(spark, path):
    rows = latest.read_latest(spark, path, "code").select("code", *ORDER, "state").collect()
    return {r.code: (r.ts, r.no, r.state) for r in rows}


def test_order_of_arrival_does_not_matter(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    rng = random.Random(5)
    codes = ["hot"] * 60 + [f"c{i}" for i in range(12)] + [None, ""]
    rows = [(rng.choice(codes), START + timedelta(hours=rng.randrange(200)), i // 2, rng.choice([1, 2, None])) for i in range(300)]
    rows += rows[:20]
    for i in range(0, len(rows), 110):
        land(spark, folder, rows[i : i + 110])
    follow(spark, folder, path, late="400 days")
    want = {}
    for code, *row in rows:
        place = (row[0], row[1], -1 if row[2] is None else row[2])
        want[code] = max(want.get(code, place), place)
    assert state(spark, path) == {c: (*p[:2], None if p[2] < 0 else p[2]) for c, p in want.items()}
    # The changes of a key are later one by one, and the first is new.
    found = latest.read_changes(spark, path).orderBy("batch").collect()
    last = {}
    for r in found:
        assert (r.kind == latest.NEW) == (r.code not in last) and (r.code not in last or (r.ts, r.no, r.state or 0) > last[r.code])
        assert r.kind == latest.NEW or (r.kind == latest.SEEN) == (r.previous.state == r.state)
        last[r.code] = (r.ts, r.no, r.state or 0)


def test_late_rows_are_counted_and_spans_expire(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, folder, [("a", START, 1, 1), ("b", START, 2, 1)])
    land(spark, folder, [("a", START + timedelta(days=30), 3, 2), (None, None, 4, 1)])
    first = follow(spark, folder, path, late="2 days")
    assert first.lastProgress.stateOperators[0].numRowsTotal == 1  # the spans of the first day are forgotten
    # Five days late, and a day late: only the second counts, and a restart goes on where the stream ended.
    land(spark, folder, [("b", START + timedelta(days=25), 5, 9), ("b", START + timedelta(days=29), 6, 3)])
    second = follow(spark, folder, path, late="2 days")
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in second.recentProgress if p.stateOperators) == 1
    assert state(spark, path) == {"a": (START + timedelta(days=30), 3, 2), "b": (START + timedelta(days=29), 6, 3)}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    row = F.struct(*ORDER, "state").alias("_row")
    batches = [spark.createDataFrame(r, SIGHTINGS).select("code", row) for r in (
        [("a", START, 1, 1), ("a", START, 2, 2), ("b", START, 1, 1)], [("a", START + timedelta(1), 3, 2)], [])]
    for number, batch in enumerate(batches):
        for _ in range(2):
            latest.apply_batch(batch, number, path, "code", ORDER)
    assert state(spark, path) == {"a": (START + timedelta(1), 3, 2), "b": (START, 1, 1)}
    kinds = latest.read_changes(spark, path).select("batch", "code", "kind", "previous.state").collect()
    assert sorted(map(tuple, kinds), key=str) == [(0, "a", "new", None), (0, "b", "new", None), (1, "a", "seen", 2)]
