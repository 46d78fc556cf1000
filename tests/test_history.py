import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tenderlens.operators import history
from tenderlens.sources.periods import live_periods

SCHEMA = "tender_id string, buyer_id long, winner_id string, published_at timestamp, note string"


def awards(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def made(n, seed, first=0):
    r = random.Random(seed)
    start = datetime(2023, 1, 1)
    return [
        (f"t{first + i:04d}", r.choice([1, 1, 1, 2, 3, None]), r.choice(["a", "a", "b", "c", None]),
         r.choice([None, *[start + timedelta(days=r.randrange(150))] * 6]))
        for i in range(n)
    ]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_runs_in_any_order_equal_one_numbering(spark, tmp_path):
    path, rows = str(tmp_path / "h"), made(400, 1)
    random.Random(2).shuffle(rows)
    for part in (rows[:150], rows[150:160], rows[160:]):
        history.add_awards(awards(spark, part), path, hot_rows=20)
    assert rows_of(history.stored_concentration(spark, path)) == rows_of(history.prior_concentration(awards(spark, rows)))
    assert history.add_awards(awards(spark, rows[:0]), path) == []


def test_other_months_are_neither_read_nor_written(spark, tmp_path):
    path, rows = str(tmp_path / "h"), made(300, 3)
    history.add_awards(awards(spark, rows), path)
    before = files(f"{path}/awards")
    added = [("late", 1, "a", datetime(2023, 2, 3)), ("later", 2, "b", datetime(2023, 5, 3))]
    months = [2023 * 12 + 2, 2023 * 12 + 5]
    assert history.add_awards(awards(spark, added), path) == months
    after = files(f"{path}/awards")
    assert all(after[f] == t for f, t in before.items())
    assert {int(f.split("period=")[1].split("/")[0]) for f in set(after) - set(before)} == set(months)
    some = history.stored_concentration(spark, path, months)
    assert {f.split("period=")[1].split("/")[0] for f in some.inputFiles() if "/awards/" in f} == set(map(str, months))
    everything = history.prior_concentration(awards(spark, rows + added))
    there = {r[0] for r in rows + added if r[3] and r[3].month in (2, 5)}
    assert rows_of(some) == [r for r in rows_of(everything) if r[0] in there]


def test_replaced_moved_and_withdrawn_awards(spark, tmp_path):
    path = str(tmp_path / "h")
    day = lambda m, d: datetime(2024, m, d)
    first = [("t1", 1, "a", day(1, 1)), ("t2", 1, "a", day(1, 2)), ("t3", 1, "b", day(2, 1)), ("t4", 1, "a", day(3, 1))]
    history.add_awards(awards(spark, first), path)
    history.add_awards(awards(spark, [("t2", 1, "b", day(1, 2))]), path)
    assert rows_of(history.stored_concentration(spark, path)) == rows_of(
        history.prior_concentration(awards(spark, [first[0], ("t2", 1, "b", day(1, 2)), *first[2:]]))
    )
    old = awards(spark, [first[2], first[3]])  # t3 moves, t4 is no more: its month stays empty
    history.add_awards(awards(spark, [("t3", 1, "b", day(1, 1))]), path, replaced=old)
    now = [first[0], ("t2", 1, "b", day(1, 2)), ("t3", 1, "b", day(1, 1))]
    assert rows_of(history.stored_concentration(spark, path)) == rows_of(history.prior_concentration(awards(spark, now)))


def test_a_failed_run_counts_for_nothing(spark, tmp_path):
    path, rows = str(tmp_path / "h"), made(60, 5)
    assert history.stored_concentration(spark, path) is None
    history.add_awards(awards(spark, rows), path)
    state = live_periods(spark, path)
    lost = awards(spark, made(5, 6, 900)).withColumn("period", F.lit(24281))
    lost.write.partitionBy("period").parquet(f"{path}/awards/run=2")
    assert live_periods(spark, path) == state
    more = made(40, 7, 100)
    history.add_awards(awards(spark, more), path)
    assert set(live_periods(spark, path).values()) <= {1, 3}
    assert rows_of(history.stored_concentration(spark, path)) == rows_of(history.prior_concentration(awards(spark, rows + more)))
