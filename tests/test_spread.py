"""Tables that grow take more tasks, and their joins don't pass through the driver."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog import io_queries
from tenderlens import session
from tenderlens.operators import tenders
from tenderlens.sources import tables
from tenderlens.streaming import sync


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def made_tables(spark, path):
    """Forty orders of up to three lines, every seventh without one; a line without an order, one without a supplier."""
    day = datetime(1998, 1, 1)
    orders = [(k, k % 3, "O" if k % 2 else "F", 10.0 * k, day + timedelta(days=k), ("1-URGENT", "5-LOW", "4-NOT SPECIFIED")[k % 3]) for k in range(40)]
    lines = [(k, n, (k + n) % 4 or None, k % 5, float(n), 20.0 * n, "ARN"[(k + n) % 3], day + timedelta(days=k + n)) for k in range(40) if k % 7 for n in range(1, 4)]
    lines.append((None, 1, 1, 1, 1.0, 1.0, "A", day))
    for name, rows, schema in (
        ("nation", [(0, "N0", 0), (1, "N1", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        ("customer", [(c, f"C{c}", c % 2) for c in range(3)], "c_custkey long, c_name string, c_nationkey int"),
        ("supplier", [(s, f"S{s}", s % 2, 4000.0 * s) for s in range(1, 4)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        ("lineitem", lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def test_tasks_grow_with_the_rows(spark):
    df, few = spark.range(10), spark.range(10).rdd.getNumPartitions()
    assert session.spread(df, 4 * session.TASK_ROWS, "id").rdd.getNumPartitions() == few
    assert session.spread(df, 9 * session.TASK_ROWS + 1, "id").rdd.getNumPartitions() == 10


def test_offers_of_many_lines_take_more_tasks_and_stay_the_same(spark, tmp_path, monkeypatch):
    sf = made_tables(spark, str(tmp_path))
    want = sorted(map(str, b.offer_lines(spark, sf).collect()))
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    offers = b.offer_lines(spark, sf)
    assert sorted(map(str, offers.collect())) == want
    rows = [r for r in offers.collect() if r["tender_id"] == 1]
    assert {(r["closed_at"].day, r["awarded_at"].day) for r in rows} == {(3, 5)} and len(rows) == 3
    assert [r["line_no"] for r in offers.collect() if r["tender_id"] == 7] == [None]
    # 103 lines with an order; 4 shuffle partitions are the session's.
    assert tenders.bid_metrics(offers, null_counts_as_bidder=True).rdd.getNumPartitions() == 11


def test_overlay_takes_more_tasks_and_no_broadcast(spark, monkeypatch):
    bulk = spark.createDataFrame([(i // 2 if i else None, "old", i) for i in range(100)], "tender_id int, status string, n int")
    updates = spark.createDataFrame([(i, "new") for i in (1, 1, 90, None)], "tender_id int, status string")
    want = sorted(map(str, tables.overlay_offers(bulk, updates).collect()))
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    got = tables.overlay_offers(bulk, updates)
    assert sorted(map(str, got.collect())) == want
    assert "Broadcast" not in plan(got) and "hashpartitioning(tender_id" in plan(got) and "REPARTITION_BY_NUM" in plan(got)


def test_sync_joins_send_no_table_to_the_driver(spark):
    states = spark.createDataFrame([("a", 1), ("b", 2)], "code string, state int")
    seen = spark.createDataFrame([("a", 1), ("b", 3)], "code string, state int")
    tried = spark.createDataFrame([("b", 1)], "code string, last long")
    assert "Broadcast" not in plan(sync.pending_codes(seen, states, states, cap=5, attempts=tried))
    detail = spark.createDataFrame([("b", None, True)], "code string, detail struct<Comprador: struct<NombreOrganismo: string>>, failed boolean")
    answered = seen.select("code").join(session.by_shuffle(detail), "code")
    assert "Broadcast" not in plan(answered)
    assert "Broadcast" not in plan(tables.advance_state(states, seen))


def test_ranked_table_holds_what_a_page_shows(spark, tmp_path):
    sf = made_tables(spark, str(tmp_path))
    path, n = io_queries._ranked(spark, sf)
    stored = spark.read.parquet(path)
    assert n == 40 and set(stored.columns) == {*io_queries.PAGE, "position", "chunk"}
    page = io_queries.deep_page(spark, sf).collect()
    want = b.scored(spark, sf).orderBy(F.desc_nulls_last("risk_score"), "tender_id").offset(36).collect()
    assert [r["tender_id"] for r in page] == [r["tender_id"] for r in want]
