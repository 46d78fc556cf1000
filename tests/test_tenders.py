from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tenderlens.config import FlagRules, RuleWeights
from tenderlens.operators import history, reports, rules, score, tenders

FIELDS = (
    "tender_id string, line int, supplier_id string, supplier_name string, supplier_size string, "
    "supplier_activity string, outcome string, offer_total double, item_name string, item_qty double, "
    "estimate double, estimate_visible string, justification string, published_at string, closed_at string, awarded_at string"
)


def line(tender, n, supplier, outcome, total, item="i", qty=1.0, estimate=100.0, visible="Si", why="ok",
         pub="2024-01-06 10:00:00", close="2024-01-09T10:00:00", award="2024-01-09 20:00:00"):
    return (tender, n, supplier, supplier, "s", "a", outcome, total, item, qty, estimate, visible, why, pub, close, award)


@pytest.fixture(scope="module")
def built(spark):
    rows = [
        line("A", 2, "s2", "won", 60.0), line("A", 1, "s1", "won", 40.0, qty=None),
        line("A", 3, "s3", "lost", 150.0), line("A", 4, "s4", "lost", 0.0), line("A", 5, "s4", "lost", 120.0),
        line("B", 1, None, None, None, item=None, qty=None, why=None, pub="bad", close="Sin fecha"),
        line("C", 1, "s1", "won", 0.0, estimate=0.0, why="Sin información"), line("C", 2, "s2", "lost", 5.0, estimate=0.0),
        line("D", 1, "s1", "won", 2_000_000.0, visible="No"),
    ]
    df = tenders.parse_timestamps(spark.createDataFrame(rows, FIELDS))
    flagged = tenders.tier1_flags(tenders.assemble_tenders(df, ["line"]))
    return {r["tender_id"]: r for r in flagged.collect()}


def test_winner_losers_and_metrics(built):
    a = built["A"]
    assert (a["winner_id"], a["awarded_amount"], a["runner_up_amount"], a["losing_mean_amount"]) == ("s1", 100.0, 120.0, 135.0)
    assert (a["n_bidders"], a["n_items"], a["total_qty"]) == (4, 1, 4.0)
    assert a["runner_up_margin"] == pytest.approx(0.2)
    assert (a["award_ratio"], a["ratio_near_one"]) == (1.0, 1)


def test_flags_and_dates(built):
    a = built["A"]
    assert a["published_at"] == datetime(2024, 1, 6, 10)
    assert (a["days_open"], a["short_window"], a["express_evaluation"], a["weekend_publication"]) == (3.0, 1, 1, 1)
    assert (a["pub_weekday"], a["pub_month"], a["pub_year"]) == (6, 1, 2024)
    assert (built["D"]["round_amount"], built["D"]["award_ratio"], built["D"]["single_bidder"]) == (1, None, 1)


def test_tender_without_offers(built):
    b = built["B"]
    assert (b["n_bidders"], b["n_items"], b["total_qty"], b["awarded_amount"], b["winner_id"]) == (0, 1, 0.0, None, None)
    assert (b["published_at"], b["days_open"], b["short_window"], b["single_bidder"]) == (None, None, None, 0)
    assert (b["empty_justification"], b["round_amount"], b["ratio_near_one"]) == (1, 0, 0)


def test_zero_amounts_guard_divisions(built):
    c = built["C"]
    assert (c["award_ratio"], c["runner_up_margin"], c["round_amount"], c["empty_justification"]) == (None, None, 0, 1)


def test_null_supplier_option(spark):
    df = spark.createDataFrame([line("A", 1, None, None, None)], FIELDS)
    assert tenders.bid_metrics(df, null_counts_as_bidder=True).first()["n_bidders"] == 1
    assert tenders.bid_metrics(df).first()["n_bidders"] == 0


def test_timestamp_failures_skip_sentinels(spark):
    df = spark.createDataFrame([("bad",), ("Sin fecha",), ("2024-01-01T00:00:00",), (None,)], "published_at string")
    assert tenders.timestamp_failures(df, ["published_at"]).first()[0] == 1


def test_history_brute_force(spark):
    rows = [(f"t{i:03d}", f"b{i % 3}" if i % 11 else None, f"s{i % 4}" if i % 7 else None, i // 5) for i in range(150)]
    df = spark.createDataFrame(rows, "tender_id string, buyer_id string, winner_id string, published_at int")
    won = [r for r in rows if r[2] is not None]

    def earlier(r, same):
        return sum(1 for o in won if same(o) and (o[3], o[0]) < (r[3], r[0]))

    want = {}
    for r in won:
        pair = earlier(r, lambda o: o[1] == r[1] and o[2] == r[2])
        s, b = earlier(r, lambda o: o[2] == r[2]), earlier(r, lambda o: o[1] == r[1])
        want[r[0]] = (pair, s, b, pair / s if s else 0.0, pair / b if b else 0.0)
    for limit in (1_000_000, 8):
        got = history.prior_concentration(df, hot_rows=limit).collect()
        assert {r[0]: tuple(r)[1:] for r in got} == want


def _ruled(spark, **columns):
    base = {f: 0 for f in RuleWeights().flags} | {"supplier_share": 0.0, "prior_pair": 0} | columns
    return spark.range(1).select(*[F.lit(v).alias(c) for c, v in base.items()])


def test_rule_terms(spark):
    row = rules.rule_score(_ruled(spark, single_bidder=1, supplier_share=0.81, prior_pair=10, delta_sim_tfidf=0.21)).first()
    assert row["rule_score"] == 3.0 + 2.0 + 1.5 + 2.0
    assert (row["flag_captive_supplier"], row["is_captive_supplier"], "flag_hot_community" in row) == (2.0, True, False)
    edge = rules.rule_score(_ruled(spark, supplier_share=0.8, prior_pair=9, delta_sim_tfidf=0.2)).first()
    assert edge["rule_score"] == 0.0
    empty = rules.rule_score(_ruled(spark, single_bidder=None, supplier_share=None, prior_pair=None)).first()
    assert empty["rule_score"] == 0.0


def test_hot_community_threshold(spark):
    one = _ruled(spark, community_mean_score=4.0)
    assert rules.rule_score(one).first()["flag_hot_community"] == 0.0  # one row: no deviation, mean itself is not above
    many = spark.range(10).crossJoin(_ruled(spark)).withColumn(
        "community_mean_score", F.when(F.col("id") == 0, 10.0).when(F.col("id") < 9, 1.0)
    )
    assert rules.rule_score(many).agg(F.sum("flag_hot_community")).first()[0] == 1.5


def test_combined_score(spark):
    rows = [("a", 0.0, 0.2), ("b", 4.0, 0.6), ("c", 2.0, None)]
    df = spark.createDataFrame(rows, "tender_id string, rule_score double, anomaly double")
    got = {r["tender_id"]: r for r in score.combine_scores(df).collect()}
    assert [got[k]["risk_score"] for k in "abc"] == [0.0, 100.0, 30.0]
    flat = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, None)], "tender_id string, rule_score double, anomaly double")
    assert [r["risk_score"] for r in score.combine_scores(flat).collect()] == [0.0, 0.0]
    parts = score.score_contributions(score.combine_scores(df)).collect()
    assert all(p["rule_points"] + p["anomaly_points"] == pytest.approx(p["risk_score"]) for p in parts)


def test_page_limits_and_filters(spark):
    df = spark.createDataFrame(
        [(i, float(i % 5), "Publicada" if i % 2 else "Cerrada", f"Mun {i % 3}", 2020 + i % 2) for i in range(20)],
        "tender_id int, risk_score double, status string, institution string, pub_year int",
    )
    page = reports.ranked_page(df, 3, 1).collect()
    assert [r["tender_id"] for r in page] == [9, 14, 19]
    assert reports.optional_filters(df).count() == 10
    assert reports.optional_filters(df, institution="mUN 1", active_only=False).count() == 7
    assert reports.optional_filters(df, year=0, institution="", active_only=False).count() == 20
    assert reports.optional_filters(df, min_score=0.0, active_only=False).count() == 20
    with pytest.raises(ValueError):
        reports.ranked_page(df, 501)
    with pytest.raises(ValueError):
        reports.network_edges(df, limit=5)
    assert reports.page_count(df.limit(0)).first()["n_pages"] == 1
    assert reports.page_kpis(df.limit(0).selectExpr("*", "1 single_bidder", "0.0 flag_captive_supplier")).first()["pct_high"] == 0


def test_labels(spark):
    df = spark.createDataFrame(
        [("a", "I. Municipalidad de Lota", "Proveedor de nombre muy largo", 1_250_000.0, "Municipalidad de X"), ("b", None, None, None, None)],
        "tender_id string, institution string, winner_name string, awarded_amount double, x string",
    )
    a, b = reports.display_labels(df).orderBy("tender_id").collect()
    assert (a["institution_short"], a["supplier_short"], a["amount_label"]) == ("I. Mun. Lota", "Proveedor de nombre mu…", "$1.3M")
    assert (b["institution_short"], b["supplier_short"], b["amount_label"]) == ("", "", "—")
    assert [r["band"] for r in spark.createDataFrame([(80.0,), (60.0,), (59.9,)], "risk_score double")
            .select(reports.risk_band().alias("band")).collect()] == ["high", "medium", "low"]
