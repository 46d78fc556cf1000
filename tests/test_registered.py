"""Every registered query with SQL must return the SQL's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SF
from tools.compare import rows_of


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    df = queries()[name](spark, SF)
    result = con.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 25


def test_full_scoring(spark):
    got = queries()["score_tenders_full"](spark, SF)
    rows = got.collect()
    assert len(rows) == len({r["tender_id"] for r in rows}) == 1500
    assert max(r["risk_score"] for r in rows) == 100.0 and min(r["risk_score"] for r in rows) >= 0
    assert any(r["delta_sim_tfidf"] for r in rows) and {r["community_id"] for r in rows} >= {0, 1}
