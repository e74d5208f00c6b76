"""The driver contract, and a few queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["position", "player_id", "match_row", "xg_x_opp_conceded"]


@pytest.mark.parametrize(
    "name",
    ["q_matchup_top5", "q_rolling_mean", "q_calendar_minutes", "q_goals_conceded", "q_resolve_fallback", "q_points_breakdown", "q_season_eval", "q_upsert_table", "q_contains_join"],
)
def test_small_tables_agree(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None
