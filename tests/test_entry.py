"""The driver contract, and the check SQL of the core queries on the smallest tables.

Set MATCHLIGHT_ALL_QUERIES=1 to run every query that has check SQL.
"""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

SMALL = "/root/testdata/sf0.001"
CORE = (
    "participants player_game_stats_bulk top3_per_game win_ratio player_level engagement_live "
    "rating_live player_score popular_games country_activity skill_tiers game_complexity "
    "platform_summary most_played_games stats_upsert cdc_delete_keys time_quartiles_by_game roc_curve"
).split()

needs_tables = pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not here")


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140
    assert set(CORE) <= set(entry.oracle_sql())


@needs_tables
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["player_name", "game_name"]
    assert df.count() > 0


@needs_tables
@pytest.mark.parametrize("key", entry.oracle_sql() if os.environ.get("MATCHLIGHT_ALL_QUERIES") else CORE)
def test_query_equals_its_check(spark, key):
    from tools.check import compare, duck

    status = compare(spark, duck(SMALL), key, SMALL)[0]
    assert status in ("OK", "OK-EMPTY")
