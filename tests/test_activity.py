"""Players over ranges of days: the stored table of days, its refresh and its estimates."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from matchlight.operators import activity

MATCH = "match_id long, game_id int, player1_id long, player2_id long, start_time timestamp, duration_minutes int"
RANGE = "range_id string, first_day date, last_day date"


@pytest.fixture(scope="module")
def matches(spark):
    """20,000 matches over 60 days; game 1 holds a third of them, player 7 sits in every fifth."""
    start = F.lit(datetime(2024, 3, 1))
    hashed = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    return spark.range(20_000).select(
        F.col("id").alias("match_id"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(2 + hashed("game", 4)).cast("int").alias("game_id"),
        F.when(F.col("id") % 5 == 0, 7).otherwise(hashed("one", 6000)).alias("player1_id"),
        hashed("two", 6000).alias("player2_id"),
        (start + F.make_interval(hours=(hashed("hour", 60 * 24)).cast("int"))).alias("start_time"),
        (5 + hashed("long", 50)).cast("int").alias("duration_minutes"),
    )


def brute(rows, first, last, game=None):
    """Matches, minutes and players of a range, counted one by one."""
    mine = [r for r in rows if first <= r.start_time.date() <= last and game in (None, r.game_id)]
    players = {p for r in mine for p in (r.player1_id, r.player2_id)} - {None}
    return len(mine), sum(r.duration_minutes for r in mine), len(players)


def ranges_of(spark):
    first = date(2024, 3, 1)
    spans = {"day": (3, 3), "week": (10, 16), "month": (0, 30), "all": (0, 90), "overlap": (5, 35)}
    rows = [(k, first + timedelta(a), first + timedelta(b)) for k, (a, b) in spans.items()]
    odd = [("reversed", first + timedelta(9), first), ("open", first, None), ("empty", date(1999, 1, 1), date(1999, 2, 1))]
    return rows, spark.createDataFrame(rows + odd, RANGE)


def test_ranges_against_brute_force(spark, matches):
    spans, ranges = ranges_of(spark)
    rows = matches.collect()
    want = {(k, g): brute(rows, a, b, g) for k, a, b in spans for g in (None, 1, 2, 3, 4, 5)}
    exact = {(r.range_id, r.game_id): r.players for r in activity.active_players_exact(matches, ranges).collect()}
    assert exact == {k: v[2] for k, v in want.items()}
    got = {(r.range_id, r.game_id): r for r in activity.active_players(activity.daily_activity(matches), ranges).collect()}
    assert {k: (r.matches, r.minutes) for k, r in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(abs(r.players - want[k][2]) <= 0.02 * want[k][2] for k, r in got.items())


def test_a_refresh_makes_the_days_of_late_and_deleted_matches_anew(spark, matches, tmp_path):
    table = activity.activity_table(spark, str(tmp_path), buckets=16)
    late = F.to_date("start_time") == F.lit(date(2024, 3, 9))
    only_game = late & (F.col("game_id") == 4)
    table.create(activity.daily_activity(matches.where(~(late & (F.col("match_id") % 2 == 0)))), 0)
    before = set(table.read().inputFiles())
    days = spark.createDataFrame([(date(2024, 3, 9),), (date(2024, 3, 9),), (None,)], "day date")
    assert activity.refresh_days(table, days, matches, 1) == 1
    assert len(before & set(table.read().inputFiles())) == len(before) - 1
    whole = {(r.day, r.game_id): (r.matches, r.minutes, r.players) for r in activity.daily_activity(matches).collect()}
    assert {(r.day, r.game_id): (r.matches, r.minutes, r.players) for r in table.read().collect()} == whole
    activity.refresh_days(table, days, matches.where(~only_game), 2)
    now = {(r.day, r.game_id): (r.matches, r.minutes, r.players) for r in table.read().collect()}
    assert now == whole | {(date(2024, 3, 9), 4): (0, 0, 0)}
    one_day = spark.createDataFrame([("d", date(2024, 3, 9), date(2024, 3, 9))], RANGE)
    assert {r.game_id for r in activity.active_players(table.read(), one_day).collect()} == {None, 1, 2, 3, 5}
    activity.refresh_days(table, days, matches, 3)
    again = activity.refresh_days(table, days, matches, 4)  # once more changes nothing
    assert again == 1 and {(r.day, r.game_id): (r.matches, r.minutes, r.players) for r in table.read().collect()} == whole


def test_text_ids_nulls_and_no_rows(spark):
    schema = MATCH.replace("player1_id long, player2_id long", "player1_id string, player2_id string")
    at = datetime(2024, 3, 1, 23, 59)
    rows = [
        (1, 1, "a", "b", at, 5), (2, 1, "a", "a", at, 5), (2, 1, "a", "a", at, 5),
        (3, 1, None, "c", at, None), (4, None, "d", "e", at, 5), (5, 1, "f", "g", None, 5),
    ]
    daily = activity.daily_activity(spark.createDataFrame(rows, schema))
    got = daily.withColumn("sketch", F.hll_sketch_estimate("sketch")).collect()
    assert [tuple(r) for r in got] == [(date(2024, 3, 1), 1, 4, 15, 3, 3)]
    none = spark.createDataFrame([], MATCH)
    assert activity.daily_activity(none).count() == 0 and activity.calendar_ranges(none).count() == 0
    _, ranges = ranges_of(spark)
    assert activity.active_players(activity.daily_activity(none), ranges).count() == 0
    assert activity.active_players_exact(none, ranges).count() == 0


def test_calendar_ranges(spark):
    rows = [(1, 1, 1, 2, datetime(2023, 12, 31, 5), 5), (2, 1, 1, 2, datetime(2024, 2, 1), 5)]
    got = {(r.range_id, r.first_day, r.last_day) for r in activity.calendar_ranges(spark.createDataFrame(rows, MATCH)).collect()}
    assert got == {
        ("2023-12", date(2023, 12, 1), date(2023, 12, 31)),
        ("2024-02", date(2024, 2, 1), date(2024, 2, 29)),
        ("2023", date(2023, 1, 1), date(2023, 12, 31)),
        ("2024", date(2024, 1, 1), date(2024, 12, 31)),
        ("all", date(2023, 12, 31), date(2024, 2, 1)),
    }
