"""Players per game and day as mergeable sketches: distinct counts over any range of days.

A distinct count of a month is not the sum of those of its days, so every new range would read all matches again.
The table here has one row per game and day with what adds up (matches, minutes), the day's exact number of
players and a sketch of them. Sketches of days merge into the sketch of a range, whatever the range, so a report
reads games x days rows. Sketches cannot give a player back, so a day with a late, corrected or deleted match is
made anew from its own matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlight.operators.participants import participants
from matchlight.session import stored
from matchlight.sources.buckets import BucketTable

CELLS = 15  # log2 of the cells of a sketch: at most 32 kB a row, standard error 0.6 %
KEYS = ["day", "game_id"]


def activity_table(spark, path: str, buckets: int = 64) -> BucketTable:
    """The stored form; a day is in one bucket, so a refresh rewrites the buckets of its days."""
    return BucketTable(spark, path, KEYS, ["day"], buckets)


def daily_activity(matches: DataFrame) -> DataFrame:
    """(day, game_id, matches, minutes, players, sketch); a match belongs to the day it starts.

    Rows combine per player first, so a game with a third of all matches is spread over its players.
    Matches without a start or game belong to no row; a NULL player is counted in no row's players.
    """
    dated = matches.select("game_id", "player1_id", "player2_id", "duration_minutes", F.to_date("start_time").alias("day"))
    first = F.col("seat") == 1
    per_player = (
        participants(dated.where("day is not null and game_id is not null"))
        .groupBy("day", "game_id", "player_id")
        .agg(F.count_if(first).alias("matches"), F.sum(F.when(first, F.col("duration_minutes"))).alias("minutes"))
    )
    return per_player.groupBy("day", "game_id").agg(
        F.sum("matches").cast("bigint").alias("matches"),
        F.coalesce(F.sum("minutes"), F.lit(0)).cast("bigint").alias("minutes"),
        F.count("player_id").alias("players"),
        F.hll_sketch_agg("player_id", CELLS).alias("sketch"),
    )


def refresh_days(table: BucketTable, days: DataFrame, matches: DataFrame, version: int) -> int:
    """Make the rows of some days anew; gives the number of buckets rewritten.

    ``days`` has a column ``day``; matches of other days end in the task that reads them. A game without
    matches left on a day keeps a row with zeros.
    """
    days = stored(days.select("day").where("day is not null").distinct(), "days")
    fresh = daily_activity(matches.withColumn("day", F.to_date("start_time")).join(days, "day", "left_semi"))
    old = table.read(before=version)
    if old is not None:
        gone = old.select(*KEYS).join(days, "day", "left_semi").join(fresh.select(*KEYS), KEYS, "left_anti")
        zero = F.lit(0).cast("bigint")
        fresh = fresh.unionByName(
            gone.select(
                *KEYS, zero.alias("matches"), zero.alias("minutes"), zero.alias("players"), F.lit(None).cast("binary").alias("sketch")
            )
        )
    return table.upsert(stored(fresh, "fresh-days"), version)


def days_of(ranges: DataFrame) -> DataFrame:
    """(range_id, day) of ranges (range_id, first_day, last_day), both ends included; NULL ends or a last
    day before the first have no days."""
    return ranges.where("first_day <= last_day").select("range_id", F.explode(F.sequence("first_day", "last_day")).alias("day")).distinct()


def active_players(daily: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, game_id, matches, minutes, players) per game, and with a NULL game over all games.

    ``players`` is estimated from merged sketches. Ranges without matches have no row. Days of a game merge first, games
    of a range after that, so the second step reads ranges x games rows.
    """
    per_game = (
        daily.where("matches > 0")
        .join(days_of(ranges), "day")
        .groupBy("range_id", "game_id")
        .agg(F.sum("matches").alias("matches"), F.sum("minutes").alias("minutes"), F.hll_union_agg("sketch").alias("sketch"))
    )
    return (
        per_game.groupingSets([["range_id", "game_id"], ["range_id"]], "range_id", "game_id")
        .agg(
            F.sum("matches").cast("bigint").alias("matches"),
            F.sum("minutes").cast("bigint").alias("minutes"),
            F.hll_union_agg("sketch").alias("sketch"),
        )
        .withColumn("players", F.hll_sketch_estimate("sketch"))
        .drop("sketch")
    )


def active_players_exact(matches: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, game_id, players) as :func:`active_players`, exactly, from the matches.

    Distinct (day, game, player) come first, then the players of a range are grouped; no distinct aggregate
    and so no row expanded for it.
    """
    dated = matches.select("game_id", "player1_id", "player2_id", F.to_date("start_time").alias("day"))
    seen = (
        participants(dated.where("day is not null and game_id is not null"))
        .select("day", "game_id", "player_id")
        .distinct()
        .join(days_of(ranges), "day")
        .groupBy("range_id", "game_id", "player_id")
        .agg(F.count("*").alias("days"))
    )
    seen = stored(seen, "players-of-ranges")
    per_game = seen.groupBy("range_id", "game_id").agg(F.count("player_id").alias("players"))
    everywhere = seen.groupBy("range_id", "player_id").agg(F.count("*").alias("games")).groupBy("range_id").agg(F.count("player_id").alias("players"))
    no_game = F.lit(None).cast(matches.schema["game_id"].dataType)
    return per_game.unionByName(everywhere.select("range_id", no_game.alias("game_id"), "players"))


def calendar_ranges(matches: DataFrame) -> DataFrame:
    """The months and years with matches and the whole time, as ranges."""
    start = F.to_date("start_time")
    days = matches.select(start.alias("day")).where("day is not null").distinct()
    months = days.select(F.trunc("day", "month").alias("first_day")).distinct()
    years = days.select(F.trunc("day", "year").alias("first_day")).distinct()
    whole = days.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")).where("first_day is not null")
    return (
        months.select(F.date_format("first_day", "yyyy-MM").alias("range_id"), "first_day", F.last_day("first_day").alias("last_day"))
        .union(years.select(F.date_format("first_day", "yyyy"), "first_day", F.date_add(F.add_months("first_day", 12), -1)))
        .union(whole.select(F.lit("all"), "first_day", "last_day"))
    )
