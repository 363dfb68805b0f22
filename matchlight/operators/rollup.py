"""The player-game roll-up, in full and for changed keys only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlight.functions import scoring as S
from matchlight.functions.numbers import ratio, rounded
from matchlight.operators import bloom
from matchlight.operators.participants import (
    moves_per_participant,
    participants,
    participants_with_moves,
)
from matchlight.session import stored

COUNTS = (
    "total_games_played",
    "total_wins",
    "total_losses",
    "total_draws",
    "total_moves",
    "total_time_played_minutes",
)


def player_game_stats(matches: DataFrame, moves: DataFrame) -> DataFrame:
    """Games, outcomes, moves, minutes and first/last time per (player, game).

    Matches and moves meet per match, before players come into play, so no popular player can
    overload a task there; the group on (player, game) combines rows before its shuffle.
    ``match_id`` is unique, hence counting rows equals counting distinct matches.
    """
    slim = matches.select(
        "match_id",
        "game_id",
        "player1_id",
        "player2_id",
        "winner_id",
        "start_time",
        "end_time",
        "duration_minutes",
    )
    return aggregate_participants(participants_with_moves(slim, moves))


def aggregate_participants(rows: DataFrame) -> DataFrame:
    won = F.col("winner_id") == F.col("player_id")
    drawn = F.col("winner_id").isNull()

    def count_when(condition):
        return F.count(F.when(condition, F.lit(1))).cast("bigint")

    return rows.groupBy("player_id", "game_id").agg(
        F.count("*").alias("total_games_played"),
        count_when(won).alias("total_wins"),
        count_when(~won).alias("total_losses"),
        count_when(drawn).alias("total_draws"),
        F.coalesce(F.sum("moves"), F.lit(0)).cast("bigint").alias("total_moves"),
        F.coalesce(F.sum("duration_minutes"), F.lit(0))
        .cast("bigint")
        .alias("total_time_played_minutes"),
        F.min("start_time").alias("first_played"),
        F.max("end_time").alias("last_played"),
    )


def with_scores(stats: DataFrame, as_of) -> DataFrame:
    """Stats plus every live target: win ratio, churn, engagement, level, probability, rating."""
    g, w = F.col("total_games_played"), F.col("total_wins")
    t, last = F.col("total_time_played_minutes"), F.col("last_played")
    return stats.withColumns(
        {
            "win_ratio": S.win_ratio(w, g),
            "is_churned": S.churn_inactive(last, as_of),
            "engagement_level": S.engagement_live(g, t, last, as_of),
            "player_level": S.player_level(g, w),
            "win_probability": S.win_probability_live(w, g),
            "rating": S.rating_live(g, w, t),
        }
    )


def affected_keys(changed_matches: DataFrame) -> DataFrame:
    """The (player, game) keys a set of inserted, changed or deleted matches touches."""
    return (
        participants(changed_matches.select("match_id", "game_id", "player1_id", "player2_id"))
        .select("player_id", "game_id")
        .distinct()
    )


def refresh_keys(keys: DataFrame, matches: DataFrame, moves: DataFrame) -> DataFrame:
    """Recompute the stats of the given keys; a key without matches left comes back with zeros.

    The players go to the scans, a few as values, many as a Bloom filter of fixed size: matches with neither
    seat among them and moves of others end in the task that reads them, before a match becomes two
    seats and whatever the number of keys. What is left is compared with the keys exactly. The keys are stored first,
    as every step reads them.
    """
    keys = stored(keys, "changed-keys")
    players = bloom.listed(keys, "player_id")
    slim = matches.select(
        "match_id",
        "game_id",
        "player1_id",
        "player2_id",
        "winner_id",
        "start_time",
        "end_time",
        "duration_minutes",
    )
    near = bloom.narrowed(slim, ["player1_id", "player2_id"], keys, "player_id", players)
    touched = participants(near).join(keys, ["player_id", "game_id"], "left_semi")
    touched_moves = bloom.narrowed(moves, ["player_id"], keys, "player_id", players)
    fresh = aggregate_participants(
        touched.join(moves_per_participant(touched_moves), ["match_id", "player_id"], "left")
    )
    joined = keys.join(fresh, ["player_id", "game_id"], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in COUNTS})


def stats_of_players(ids: DataFrame, matches: DataFrame, moves: DataFrame) -> DataFrame:
    """The roll-up of some players: their seats and moves are picked before the two meet."""
    few = stored(ids.select("player_id").distinct(), "players")
    players = bloom.listed(few, "player_id")
    near = bloom.narrowed(matches, ["player1_id", "player2_id"], few, "player_id", players)
    seats = participants(near).join(few, "player_id", "left_semi")
    own = moves_per_participant(bloom.narrowed(moves, ["player_id"], few, "player_id", players))
    return aggregate_participants(seats.join(own, ["match_id", "player_id"], "left"))


def stats_from_wide(wide: DataFrame) -> DataFrame:
    """The roll-up from wide matches, where each seat's move count is a column of the match."""
    won = F.col("winner_id") == F.col("player_id")
    moves = F.when(F.col("seat") == 1, F.col("player1_moves")).otherwise(F.col("player2_moves"))
    return (
        participants(wide)
        .groupBy("player_id", "game_id")
        .agg(
            F.count("*").alias("total_games_played"),
            F.count(F.when(won, 1)).alias("total_wins"),
            F.count(F.when(~won, 1)).alias("total_losses"),
            F.sum(moves).cast("bigint").alias("total_moves"),
            F.sum("duration_minutes").cast("bigint").alias("total_time_played_minutes"),
            F.max("end_time").alias("last_played"),
        )
    )


def outcome_shares(rows: DataFrame) -> DataFrame:
    """Games, wins, losses and the share won (0..1) from participants."""
    won = F.col("winner_id") == F.col("player_id")
    return (
        rows.groupBy("player_id", "game_id")
        .agg(
            F.count("*").alias("games"),
            F.count_if(won).alias("wins"),
            F.count_if(~won).alias("losses"),
        )
        .withColumn("win_share", rounded(ratio(F.col("wins"), F.col("games")), 4))
    )
