"""From matches to participants: the base of every per-player result.

A match names two players. Joining players to matches on "seat 1 or seat 2" would be a nested
loop, so each match becomes one row per seat and everything after that is an equi-join or a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def participants(matches: DataFrame) -> DataFrame:
    """One row per (match, player) with the seat; a match against oneself counts once."""
    seat1 = F.struct(F.col("player1_id").alias("player_id"), F.lit(1).alias("seat"))
    seat2 = F.struct(F.col("player2_id").alias("player_id"), F.lit(2).alias("seat"))
    seats = F.when(F.col("player1_id") == F.col("player2_id"), F.array(seat1)).otherwise(
        F.array(seat1, seat2)
    )
    kept = [c for c in matches.columns if c not in ("player1_id", "player2_id")]
    return matches.select(*kept, F.inline(seats))


def moves_per_participant(moves: DataFrame) -> DataFrame:
    """One row per (match, player), so joining it can never multiply a match."""
    return moves.groupBy("match_id", "player_id").agg(
        F.sum("moves_count").cast("bigint").alias("moves")
    )


def with_moves(matches: DataFrame, moves: DataFrame) -> DataFrame:
    """Matches with both players' move counts, NULL where none was recorded.

    Everything here is keyed by ``match_id``: the moves are combined per (match, player), joined
    and folded back to one row per match. On tables bucketed by ``match_id`` no row is shuffled;
    otherwise a match crosses the network once, before it is split into its two seats. All match
    columns are group keys, so later filters on them reach the scan; select the needed ones first.
    """
    def moves_of(player: str):
        return F.max(F.when(F.col("player_id") == F.col(player), F.col("moves")))

    return (
        matches.join(moves_per_participant(moves), "match_id", "left")
        .groupBy(*matches.columns)
        .agg(
            moves_of("player1_id").alias("player1_moves"),
            moves_of("player2_id").alias("player2_moves"),
        )
    )


def participants_with_moves(matches: DataFrame, moves: DataFrame) -> DataFrame:
    """Participants with their own move count."""
    own = F.when(F.col("seat") == 1, F.col("player1_moves")).otherwise(F.col("player2_moves"))
    return (
        participants(with_moves(matches, moves))
        .withColumn("moves", own)
        .drop("player1_moves", "player2_moves")
    )


def matches_wide(matches: DataFrame, moves: DataFrame, games: DataFrame) -> DataFrame:
    """Match rows with the game name and both move counts."""
    names = games.select("game_id", F.col("name").alias("game_name"))
    return with_moves(matches, moves).join(names, "game_id")
