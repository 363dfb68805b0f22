"""Data quality rules, referential integrity, cascading deletes and landing checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlight import schemas
from matchlight.domain import Domain
from matchlight.operators.skew import mark_members


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def duplicates(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, as text, with their count."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select(
            F.lit(name).alias("rule"),
            F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
            "n",
        )
    )


def orphans(child: DataFrame, name: str, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Values of a foreign key with no parent row, with the number of child rows.

    Child rows are counted per value before the join, so a busy value is one row by then.
    """
    values = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(
        F.count("*").alias("n")
    )
    return values.join(parent.select(F.col(key).alias("key")), "key", "left_anti").select(
        F.lit(name).alias("rule"), F.col("key").cast("string").alias("key"), "n"
    )


def foreign_keys(d: Domain) -> DataFrame:
    """All foreign-key violations of the schema, for the stored and for the derived tables."""
    m, players, games = d.matches, d.players, d.games
    stats, ratings = d.stats, ratings_of(d)
    return union_all(
        [
            orphans(m, "match.game", "game_id", games, "game_id"),
            orphans(m, "match.player1", "player1_id", players, "player_id"),
            orphans(m, "match.player2", "player2_id", players, "player_id"),
            orphans(m, "match.winner", "winner_id", players, "player_id"),
            orphans(d.moves, "moves.match", "match_id", m, "match_id"),
            orphans(d.moves, "moves.player", "player_id", players, "player_id"),
            orphans(stats, "stats.player", "player_id", players, "player_id"),
            orphans(stats, "stats.game", "game_id", games, "game_id"),
            orphans(ratings, "ratings.player", "player_id", players, "player_id"),
            orphans(ratings, "ratings.game", "game_id", games, "game_id"),
        ]
    )


def ratings_of(d: Domain) -> DataFrame:
    """The rating table: the stored one, or the ratings of the current statistics."""
    stored = getattr(d, "ratings", None)
    return d.scored.select("player_id", "game_id", "rating") if stored is None else stored


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and NULLs per required column in one pass."""
    counts = df.agg(
        F.count("*").alias("rows"),
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"n_{c}") for c in columns],
    )
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("nulls")) for c in columns]
    return counts.select("rows", F.inline(F.array(*entries)))


# Columns that must not be NULL.
REQUIRED = {
    "players": ("player_id", "username", "firstname", "lastname", "email", "birthdate", "gender", "country"),
    "games": ("game_id", "name", "can_draw"),
    "match_history": ("match_id", "game_id", "player1_id", "player2_id", "start_time", "end_time", "duration_minutes", "result"),
    "match_moves": ("match_id", "player_id", "moves_count"),
}


def incomplete(df: DataFrame, table: str) -> DataFrame:
    """Rows of a table, and those in which a required column is NULL."""
    gap = F.lit(False)
    for column in REQUIRED[table]:
        gap = gap | F.col(column).isNull()
    return df.agg(
        F.lit(table).alias("table_name"), F.count("*").alias("rows"), F.count(F.when(gap, 1)).alias("nulls")
    )


def domain_violations(scored: DataFrame, players: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows outside the allowed values, counted per rule."""
    low, high = schemas.RATING_RANGE
    checks = [
        ("rating", scored, ~F.col("rating").between(low, high)),
        ("player_level", scored, ~F.col("player_level").isin(*schemas.LEVELS)),
        ("gender", players, ~F.col("gender").isin(*schemas.GENDERS)),
        ("result", matches, ~F.col("result").isin(*schemas.RESULTS)),
    ]
    return union_all(
        [
            df.agg(
                F.lit(rule).alias("rule"),
                F.count("*").alias("rows"),
                F.count(F.when(bad, 1)).alias("violations"),
            )
            for rule, df, bad in checks
        ]
    )


def request_rules() -> dict[str, Column]:
    """Rules of a scoring request: it passes when every condition holds."""
    games, moves = F.col("total_games_played"), F.col("total_moves")
    return {
        "games_positive": games > 0,
        "moves_positive": moves > 0,
        "wins_not_negative": F.col("total_wins") >= 0,
        "losses_not_negative": F.col("total_losses") >= 0,
        "minutes_positive": F.col("total_time_played_minutes") > 0,
        "win_ratio_percent": F.col("win_ratio").between(0, 100),
        "age_in_range": (F.col("age") > 0) & (F.col("age") < 120),
        "game_name_length": F.length("game_name").between(1, 100),
        "gender_given": F.col("gender").isNotNull(),
        "country_given": F.col("country").isNotNull(),
    }


def failed_rules(requests: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """Add ``failed``: the names of the broken rules, in rule order. NULL input breaks a rule."""
    checks = [
        F.when(~F.coalesce(passed, F.lit(False)), F.lit(name))
        for name, passed in (rules or request_rules()).items()
    ]
    return requests.withColumn("failed", F.array_compact(F.array(*checks)))


# --- deletes ----------------------------------------------------------------------------------


def delete_players(d: Domain, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables after deleting players: their matches, moves and stats go with them.

    A winner outside the match's two players is set to NULL if deleted. Moves follow their match:
    a move row of a deleted player belongs to one of that player's matches. Statistics and ratings of
    the deleted players go, too; those of their opponents are for ``rollup.refresh_keys`` to renew.
    """
    ids = gone.select("player_id").distinct()
    marked = d.matches
    for column in ("player1_id", "player2_id", "winner_id"):
        marked = mark_members(
            marked, ids, column, f"gone_{column}", "match_id", keys_from=d.matches
        )
    matches = (
        marked.filter(~F.col("gone_player1_id") & ~F.col("gone_player2_id"))
        .withColumn("winner_id", F.when(~F.col("gone_winner_id"), F.col("winner_id")))
        .select(*d.matches.columns)
    )
    moves = d.moves.join(matches.select("match_id"), "match_id", "left_semi")
    return {
        "players": d.players.join(ids, "player_id", "left_anti"),
        "match_history": matches,
        "match_moves": moves.select(*d.moves.columns),
        "player_game_stats": d.stats.join(ids, "player_id", "left_anti"),
        "player_ratings": ratings_of(d).join(ids, "player_id", "left_anti"),
    }


def delete_games(d: Domain, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables after deleting games with their matches, moves, statistics and ratings."""
    ids = d.per_game(gone.select("game_id").distinct())
    matches = d.matches.join(ids, "game_id", "left_anti").select(*d.matches.columns)
    moves = d.moves.join(matches.select("match_id"), "match_id", "left_semi")
    return {
        "games": d.games.join(ids, "game_id", "left_anti"),
        "match_history": matches,
        "match_moves": moves.select(*d.moves.columns),
        "player_game_stats": d.stats.join(ids, "game_id", "left_anti"),
        "player_ratings": ratings_of(d).join(ids, "game_id", "left_anti"),
    }


# --- landing checks ---------------------------------------------------------------------------


def reconcile(published: DataFrame, landed: DataFrame, target: str, key: str) -> DataFrame:
    """Published keys, how many reached their table and how many did not."""
    ids = published.select(key).distinct()
    hits = landed.select(key).distinct().withColumn("_hit", F.lit(True))
    return ids.join(hits, key, "left").agg(
        F.lit(target).alias("target"),
        F.count("*").alias("published"),
        F.count("_hit").alias("landed"),
        F.count(F.when(F.col("_hit").isNull(), 1)).alias("missing"),
    )
