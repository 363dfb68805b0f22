"""The set of tables a job works on, with the derived tables every report shares."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlight import schemas
from matchlight.functions.numbers import age_in_years, moment
from matchlight.operators import participants as P
from matchlight.operators import rollup
from matchlight.session import stored
from matchlight.sources.tables import read_table

# The game catalogue is joined by broadcast only up to this many rows.
SMALL_ROWS = 100_000


def people(players: DataFrame, as_of) -> DataFrame:
    """Player columns as they appear in reports and denormalised tables."""
    return players.select(
        "player_id",
        "username",
        F.concat("firstname", F.lit(" "), "lastname").alias("player_name"),
        age_in_years(F.col("birthdate"), as_of).alias("age"),
        "gender",
        "country",
    )


class Domain:
    """Players, games, matches and moves, plus the reference time.

    Derived tables are plans, not cached data; write :attr:`scored` once and pass it as
    ``stats`` when many reports read it.
    """

    def __init__(self, spark: SparkSession, as_of: str = "2001-08-03 00:00:00", **tables: DataFrame):
        self.spark = spark
        self.as_of = as_of
        self.has_stats = "stats" in tables
        for name, df in tables.items():
            setattr(self, name, df)

    @classmethod
    def from_folder(cls, spark: SparkSession, root: str, as_of: str) -> Domain:
        """The normalized tables as parquet folders named after them."""
        return cls(
            spark,
            as_of,
            games=read_table(spark, f"{root}/games", schemas.GAMES),
            players=read_table(spark, f"{root}/players", schemas.PLAYERS),
            matches=read_table(spark, f"{root}/match_history", schemas.MATCHES),
            moves=read_table(spark, f"{root}/match_moves", schemas.MOVES),
        )

    def rolled_up(self) -> Domain:
        """This domain with its statistics written once, for jobs that read them more than once."""
        if self.has_stats:
            return self
        tables = {name: getattr(self, name) for name in ("games", "players", "matches", "moves")}
        return Domain(self.spark, self.as_of, **tables, stats=stored(self.stats, "stats"))

    @property
    def now(self):
        return moment(self.as_of)

    @cached_property
    def few_games(self) -> bool:
        """Whether the game catalogue is small, counted up to the bound and no further."""
        return self.games.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS

    def per_game(self, df: DataFrame) -> DataFrame:
        """Mark a table with at most one row per game for broadcast, if the catalogue is small.

        A game can hold a third of all rows, so joining per game by shuffle would overload a task.
        """
        return F.broadcast(df) if self.few_games else df

    @cached_property
    def participants(self) -> DataFrame:
        return P.participants(self.matches)

    @cached_property
    def stats(self) -> DataFrame:
        return rollup.player_game_stats(self.matches, self.moves)

    @cached_property
    def scored(self) -> DataFrame:
        return rollup.with_scores(self.stats, self.as_of)

    def scored_of_games(self, ids: DataFrame) -> DataFrame:
        """Scored stats of some games; without a stored table only their matches are rolled up."""
        few = self.per_game(ids.select("game_id"))
        if self.has_stats:
            stats = self.stats.join(few, "game_id", "left_semi")
        else:
            stats = rollup.player_game_stats(
                self.matches.join(few, "game_id", "left_semi"), self.moves
            )
        return rollup.with_scores(stats, self.as_of)

    def scored_of_players(self, ids: DataFrame) -> DataFrame:
        """Scored stats of some players; without a stored table only their seats are rolled up."""
        if self.has_stats:
            stats = self.stats.join(ids.select("player_id"), "player_id", "left_semi")
        else:
            stats = rollup.stats_of_players(ids, self.matches, self.moves)
        return rollup.with_scores(stats, self.as_of)

    def scored_of_player(self, player_id: int) -> DataFrame:
        """Scored stats of one player; without a stored table the scans read only that player."""
        mine = F.col("player_id") == player_id
        if self.has_stats:
            stats = self.stats.filter(mine)
        else:
            seats = (F.col("player1_id") == player_id) | (F.col("player2_id") == player_id)
            stats = rollup.player_game_stats(
                self.matches.filter(seats), self.moves.filter(mine)
            ).filter(mine)
        return rollup.with_scores(stats, self.as_of)

    def named(self, scored: DataFrame) -> DataFrame:
        """Add the player's and the game's columns to scored stats.

        The fact side is already one row per (player, game), so the join on the player has no
        hot key whatever the number of matches.
        """
        return scored.join(self.people, "player_id").join(self.game_names, "game_id")

    @cached_property
    def game_names(self) -> DataFrame:
        return self.per_game(self.games.select("game_id", F.col("name").alias("game_name")))

    @cached_property
    def people(self) -> DataFrame:
        return people(self.players, self.as_of)

    @cached_property
    def star(self) -> DataFrame:
        """All scored stats with the player's and the game's columns."""
        return self.named(self.scored)

    @cached_property
    def wide(self) -> DataFrame:
        return P.matches_wide(self.matches, self.moves, self.per_game(self.games))
