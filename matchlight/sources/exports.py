"""Extracts and exports: training rows, the feature table, the prediction log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlight.domain import Domain
from matchlight.functions.identifiers import stable_uuid
from matchlight.functions.numbers import exact_mean, moment
from matchlight.functions.scoring import abs_pct_error

PREDICTION_LOG = (
    "id string, player_id bigint, game_id int, engagement_duration bigint, "
    "prediction_timestamp timestamp_ntz, actual_duration bigint, accuracy double"
)


def training_extract(d: Domain) -> DataFrame:
    return d.star.filter(
        (F.col("total_games_played") > 0) & (F.col("total_time_played_minutes") > 0)
    ).select(
        "player_id",
        "game_name",
        "total_time_played_minutes",
        "total_games_played",
        "total_wins",
        "total_moves",
        "age",
    )


def feature_export(d: Domain) -> DataFrame:
    """One row per player and game with dimensions, targets and the best in-game score.

    A domain without ``score_events`` has no scores: the column is NULL.
    """
    events = getattr(d, "score_events", None)
    if events is None:
        rows = d.star.withColumn("highest_score", F.lit(None).cast("double"))
    else:
        best = events.groupBy("player_id", "game_id").agg(F.max("score").alias("highest_score"))
        rows = d.star.join(best, ["player_id", "game_id"], "left")
    return rows.select(
        "player_id",
        "game_id",
        "username",
        "age",
        "gender",
        "country",
        "game_name",
        "total_games_played",
        "total_wins",
        "total_losses",
        "win_ratio",
        "total_moves",
        "total_time_played_minutes",
        "highest_score",
        "rating",
        F.when(F.col("is_churned"), "YES").otherwise("NO").alias("churned"),
        "is_churned",
        "player_level",
        "win_probability",
        "last_played",
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def moves_from_wide(wide: DataFrame) -> DataFrame:
    """Two move rows out of one wide match; seats without a count give none."""
    seats = [
        F.struct(F.col(player).alias("player_id"), F.col(count).alias("moves_count"))
        for player, count in (("player1_id", "player1_moves"), ("player2_id", "player2_moves"))
    ]
    return wide.select("match_id", F.inline(F.array(*seats))).filter("moves_count is not null")


def extremes(df: DataFrame, column: str) -> DataFrame:
    """The rows with the largest and the smallest value, lowest key first among equals."""
    row = F.struct("player_id", "game_id", column)
    low = F.struct(column, "player_id", "game_id")
    high = F.struct(F.col(column), -F.col("player_id"), -F.col("game_id"))
    both = df.agg(F.max_by(row, high).alias("longest"), F.min_by(row, low).alias("shortest"))
    pairs = F.array(
        *[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("r")) for kind in ("longest", "shortest")]
    )
    return both.select(F.inline(pairs)).select("kind", "r.*")


def mean_forecast(d: Domain) -> DataFrame:
    """A plain forecast of minutes per player and game: the mean of the game, cut to whole minutes."""
    minutes = F.col("total_time_played_minutes")
    per_game = d.stats.groupBy("game_id").agg(
        F.floor(exact_mean(minutes)).cast("bigint").alias("engagement_duration")
    )
    return d.stats.select("player_id", "game_id").join(d.per_game(per_game), "game_id")


def prediction_log(forecast: DataFrame, as_of) -> DataFrame:
    """Log rows for forecasts whose actual value is still to come."""
    return forecast.select(
        stable_uuid(F.col("player_id"), F.col("game_id")).alias("id"),
        "player_id",
        "game_id",
        "engagement_duration",
        moment(as_of).alias("prediction_timestamp"),
        F.lit(None).cast("bigint").alias("actual_duration"),
        F.lit(None).cast("double").alias("accuracy"),
    )


def predictions_of(log: DataFrame, player_id: int) -> DataFrame:
    return log.filter(F.col("player_id") == player_id)


def with_actuals(log: DataFrame, actuals: DataFrame) -> DataFrame:
    """Log rows whose actual value arrived, with the absolute error in percent."""
    return log.drop("actual_duration", "accuracy").join(actuals, ["player_id", "game_id"]).select(
        "id",
        "player_id",
        "game_id",
        "engagement_duration",
        "actual_duration",
        abs_pct_error(F.col("engagement_duration"), F.col("actual_duration")).alias("abs_pct_error"),
    )
