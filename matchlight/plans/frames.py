"""Summary frames: popularity, distributions, descriptions, correlations, labels by threshold."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlight.domain import Domain
from matchlight.functions import scoring as S
from matchlight.functions.numbers import exact_mean, half_even, percent, ratio, rounded
from matchlight.operators.ordered import exact_quantiles

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _churn_rate() -> Column:
    return half_even(exact_mean(F.col("is_churned").cast("int") * 100.0))


def game_popularity(d: Domain) -> DataFrame:
    return (
        d.scored.groupBy("game_id")
        .agg(
            F.count("*").alias("total_players"),
            F.sum("total_games_played").cast("bigint").alias("total_games_played"),
            F.sum("total_wins").cast("bigint").alias("total_wins"),
            half_even(exact_mean(F.col("rating"))).alias("average_rating"),
            _churn_rate().alias("churn_rate"),
        )
        .join(d.game_names, "game_id")
        .drop("game_id")
        .orderBy(F.desc("total_players"), "game_name")
    )


def country_frame(d: Domain) -> DataFrame:
    games = F.col("total_games_played")
    return (
        d.star.groupBy("country")
        .agg(
            F.count("*").alias("total_players"),
            F.sum(games).cast("bigint").alias("total_games"),
            half_even(exact_mean(games)).alias("avg_games_per_player"),
            half_even(exact_mean(F.col("win_ratio"))).alias("avg_win_ratio"),
            half_even(exact_mean(F.col("rating"))).alias("avg_rating"),
            _churn_rate().alias("churn_rate"),
        )
        .orderBy(F.desc("total_players"), "country")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their share of all rows; the share comes from the few grouped rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    rows = counts.agg(F.sum("n")).scalar()
    return (
        counts.withColumn("rows", rows)
        .withColumn("share", percent(F.col("n"), F.col("rows"), 4))
        .drop("rows")
        .orderBy(F.desc("n"), column)
    )


def mean_by(df: DataFrame, group: str, column: str, name: str) -> DataFrame:
    return df.groupBy(group).agg(rounded(exact_mean(F.col(column)), 4).alias(name))


def describe_bounded(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of one column.

    For columns with few distinct values (ages, percentages with two decimals): the built-in exact
    percentile keeps one counter per distinct value.
    """
    x = F.col(column).cast("double")
    return df.agg(
        F.count(column).alias("n"),
        rounded(exact_mean(x), 6).alias("mean"),
        rounded(F.stddev_samp(x), 6).alias("std"),
        F.min(x).alias("low"),
        *[rounded(F.percentile(x, p), 6).alias(name) for name, p in QUARTILES.items()],
        F.max(x).alias("high"),
    )


def describe_features(df: DataFrame, features: list[str]) -> DataFrame:
    """The same for features with any number of distinct values, one row per feature."""
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"))
            for f in features
        ]
    )
    long = df.select(F.inline(pairs))
    basics = long.groupBy("feature").agg(
        F.count("x").alias("n"),
        rounded(exact_mean(F.col("x")), 6).alias("mean"),
        rounded(F.stddev_samp("x"), 6).alias("std"),
        rounded(F.min("x"), 6).alias("low"),
        rounded(F.max("x"), 6).alias("high"),
    )
    return basics.join(exact_quantiles(long, ["feature"], F.col("x"), QUARTILES), "feature")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, all in one pass."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(
        *[rounded(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias(f"{a}~{b}") for a, b in pairs]
    )
    entries = [
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"{a}~{b}").alias("r"))
        for a, b in pairs
    ]
    return wide.select(F.inline(F.array(*entries)))


def overall_rates(d: Domain) -> DataFrame:
    return d.scored.agg(
        rounded(exact_mean(F.col("total_games_played")), 4).alias("avg_games_per_player"),
        rounded(exact_mean(F.col("is_churned").cast("int") * 100.0), 4).alias("churn_rate"),
    )


def churn_by_quantile(d: Domain, share: float = 0.2) -> DataFrame:
    """Players whose engagement score lies below the given quantile of all scores."""
    score = S.engagement_score(
        F.col("total_games_played"), F.col("total_wins"), F.col("total_time_played_minutes")
    ).cast("double")
    scored = d.stats.select("player_id", "game_id", score.alias("engagement_score"))
    cut = exact_quantiles(scored, [], F.col("engagement_score"), {"cut": share}).scalar()
    return (
        scored.withColumn("cut", cut)
        .withColumn("churned", (F.col("engagement_score") < F.col("cut")).cast("int"))
        .drop("cut")
    )


def game_time_profile(d: Domain) -> DataFrame:
    minutes, games = F.col("total_time_played_minutes"), F.col("total_games_played")
    return (
        d.scored.groupBy("game_id")
        .agg(
            half_even(exact_mean(minutes)).alias("minutes_mean"),
            half_even(F.stddev_samp(minutes)).alias("minutes_std"),
            half_even(exact_mean(ratio(minutes, games))).alias("session_mean"),
            half_even(exact_mean(games)).alias("games_mean"),
            half_even(exact_mean(F.col("win_ratio"))).alias("win_ratio_mean"),
        )
        .join(d.game_names, "game_id")
        .drop("game_id")
    )


def time_quartiles_by_game(d: Domain) -> DataFrame:
    quartiles = exact_quantiles(
        d.stats, ["game_id"], F.col("total_time_played_minutes"), QUARTILES
    )
    return quartiles.join(d.game_names, "game_id").drop("game_id")


def per_game_features(d: Domain) -> DataFrame:
    g = F.col("total_games_played")
    return d.stats.select(
        "player_id",
        "game_id",
        ratio(F.col("total_time_played_minutes"), g).alias("avg_session_duration"),
        ratio(F.col("total_wins"), g).alias("historical_win_rate"),
        ratio(F.col("total_moves"), g).alias("avg_moves_per_game"),
    )


def game_avg_win_rate(d: Domain) -> DataFrame:
    """Every stats row with the mean win rate of its game.

    A window per game would put a popular game into one task; the mean is grouped and joined back.
    """
    rate = ratio(F.col("total_wins"), F.col("total_games_played"))
    per_game = d.stats.groupBy("game_id").agg(
        rounded(exact_mean(rate), 6).alias("game_avg_win_rate")
    )
    return d.stats.select("player_id", "game_id").join(d.per_game(per_game), "game_id")


def next_win_label(d: Domain) -> DataFrame:
    """1 where the player's win rate is above the mean of all rows."""
    rate = ratio(F.col("total_wins"), F.col("total_games_played"))
    overall = d.stats.agg(exact_mean(rate)).scalar()
    return (
        d.stats.select("player_id", "game_id", rate.alias("rate"), overall.alias("overall"))
        .withColumn("next_game_win", (F.col("rate") > F.col("overall")).cast("int"))
        .select("player_id", "game_id", "next_game_win")
    )


