"""The scoring formulas as pure column expressions; the reference time is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlight.functions.numbers import (
    clamp,
    days_since,
    exact,
    percent,
    ratio,
    rounded,
    seconds_between,
)


def _banded(days: Column, bands: list[tuple[int, int]], otherwise: int) -> Column:
    """The value of the first band whose upper bound the day count is below."""
    column = F.when(days < bands[0][0], F.lit(bands[0][1]))
    for bound, value in bands[1:]:
        column = column.when(days < bound, F.lit(value))
    return column.otherwise(F.lit(otherwise))


# --- activity and level -----------------------------------------------------------------------


def win_ratio(wins: Column, games: Column) -> Column:
    """Wins as a percentage with two decimals; 0 before the first game."""
    return F.when(games == 0, F.lit(0.0)).otherwise(percent(wins, games))


def churn_inactive(last_played: Column, as_of, days: int = 30) -> Column:
    return last_played.isNull() | (days_since(last_played, as_of) > days)


def churn_rule(games: Column, win_share: Column) -> Column:
    """Churned when under ten games or under a fifth of them won (share in 0..1)."""
    return (games < 10) | F.coalesce(win_share < 0.2, F.lit(False))


def engagement_live(games: Column, minutes: Column, last_played: Column, as_of) -> Column:
    """0..100: games, recency and time played."""
    days = days_since(last_played, as_of)
    recency = F.when(last_played.isNull(), F.lit(0)).otherwise(
        _banded(days, [(7, 40), (14, 30), (30, 20)], 0)
    )
    total = (
        F.coalesce(games, F.lit(0)) * F.lit(40.0) / F.lit(100.0)
        + recency
        + F.coalesce(minutes, F.lit(0)) * F.lit(20.0) / F.lit(1000.0)
    )
    return F.when(games.isNull(), F.lit(0.0)).otherwise(rounded(clamp(total, 0.0, 100.0)))


def engagement_bulk(games: Column, minutes: Column, first_played: Column, as_of) -> Column:
    """0..100: mean session length times games per day since the first match."""
    days = F.greatest(F.lit(1), days_since(first_played, as_of))
    value = ratio(minutes, games) * ratio(games, days)
    return rounded(clamp(F.coalesce(value, F.lit(0.0)), 0.0, 100.0))


def player_level(games: Column, wins: Column) -> Column:
    share = ratio(wins * F.lit(100.0), games)
    return (
        F.when(games < 10, F.lit("novice"))
        .when((share > 65) & (games >= 50), F.lit("expert"))
        .otherwise(F.lit("intermediate"))
    )


def skill_tier(win_rate: Column) -> Column:
    return (
        F.when(win_rate >= 55, F.lit("Expert"))
        .when(win_rate >= 45, F.lit("Intermediate"))
        .otherwise(F.lit("Beginner"))
    )


def win_probability_live(wins: Column, games: Column) -> Column:
    return rounded(clamp(F.coalesce(ratio(wins, games), F.lit(0.5)), 0.1, 0.9), 4)


def win_probability_bulk(wins: Column, draws: Column, matches: Column) -> Column:
    """Mean of 1 / 0.5 / 0 per win / draw / loss."""
    mean = ratio(wins.cast("double") + draws.cast("double") * F.lit(0.5), matches)
    return rounded(clamp(F.coalesce(mean, F.lit(0.5)), 0.1, 0.9), 4)


# --- ratings ----------------------------------------------------------------------------------


def _time_points(minutes: Column) -> Column:
    return F.when(minutes >= 1000, F.lit(100.0)).otherwise(
        F.coalesce(minutes, F.lit(0)).cast("double") / F.lit(10.0)
    )


def _stars(weighted_tenths: Column) -> Column:
    """Tenths of the 0..100 weighted score to 1..5; tenths keep the floor exact."""
    step = F.floor(weighted_tenths.cast("double") / F.lit(200.0)).cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(5), step))


def _weighted_tenths(
    wins: Column, games: Column, game_points: Column, minutes: Column, weights: tuple[int, int, int]
) -> Column:
    win_points = exact(F.coalesce(ratio(wins * F.lit(100.0), games), F.lit(0.0)))
    return (
        win_points * F.lit(weights[0])
        + game_points * F.lit(weights[1])
        + exact(_time_points(minutes)) * F.lit(weights[2])
    )


def rating_live(games: Column, wins: Column, minutes: Column) -> Column:
    """1..5 stars: 40% win ratio, 30% games up to 100, 30% time; 1 under five games."""
    points = F.least(games, F.lit(100))
    tenths = _weighted_tenths(wins, games, points, minutes, (4, 3, 3))
    return F.when(F.coalesce(games, F.lit(0)) < 5, F.lit(1)).otherwise(_stars(tenths))


def rating_older(games: Column, wins: Column, minutes: Column) -> Column:
    """1..5 stars: 50% win ratio, 30% games (full at 50), 20% time."""
    points = F.when(games >= 50, F.lit(100)).otherwise(games * 2)
    tenths = _weighted_tenths(wins, games, points, minutes, (5, 3, 2))
    return F.when(F.coalesce(games, F.lit(0)) < 5, F.lit(1)).otherwise(_stars(tenths))


def rating_bulk(games: Column, wins: Column, minutes: Column, draw: Column) -> Column:
    """1..5 stars with a random tenth; ``draw`` is a uniform number in [0, 1)."""
    points = F.least(games, F.lit(100))
    tenths = _weighted_tenths(wins, games, points, minutes, (4, 3, 2)) + exact(draw * F.lit(100.0))
    return F.when(games < 5, F.lit(1) + F.floor(draw * 2).cast("int")).otherwise(_stars(tenths))


def player_score(win_pct: Column, games: Column, minutes: Column, last_played: Column, as_of) -> Column:
    """Ranking score: win ratio, games, recency and time, as an exact decimal."""
    days = days_since(last_played, as_of)
    recency = _banded(days, [(30, 100), (60, 75), (90, 50)], 25)
    return exact(
        win_pct * F.lit(0.40)
        + F.least(F.lit(100.0), games / F.lit(2.0)) * F.lit(0.25)
        + recency * F.lit(0.20)
        + F.least(F.lit(100.0), minutes / F.lit(60.0)) * F.lit(0.15)
    )


# --- engagement and session features ----------------------------------------------------------


def engagement_score(games: Column, wins: Column, minutes: Column) -> Column:
    """0.4 minutes + 0.3 games + 0.3 win share, exact."""
    return exact(
        minutes * F.lit(0.4) + games * F.lit(0.3) + ratio(wins, games) * F.lit(0.3)
    )


def future_engagement(games: Column, wins: Column, minutes: Column, age: Column) -> Column:
    return minutes * (F.lit(1.0) + ratio(wins, games)) * ratio(games, age)


def winner_efficiency(
    winner_id: Column, player1_id: Column, player2_id: Column, moves1: Column, moves2: Column
) -> Column:
    """Winner's moves per ship of five; NULL for a draw."""
    moves = F.when(winner_id == player1_id, moves1).when(winner_id == player2_id, moves2)
    return rounded(moves / F.lit(5.0))


def match_minutes(start_time: Column, end_time: Column) -> Column:
    """Whole minutes, cut toward zero."""
    return (seconds_between(start_time, end_time) / F.lit(60.0)).cast("int")


def abs_pct_error(predicted: Column, actual: Column) -> Column:
    """Absolute error in percent of the actual value; NULL when that is 0."""
    return rounded(ratio(F.abs(predicted - actual) * F.lit(100.0), actual))


# --- forecasts and advice codes ---------------------------------------------------------------


def hours_minutes(minutes: Column, unit: str) -> Column:
    """'H hours M minutes per <unit>' with both parts floored."""
    hours = F.floor(minutes / F.lit(60.0)).cast("bigint")
    rest = F.floor(F.pmod(minutes, F.lit(60.0))).cast("bigint")
    return F.concat(
        hours.cast("string"), F.lit(" hours "), rest.cast("string"), F.lit(f" minutes per {unit}")
    )


def churn_advice(probability: Column, win_rate: Column) -> Column:
    return (
        F.when((probability > 0.7) & (win_rate < 40), F.lit("churn_high_low_skill"))
        .when(probability > 0.7, F.lit("churn_high_try_new_modes"))
        .when(probability > 0.4, F.lit("churn_medium_set_goals"))
        .otherwise(F.lit("churn_low_engaged"))
    )


def skill_advice(level: Column, win_rate: Column) -> Column:
    step = (
        F.when(win_rate > 70, F.lit("tournament"))
        .when(win_rate > 50, F.lit("advanced_strategy"))
        .otherwise(F.lit("keep_practicing"))
    )
    return F.concat(level, F.lit(": "), step)


def engagement_advice(monthly_minutes: Column) -> Column:
    daily = monthly_minutes / F.lit(30.0)
    return (
        F.when(daily > 120, F.lit("engagement_take_breaks"))
        .when(daily > 60, F.lit("engagement_balanced"))
        .otherwise(F.lit("engagement_casual_quick_match"))
    )


def win_advice(probability: Column, level: Column) -> Column:
    return (
        F.when(probability > 0.7, F.concat(F.lit("win_strong_at_"), level))
        .when(probability > 0.5, F.lit("win_good_chance"))
        .otherwise(F.lit("win_review_past_games"))
    )
