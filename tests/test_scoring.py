import pytest
from pyspark.sql import functions as F

from matchlight.functions import scoring as S
from matchlight.functions.identifiers import bin_to_uuid, uuid_to_bin
from matchlight.functions.numbers import age_in_years, clamp, half_even, ratio, rounded

NOW = "2024-06-30 00:00:00"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def num(x, kind="bigint"):
    return F.lit(x).cast(kind)


def ago(days):
    return F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))


def table(spark, cases, column):
    """Evaluate one formula over many inputs in a single job."""
    width = len(cases[0][0])
    data = [(i, *args) for i, (args, _) in enumerate(cases)]
    names = ["i", *[f"a{j}" for j in range(width)]]
    df = spark.createDataFrame(data, names)
    got = df.select("i", column(*[F.col(n) for n in names[1:]]).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == [expected for _, expected in cases]


def test_levels_at_their_edges(spark):
    cases = [((9, 9), "novice"), ((10, 10), "intermediate"), ((49, 49), "intermediate"),
             ((50, 50), "expert"), ((100, 65), "intermediate"), ((100, 66), "expert"),
             ((130, 96), "expert"), ((123, 39), "intermediate"), ((4, 1), "novice")]
    table(spark, cases, lambda g, w: S.player_level(g, w))


def test_rating_edges(spark):
    cases = [((4, 4, 2000), 1), ((5, 5, 0), 2), ((100, 50, 1000), 4), ((100, 100, 1000), 5),
             ((100, 0, 999), 2), ((100, 0, 1000), 3), ((5, 0, 0), 1)]
    table(spark, cases, lambda g, w, t: S.rating_live(g, w, t))


def test_older_rating_is_full_at_fifty_games(spark):
    cases = [((4, 4, 2000), 1), ((50, 50, 1000), 5), ((49, 0, 0), 1), ((50, 0, 0), 1), ((50, 20, 500), 3)]
    table(spark, cases, lambda g, w, t: S.rating_older(g, w, t))


def test_bulk_rating_of_new_players_is_one_or_two(spark):
    cases = [((3, 3, 5000, 0.2), 1), ((3, 3, 5000, 0.7), 2), ((100, 100, 1000, 0.0), 4), ((100, 100, 1000, 0.999), 4)]
    table(spark, cases, lambda g, w, t, u: S.rating_bulk(g, w, t, u))


@pytest.mark.parametrize("days,points", [(6, 40), (7, 30), (13, 30), (14, 20), (29, 20), (30, 0)])
def test_engagement_recency(spark, days, points):
    got = value(spark, S.engagement_live(num(10), num(100), ago(days), NOW))
    assert got == pytest.approx(10 * 0.4 + points + 2.0)


def test_engagement_is_clamped_and_null_safe(spark):
    assert value(spark, S.engagement_live(num(1000), num(99999), ago(1), NOW)) == 100.0
    never = F.lit(None).cast("timestamp_ntz")
    assert value(spark, S.engagement_live(num(None), num(None), never, NOW)) == 0.0
    assert value(spark, S.engagement_live(num(0), num(None), never, NOW)) == 0.0


@pytest.mark.parametrize("days,churned", [(30, False), (31, True)])
def test_inactivity_churn(spark, days, churned):
    assert value(spark, S.churn_inactive(ago(days), NOW)) is churned


def test_never_played_is_churned(spark):
    assert value(spark, S.churn_inactive(F.lit(None).cast("timestamp_ntz"), NOW)) is True


def test_churn_rule_samples(spark):
    cases = [((5, 0.1), 1), ((1500, 0.85), 0), ((3, 0.05), 1), ((800, 0.75), 0), ((10, 0.15), 1),
             ((2000, 0.90), 0), ((10, 0.2), 0), ((9, 0.9), 1)]
    table(spark, cases, lambda g, r: S.churn_rule(g, r).cast("int"))


@pytest.mark.parametrize("days,points", [(29, 100), (30, 75), (59, 75), (60, 50), (89, 50), (90, 25)])
def test_player_score_recency(spark, days, points):
    got = value(spark, S.player_score(F.lit(50.0), num(20), num(600), ago(days), NOW))
    assert float(got) == pytest.approx(50 * 0.4 + 10 * 0.25 + points * 0.2 + 10 * 0.15)


def test_ratios_and_probabilities(spark):
    cases = [((0, 0), 0.0), ((1, 3), 33.33), ((2, 3), 66.67), ((3, 3), 100.0)]
    table(spark, cases, lambda w, g: S.win_ratio(w, g))
    cases = [((0, 0), 0.5), ((0, 5), 0.1), ((5, 5), 0.9), ((1, 3), 0.3333)]
    table(spark, cases, lambda w, g: S.win_probability_live(w, g))
    cases = [((1, 1, 4), 0.375), ((0, 0, 4), 0.1), ((4, 0, 4), 0.9)]
    table(spark, cases, lambda w, d, g: S.win_probability_bulk(w, d, g))


def test_tiers_and_advice(spark):
    cases = [((55.0,), "Expert"), ((54.99,), "Intermediate"), ((45.0,), "Intermediate"), ((44.99,), "Beginner")]
    table(spark, cases, lambda r: S.skill_tier(r))
    cases = [((0.71, 39.0), "churn_high_low_skill"), ((0.71, 40.0), "churn_high_try_new_modes"),
             ((0.7, 10.0), "churn_medium_set_goals"), ((0.4, 10.0), "churn_low_engaged")]
    table(spark, cases, lambda p, r: S.churn_advice(p, r))
    cases = [((3601.0,), "engagement_take_breaks"), ((3600.0,), "engagement_balanced"),
             ((1800.0,), "engagement_casual_quick_match")]
    table(spark, cases, lambda m: S.engagement_advice(m))
    cases = [(("novice", 71.0), "novice: tournament"), (("novice", 70.0), "novice: advanced_strategy"),
             (("novice", 50.0), "novice: keep_practicing")]
    table(spark, cases, lambda level, r: S.skill_advice(level, r))
    cases = [((0.71, "expert"), "win_strong_at_expert"), ((0.7, "expert"), "win_good_chance"),
             ((0.5, "expert"), "win_review_past_games")]
    table(spark, cases, lambda p, level: S.win_advice(p, level))


def test_forecast_text_and_errors(spark):
    assert value(spark, S.hours_minutes(F.lit(3725.9), "month")) == "62 hours 5 minutes per month"
    assert value(spark, S.abs_pct_error(num(90), num(120))) == 25.0
    assert value(spark, S.abs_pct_error(num(90), num(0))) is None


def test_winner_efficiency_is_null_for_a_draw(spark):
    cases = [((1, 1, 2, 40, 30), 8.0), ((2, 1, 2, 40, 30), 6.0)]
    table(spark, cases, lambda *c: S.winner_efficiency(*c))
    draw = S.winner_efficiency(num(None), num(1), num(2), num(40), num(30))
    assert value(spark, draw) is None


def test_match_minutes_cut_toward_zero(spark):
    start = F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")
    end = F.lit("2024-01-01 10:01:59").cast("timestamp_ntz")
    assert value(spark, S.match_minutes(start, end)) == 1
    assert value(spark, S.match_minutes(end, start)) == -1


def test_numbers(spark):
    assert value(spark, rounded(F.lit(1.005))) == 1.01
    assert value(spark, half_even(F.lit(2.125))) == 2.12
    assert value(spark, half_even(F.lit(2.135))) == 2.14
    assert value(spark, ratio(num(1), num(0))) is None
    assert value(spark, clamp(F.lit(None).cast("double"), 0.0, 100.0)) is None


@pytest.mark.parametrize(
    "born,today,age",
    [("2000-02-29", "2023-02-28", 22), ("2000-02-29", "2023-03-01", 23), ("2000-06-30", "2024-06-30", 24), ("2000-07-01", "2024-06-30", 23)],
)
def test_age(spark, born, today, age):
    assert value(spark, age_in_years(F.lit(born).cast("date"), today)) == age


def test_uuid_round_trip(spark):
    text = "0f8fad5b-d9cb-469f-a165-70867728950e"
    assert value(spark, bin_to_uuid(uuid_to_bin(F.lit(text)))) == text


def test_engagement_bulk(spark):
    got = value(spark, S.engagement_bulk(num(4), num(100), ago(10), NOW))
    assert got == 10.0
    assert value(spark, S.engagement_bulk(num(0), num(0), ago(10), NOW)) == 0.0
