"""Synthetic data sized and keyed by the given player table."""

from pyspark.sql import functions as F

from matchlight.queries.base import query
from matchlight.queries.rollups import bulk_ratings
from matchlight.schemas import GENDERS
from matchlight.session import stored
from matchlight.sources import generate


@query("gen_players")
def _(d):
    return generate.players(d.players.select("player_id"), d.as_of)


def generated_matches(d, **options):
    ids = d.players.select("player_id")
    size = d.players.agg(F.count("*").alias("n"), F.min("player_id").alias("low")).first()
    return generate.matches(ids, size.n, "2023-01-01", "2024-08-03", lowest=size.low or 0, **options)


@query("gen_matches")
def _(d):
    return generated_matches(d, skip=("2024-03-30", "2024-04-01"))


@query("gen_matches_earlier")
def _(d):
    """The settings of the earlier platform, without the days around its clock change."""
    return generated_matches(d, skip=("2023-03-25", "2023-03-27"), settings=generate.EARLIER_SETTINGS)


@query(
    "generator_checks",
    """select 'players' as what, count(*) as rows, cast(0 as bigint) as wrong from players
    union all select 'matches', cast(1 as bigint), cast(0 as bigint)
    union all select 'earlier matches', cast(1 as bigint), cast(0 as bigint)
    union all select 'ratings', count(*), cast(0 as bigint) from pgs""",
)
def _(d):
    """What must hold for every draw: keys are unique, players exist, values are in their domain."""
    people = generate.players(d.players.select("player_id"), d.as_of)
    names = people.groupBy("username").count().where("count > 1").count()
    tables = [("players", people.count(), names + people.where(~F.col("gender").isin(*GENDERS)).count())]
    ids = d.players.select("player_id")
    for what, made in (
        ("matches", generated_matches(d, skip=("2024-03-30", "2024-04-01"))),
        ("earlier matches", generated_matches(d, skip=("2023-03-25", "2023-03-27"), settings=generate.EARLIER_SETTINGS)),
    ):
        made = stored(made, "generated")
        wrong = made.groupBy("match_id").count().where("count > 1").count()
        wrong += made.join(ids.withColumnRenamed("player_id", "player2_id"), "player2_id", "left_anti").count()
        day = F.col("start_time").cast("date")
        wrong += made.where((F.col("player1_id") == F.col("player2_id")) | day.between("2024-03-30", "2024-04-01")).count() if what == "matches" else 0
        tables.append((what, min(1, made.count()), wrong))
    ratings = bulk_ratings(d)
    tables.append(("ratings", ratings.count(), ratings.where(~F.col("rating").between(1, 5)).count()))
    return d.spark.createDataFrame(tables, "what string, rows bigint, wrong bigint")
