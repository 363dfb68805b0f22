"""Players over ranges of days, with check SQL."""

from pyspark.sql import functions as F

from matchlight.operators import activity as A
from matchlight.queries.base import query
from matchlight.session import scratch_path, stored

# The months and years with matches and the whole time, per game and over all games.
RANGES = """with dated as (
    select strftime(m, '%Y-%m') as month, strftime(m, '%Y') as year, x.* from
      (select start_time as m, game_id, player_id, seat, match_id, duration_minutes from seats) x),
  ranged as (
    select month as range_id, game_id, player_id, seat, duration_minutes from dated
    union all select year, game_id, player_id, seat, duration_minutes from dated
    union all select 'all', game_id, player_id, seat, duration_minutes from dated)"""


@query(
    "active_players_by_range",
    RANGES
    + """ select range_id, game_id, count(*) filter (seat = 1) as matches,
      cast(sum(duration_minutes) filter (seat = 1) as bigint) as minutes,
      count(distinct player_id) as players, true as within_2_percent
    from ranged group by grouping sets ((range_id, game_id), (range_id))""",
)
def _(d):
    """Estimates from the stored table of days, after a tenth of the matches came late, beside exact counts."""
    late = F.col("match_id") % 10 == 0
    table = A.activity_table(d.spark, scratch_path(d.spark, "activity"), buckets=8)
    table.create(A.daily_activity(d.matches.filter(~late)), 0)
    A.refresh_days(table, d.matches.filter(late).select(F.to_date("start_time").alias("day")), d.matches, 1)
    ranges = stored(A.calendar_ranges(d.matches), "ranges")
    exact = A.active_players_exact(d.matches, ranges).withColumnRenamed("players", "exact")
    merged = A.active_players(table.read(), ranges)
    same = (merged["range_id"] == exact["range_id"]) & merged["game_id"].eqNullSafe(exact["game_id"])
    return merged.join(exact, same).select(
        merged["range_id"],
        merged["game_id"],
        "matches",
        "minutes",
        F.col("exact").alias("players"),
        (F.abs(F.col("players") - F.col("exact")) <= 0.02 * F.col("exact")).alias("within_2_percent"),
    )
