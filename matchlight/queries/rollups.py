"""Roll-ups, formulas, change handling and sinks, with their check SQL."""

from pyspark.sql import functions as F

from matchlight.domain import people
from matchlight.functions import scoring as S
from matchlight.functions.identifiers import bin_to_uuid, stable_uuid, uuid_to_bin
from matchlight.functions.numbers import (
    fractional_days_since,
    ratio,
    rounded,
)
from matchlight.operators import changes, participants, rollup
from matchlight.sources.generate import uniform
from matchlight.queries.base import AS_OF, query, r
from matchlight.schemas import RATINGS
from matchlight.session import scratch_path, stored
from matchlight.sources import exports
from matchlight.sources.buckets import BucketTable
from matchlight.sources.tables import (
    append,
    append_ratings,
    read_stats_csv,
    read_table,
    replace,
)

COUNTS = (
    "player_id, game_id, total_games_played, total_wins, total_losses, total_draws, total_moves, "
    "total_time_played_minutes, first_played, last_played"
)
# The roll-up as one join on "seat 1 or seat 2": a check that does not use the unpivot.
OR_JOIN = """
  select p.player_id, m.game_id, count(distinct m.match_id) as total_games_played,
    cast(sum(case when m.winner_id = p.player_id then 1 else 0 end) as bigint) as total_wins,
    cast(sum(case when m.winner_id <> p.player_id then 1 else 0 end) as bigint) as total_losses,
    cast(sum(case when m.winner_id is null then 1 else 0 end) as bigint) as total_draws,
    cast(coalesce(sum(mm.moves), 0) as bigint) as total_moves,
    cast(sum(m.duration_minutes) as bigint) as total_time_played_minutes,
    min(m.start_time) as first_played, max(m.end_time) as last_played
  from players p join match_history m on m.player1_id = p.player_id or m.player2_id = p.player_id
  left join (select match_id, player_id, sum(moves_count) as moves from match_moves group by all) mm
    on mm.match_id = m.match_id and mm.player_id = p.player_id
  {where}
  group by p.player_id, m.game_id"""


@query("games_dim", "select game_id, name, can_draw from games")
def _(d):
    return d.games


@query(
    "participants",
    """select m.match_id, p.player_id, m.game_id,
      case when m.player1_id = p.player_id then 1 else 2 end as seat, m.winner_id, m.start_time,
      m.end_time, m.duration_minutes, m.result
    from match_history m join players p
      on m.player1_id = p.player_id or m.player2_id = p.player_id""",
)
def _(d):
    return d.participants


@query("match_moves_unpivot", "select match_id, player_id, moves_count from match_moves")
def _(d):
    wide = participants.matches_wide(d.matches, d.moves, d.per_game(d.games))
    return exports.moves_from_wide(wide)


@query("player_game_stats_bulk", OR_JOIN.format(where=""))
def _(d):
    path = scratch_path(d.spark, "stats")
    replace(d.stats, path)
    return read_table(d.spark, path)


@query(
    "player_game_stats_wide",
    """with wide as (
      select m.*, a.n as m1, b.n as m2 from match_history m
      left join (select match_id, player_id, sum(moves_count) n from match_moves group by all) a
        on a.match_id = m.match_id and a.player_id = m.player1_id
      left join (select match_id, player_id, sum(moves_count) n from match_moves group by all) b
        on b.match_id = m.match_id and b.player_id = m.player2_id)
    select p.player_id, m.game_id, count(distinct m.match_id) as total_games_played,
      cast(sum(case when m.winner_id = p.player_id then 1 else 0 end) as bigint) as total_wins,
      cast(sum(case when m.winner_id <> p.player_id then 1 else 0 end) as bigint) as total_losses,
      cast(sum(case when m.player1_id = p.player_id then m1 else m2 end) as bigint) as total_moves,
      cast(sum(m.duration_minutes) as bigint) as total_time_played_minutes,
      max(m.end_time) as last_played
    from players p join wide m on m.player1_id = p.player_id or m.player2_id = p.player_id
    group by p.player_id, m.game_id""",
)
def _(d):
    return rollup.stats_from_wide(d.wide)


@query(
    "player_game_stats_filter",
    f"""select player_id, game_id, count(*) as games,
      count(*) filter (where winner_id = player_id) as wins,
      count(*) filter (where winner_id is not null and winner_id <> player_id) as losses,
      {r("count(*) filter (where winner_id = player_id) / nullif(count(*), 0)::double", 4)} as win_share
    from seats group by player_id, game_id""",
)
def _(d):
    return rollup.outcome_shares(d.participants)


@query(
    "training_extract",
    """select player_id, game_name, total_time_played_minutes, total_games_played, total_wins,
      total_moves, age from star where total_games_played > 0 and total_time_played_minutes > 0""",
)
def _(d):
    return exports.training_extract(d)


EXPORT = """with best as (
      select user_id as player_id,
        1 + cast(json_extract_string(props, '$.k') as int) % 5 as game_id, max(value) as highest_score
      from events group by all)
    select s.player_id, s.game_id, username, age, gender, country, game_name, total_games_played,
      total_wins, total_losses, win_ratio, total_moves, total_time_played_minutes, highest_score,
      rating, case when is_churned then 'YES' else 'NO' end as churned, is_churned, player_level,
      win_probability, last_played
    from star s left join best b on b.player_id = s.player_id and b.game_id = s.game_id"""


@query("feature_export", EXPORT)
def _(d):
    return exports.feature_export(d)


@query("scan_stats_csv", EXPORT)
def _(d):
    path = scratch_path(d.spark, "features-csv")
    exports.write_csv(exports.feature_export(d), path)
    return read_stats_csv(d.spark, path)


@query("complete_rows", f"select * from ({EXPORT}) t where highest_score is not null")
def _(d):
    return exports.feature_export(d).na.drop()


@query(
    "extreme_players",
    """select 'longest' as kind, player_id, game_id, total_time_played_minutes from (select * from pgs
      order by total_time_played_minutes desc, player_id, game_id limit 1) a
    union all
    select 'shortest', player_id, game_id, total_time_played_minutes from (select * from pgs
      order by total_time_played_minutes, player_id, game_id limit 1) b""",
)
def _(d):
    return exports.extremes(d.stats, "total_time_played_minutes")


# --- sinks and change handling ----------------------------------------------------------------


@query("stats_upsert", f"select {COUNTS} from pgs")
def _(d):
    late = F.col("match_id") % 10 == 0
    table = BucketTable(d.spark, scratch_path(d.spark, "stats-buckets"), ["player_id", "game_id"], ["player_id"], buckets=8)
    table.create(rollup.player_game_stats(d.matches.filter(~late), d.moves), 0)
    keys = rollup.affected_keys(d.matches.filter(late))
    table.upsert(stored(rollup.refresh_keys(keys, d.matches, d.moves), "fresh-stats"), 1)
    return table.read()


@query(
    "refresh_affected",
    f"""select {COUNTS} from pgs semi join
      (select player_id, game_id from seats where match_id % 10 = 3) k using (player_id, game_id)""",
)
def _(d):
    keys = rollup.affected_keys(d.matches.filter(F.col("match_id") % 10 == 3))
    return rollup.refresh_keys(keys, d.matches, d.moves)


@query(
    "rating_history_append",
    """with early as (
      select player_id, game_id, count(*) g, count(*) filter (winner_id = player_id) w,
        cast(sum(duration_minutes) as bigint) t from seats where match_id % 10 <> 0 group by all),
    late as (select distinct player_id, game_id from seats where match_id % 10 = 0),
    both_batches as (
      select player_id, game_id, g, w, t, 1 as batch_id from early
      union all
      select player_id, game_id, total_games_played, total_wins, total_time_played_minutes, 2
      from pgs semi join late using (player_id, game_id))
    select player_id, game_id,
      case when g < 5 then 1 else cast(greatest(1, least(5, floor((
        cast(w * 100.0 / g as decimal(28,6)) * 4 + least(g, 100) * 3
        + case when t >= 1000 then 100 else cast(t / 10.0 as decimal(28,6)) end * 3) / 200)))
        as integer) end as rating,
      date '2001-08-03' as rating_date, cast(batch_id as bigint) as batch_id
    from both_batches""",
)
def _(d):
    late = F.col("match_id") % 10 == 0
    path = scratch_path(d.spark, "ratings")
    first = rollup.player_game_stats(d.matches.filter(~late), d.moves)
    append_ratings(changes.rating_history(rollup.with_scores(first, d.as_of), d.as_of, 1), path)
    keys = rollup.affected_keys(d.matches.filter(late))
    second = rollup.with_scores(rollup.refresh_keys(keys, d.matches, d.moves), d.as_of)
    append_ratings(changes.rating_history(second, d.as_of, 2), path)
    return read_table(d.spark, path, RATINGS)


AFTER = """after_change as (
      select match_id, game_id, player1_id, player2_id,
        case when match_id % 77 = 0 then null when match_id % 50 = 0 then player1_id
          else winner_id end as winner_id, start_time, end_time, duration_minutes, result
      from match_history)"""


def changed_table(d):
    """The match table after some winners were corrected and some annulled."""
    winner = F.when(F.col("match_id") % 50 == 0, F.col("player1_id")).otherwise(F.col("winner_id"))
    return d.matches.withColumn("winner_id", F.when(F.col("match_id") % 77 != 0, winner))


@query(
    "cdc_update_keys",
    f"""with {AFTER},
    hit as (select a.* from after_change a join match_history b using (match_id)
      where a.winner_id is distinct from b.winner_id or a.result is distinct from b.result)
    select player1_id as player_id, game_id from hit union select player2_id, game_id from hit""",
)
def _(d):
    return rollup.affected_keys(changes.changed_matches(d.matches, changed_table(d)))


@query(
    "cdc_delete_keys",
    """with left_over as (select * from seats where match_id % 101 <> 0),
    hit as (select distinct player_id, game_id from seats where match_id % 101 = 0)
    select h.player_id, h.game_id, count(l.match_id) as total_games_played,
      count(l.match_id) filter (l.winner_id = l.player_id) as total_wins,
      count(l.match_id) filter (l.winner_id <> l.player_id) as total_losses,
      count(l.match_id) filter (l.winner_id is null) as total_draws,
      cast(coalesce(sum(mm.moves), 0) as bigint) as total_moves,
      cast(coalesce(sum(l.duration_minutes), 0) as bigint) as total_time_played_minutes,
      min(l.start_time) as first_played, max(l.end_time) as last_played
    from hit h left join left_over l using (player_id, game_id)
    left join (select match_id, player_id, sum(moves_count) as moves from match_moves group by all) mm
      on mm.match_id = l.match_id and mm.player_id = h.player_id
    group by h.player_id, h.game_id""",
)
def _(d):
    gone = F.col("match_id") % 101 == 0
    keys = rollup.affected_keys(d.matches.filter(gone))
    return rollup.refresh_keys(keys, d.matches.filter(~gone), d.moves)


@query(
    "new_players_only",
    """select player_id, username, country from players where player_id % 3 = 0""",
)
def _(d):
    existing = d.players.filter(F.col("player_id") % 3 != 0)
    signups = d.players.unionByName(d.players).select("player_id", "username", "country")
    return changes.insert_if_absent(existing, signups, ["player_id"])


@query(
    "propagate_game_name",
    """select match_id, game_id, case when game_id = 3 then 'weiqi' else name end as game_name
    from match_history join games using (game_id)""",
)
def _(d):
    facts = d.matches.select("match_id", "game_id").join(d.game_names, "game_id")
    renamed = d.games.filter("name = 'go'").select("game_id", F.lit("weiqi").alias("game_name"))
    return changes.propagate(facts, d.per_game(renamed), "game_id", ["game_name"]).select(
        "match_id", "game_id", "game_name"
    )


@query(
    "propagate_game_name_to_stats",
    """select player_id, game_id, case when game_id = 3 then 'weiqi' else game_name end as game_name,
      total_games_played, total_wins from star""",
)
def _(d):
    """A rename reaches the denormalised statistics, too."""
    facts = d.star.select("player_id", "game_id", "game_name", "total_games_played", "total_wins")
    renamed = d.games.filter("name = 'go'").select("game_id", F.lit("weiqi").alias("game_name"))
    return changes.propagate(facts, d.per_game(renamed), "game_id", ["game_name"])


@query(
    "propagate_player_dims",
    """select player_id, game_id,
      case when player_id % 7 = 0 then 'Renamed ' || player_name else player_name end as player_name,
      gender, case when player_id % 7 = 0 then 'ATLANTIS' else country end as country,
      case when player_id % 7 = 0 then age + 1 else age end as age from star""",
)
def _(d):
    facts = d.star.select("player_id", "game_id", "player_name", "gender", "country", "age")
    renamed = d.players.filter(F.col("player_id") % 7 == 0).withColumns(
        {
            "firstname": F.concat(F.lit("Renamed "), "firstname"),
            "country": F.lit("ATLANTIS"),
            "birthdate": F.add_months("birthdate", -12),
        }
    )
    changed = people(renamed, d.as_of)
    return changes.propagate(
        facts, changed, "player_id", ["player_name", "gender", "country", "age"]
    )


# --- predictions ------------------------------------------------------------------------------

LOG = """log as (
      select md5(player_id || '|' || game_id) as h, player_id, game_id,
        cast(floor(cast(avg(total_time_played_minutes) over (partition by game_id)
          as decimal(28,6))) as bigint) as engagement_duration
      from pgs),
    log_ids as (
      select substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-'
        || substring(h, 17, 4) || '-' || substring(h, 21, 12) as id, player_id, game_id,
        engagement_duration from log)"""


@query(
    "prediction_log",
    f"""with {LOG}
    select id, player_id, game_id, engagement_duration, {AS_OF} as prediction_timestamp,
      cast(null as bigint) as actual_duration, cast(null as double) as accuracy from log_ids""",
)
def _(d):
    path = scratch_path(d.spark, "prediction-log")
    append(exports.prediction_log(exports.mean_forecast(d), d.as_of), path)
    return read_table(d.spark, path, exports.PREDICTION_LOG)


@query(
    "predictions_of_player",
    f"""with {LOG}
    select id, player_id, game_id, engagement_duration, {AS_OF} as prediction_timestamp,
      cast(null as bigint) as actual_duration, cast(null as double) as accuracy from log_ids where player_id = 7""",
)
def _(d):
    """The log read back for one player; the player's id reaches the scan."""
    path = scratch_path(d.spark, "prediction-log")
    append(exports.prediction_log(exports.mean_forecast(d), d.as_of), path)
    return exports.predictions_of(read_table(d.spark, path, exports.PREDICTION_LOG), 7)


@query(
    "prediction_error",
    f"""with {LOG}
    select id, player_id, game_id, engagement_duration,
      total_time_played_minutes as actual_duration,
      {r('''abs(engagement_duration - total_time_played_minutes) * 100.0
        / nullif(total_time_played_minutes, 0)''')} as abs_pct_error
    from log_ids join pgs using (player_id, game_id)""",
)
def _(d):
    log = exports.prediction_log(exports.mean_forecast(d), d.as_of)
    actual = d.stats.select(
        "player_id", "game_id", F.col("total_time_played_minutes").alias("actual_duration")
    )
    return exports.with_actuals(log, actual)


# --- formulas ---------------------------------------------------------------------------------


def formula(key: str, sql: str, column, base: str = "stats", sql_base: str = "pgs"):
    """Register one formula over the stats: (player, game, value)."""

    @query(key, f"select player_id, game_id, {sql} as value from {sql_base}")
    def _(d):
        return getattr(d, base).select("player_id", "game_id", column(d).alias("value"))


g, w, t, last = "total_games_played", "total_wins", "total_time_played_minutes", "last_played"


def c(name):
    return F.col(name)


formula("win_ratio", "win_ratio", lambda d: S.win_ratio(c(w), c(g)), sql_base="scored")
formula(
    "churn_inactive",
    f"date_diff('day', last_played, {AS_OF}) > 30",
    lambda d: S.churn_inactive(c(last), d.as_of),
)
formula(
    "churn_rule_label",
    "cast(total_games_played < 10 or total_wins / nullif(total_games_played, 0)::double < 0.2 as int)",
    lambda d: S.churn_rule(c(g), ratio(c(w), c(g))).cast("int"),
)
formula(
    "engagement_live",
    "engagement_level",
    lambda d: S.engagement_live(c(g), c(t), c(last), d.as_of),
    sql_base="scored",
)
formula(
    "engagement_bulk",
    r(
        f"""greatest(0.0::double, least(100.0::double, coalesce(
          total_time_played_minutes / nullif(total_games_played, 0)::double * (total_games_played
          / greatest(1, date_diff('day', first_played, {AS_OF}))::double), 0)))"""
    ),
    lambda d: S.engagement_bulk(c(g), c(t), c("first_played"), d.as_of),
)
formula("player_level", "player_level", lambda d: S.player_level(c(g), c(w)), sql_base="scored")
formula(
    "win_probability_live",
    "win_probability",
    lambda d: S.win_probability_live(c(w), c(g)),
    sql_base="scored",
)
formula(
    "win_probability_bulk",
    r(
        """greatest(0.1::double, least(0.9::double,
          (total_wins + 0.5::double * total_draws) / total_games_played::double))""",
        4,
    ),
    lambda d: S.win_probability_bulk(c(w), c("total_draws"), c(g)),
)
formula("rating_live", "rating", lambda d: S.rating_live(c(g), c(w), c(t)), sql_base="scored")
formula(
    "rating_older",
    """case when total_games_played < 5 then 1 else cast(greatest(1, least(5, floor((
      cast(total_wins * 100.0 / total_games_played as decimal(28,6)) * 5
      + case when total_games_played >= 50 then 100 else total_games_played * 2 end * 3
      + case when total_time_played_minutes >= 1000 then 100
          else cast(total_time_played_minutes / 10.0 as decimal(28,6)) end * 2) / 200))) as integer)
    end""",
    lambda d: S.rating_older(c(g), c(w), c(t)),
)
formula(
    "player_score",
    f"""{r('''win_ratio * 0.40::double + least(100.0::double, total_games_played / 2.0::double) * 0.25::double
      + case when date_diff('day', last_played, timestamp '2001-08-03') < 30 then 100
          when date_diff('day', last_played, timestamp '2001-08-03') < 60 then 75
          when date_diff('day', last_played, timestamp '2001-08-03') < 90 then 50
          else 25 end * 0.20::double
      + least(100.0::double, total_time_played_minutes / 60.0::double) * 0.15::double''', 4)}""",
    lambda d: rounded(S.player_score(c("win_ratio"), c(g), c(t), c(last), d.as_of), 4),
    base="scored",
    sql_base="scored",
)
formula(
    "future_engagement",
    r(
        """total_time_played_minutes * (1.0::double + total_wins / total_games_played::double)
        * (total_games_played / nullif(age, 0)::double)"""
    ),
    lambda d: rounded(S.future_engagement(c(g), c(w), c(t), c("age"))),
    base="star",
    sql_base="star",
)


def bulk_ratings(d):
    """The random part is a hash of the keys, so a task done twice gives the same rows."""
    draw = uniform(42, "rating", "player_id", "game_id")
    return d.stats.select(
        "player_id", "game_id", S.rating_bulk(c(g), c(w), c(t), draw).alias("rating")
    )


query("rating_bulk")(bulk_ratings)


@query(
    "per_game_features",
    f"""select player_id, game_id,
      {r("total_time_played_minutes / nullif(total_games_played, 0)::double", 4)} as avg_session_duration,
      {r("total_wins / nullif(total_games_played, 0)::double", 4)} as historical_win_rate,
      {r("total_moves / nullif(total_games_played, 0)::double", 4)} as avg_moves_per_game,
      {r("ln(1 + total_games_played)", 6)} as games_experience
    from pgs""",
)
def _(d):
    return d.stats.select(
        "player_id",
        "game_id",
        rounded(ratio(c(t), c(g)), 4).alias("avg_session_duration"),
        rounded(ratio(c(w), c(g)), 4).alias("historical_win_rate"),
        rounded(ratio(c("total_moves"), c(g)), 4).alias("avg_moves_per_game"),
        rounded(F.log1p(g), 6).alias("games_experience"),
    )


DAYS = f"(epoch({AS_OF}) - epoch(last_played)) / 86400.0::double"


@query(
    "activity_rates",
    f"""select player_id, game_id, {r(DAYS, 4)} as days_since_last_play,
      {r(f"total_games_played / nullif({DAYS} + 1, 0)", 4)} as games_per_day,
      {r(f"total_time_played_minutes / nullif({DAYS} + 1, 0)", 4)} as time_per_day
    from pgs""",
)
def _(d):
    days = fractional_days_since(c(last), d.as_of)
    return d.stats.select(
        "player_id",
        "game_id",
        rounded(days, 4).alias("days_since_last_play"),
        rounded(ratio(c(g), days + 1), 4).alias("games_per_day"),
        rounded(ratio(c(t), days + 1), 4).alias("time_per_day"),
    )


@query(
    "winner_efficiency",
    f"""with counts as (select match_id, player_id, sum(moves_count) n from match_moves group by all)
    select m.match_id, m.winner_id, {r("c.n / 5.0")} as moves_per_ship
    from match_history m left join counts c
      on c.match_id = m.match_id and c.player_id = m.winner_id""",
)
def _(d):
    return d.wide.select(
        "match_id",
        "winner_id",
        S.winner_efficiency(
            c("winner_id"), c("player1_id"), c("player2_id"), c("player1_moves"), c("player2_moves")
        ).alias("moves_per_ship"),
    )


@query(
    "match_duration",
    """select match_id, cast(trunc(date_diff('second', start_time,
      end_time + to_seconds(cast(match_id % 120 as int))) / 60.0) as int) as minutes
    from match_history""",
)
def _(d):
    later = c("end_time") + F.make_dt_interval(secs=(c("match_id") % 120).cast("int"))
    return d.matches.select("match_id", S.match_minutes(c("start_time"), later).alias("minutes"))


@query(
    "engagement_forecast",
    f"""select player_id, game_id,
      cast(total_time_played_minutes // 60 as varchar) || ' hours '
        || cast(total_time_played_minutes % 60 as varchar) || ' minutes per month' as monthly_forecast,
      cast(total_time_played_minutes // 1800 as varchar) || ' hours '
        || cast((total_time_played_minutes % 1800) // 30 as varchar) || ' minutes per day'
        as daily_average,
      {r("total_time_played_minutes")} as raw_minutes
    from pgs""",
)
def _(d):
    minutes = c(t).cast("double")
    return d.stats.select(
        "player_id",
        "game_id",
        S.hours_minutes(minutes, "month").alias("monthly_forecast"),
        S.hours_minutes(minutes / 30.0, "day").alias("daily_average"),
        rounded(minutes).alias("raw_minutes"),
    )


formula(
    "churn_advice",
    """case when 1 - engagement_level / 100 > 0.7::double then case when win_ratio < 40
        then 'churn_high_low_skill' else 'churn_high_try_new_modes' end
      when 1 - engagement_level / 100 > 0.4::double then 'churn_medium_set_goals'
      else 'churn_low_engaged' end""",
    lambda d: S.churn_advice(F.lit(1.0) - c("engagement_level") / 100.0, c("win_ratio")),
    base="scored",
    sql_base="scored",
)
formula(
    "skill_advice",
    """player_level || ': ' || case when win_ratio > 70 then 'tournament' when win_ratio > 50
      then 'advanced_strategy' else 'keep_practicing' end""",
    lambda d: S.skill_advice(c("player_level"), c("win_ratio")),
    base="scored",
    sql_base="scored",
)
formula(
    "engagement_advice",
    """case when total_time_played_minutes / 30.0 > 120 then 'engagement_take_breaks'
      when total_time_played_minutes / 30.0 > 60 then 'engagement_balanced'
      else 'engagement_casual_quick_match' end""",
    lambda d: S.engagement_advice(c(t)),
)
formula(
    "win_advice",
    """case when win_probability > 0.7::double then 'win_strong_at_' || player_level
      when win_probability > 0.5::double then 'win_good_chance' else 'win_review_past_games' end""",
    lambda d: S.win_advice(c("win_probability"), c("player_level")),
    base="scored",
    sql_base="scored",
)


@query(
    "scalar_functions",
    f"""select player_id, lower(md5(cast(player_id as varchar))) as hex_id,
      substring(md5(cast(player_id as varchar)), 1, 8) || '-'
        || substring(md5(cast(player_id as varchar)), 9, 4) || '-'
        || substring(md5(cast(player_id as varchar)), 13, 4) || '-'
        || substring(md5(cast(player_id as varchar)), 17, 4) || '-'
        || substring(md5(cast(player_id as varchar)), 21, 12) as uuid,
      lpad(cast(player_id % 1000 as varchar), 3, '0') as padded, right(username, 6) as tail,
      left(firstname, 1) as initial, split_part('a,b,c', ',', cast(1 + player_id % 3 as int)) as item,
      strftime(birthdate, '%y%m%d') as short_date,
      cast(birthdate + interval 1 year as date) as next_year,
      timestamp '2001-01-01 00:00:00' + to_minutes(cast(player_id as int)) as shifted,
      date_diff('day', birthdate, date '2001-08-03') as days_old,
      cast(abs(player_id - 700) as bigint) as distance
    from players""",
)
def _(d):
    pid = c("player_id")
    uuid = stable_uuid(pid)
    return d.players.select(
        "player_id",
        F.lower(F.hex(uuid_to_bin(uuid))).alias("hex_id"),
        bin_to_uuid(uuid_to_bin(uuid)).alias("uuid"),
        F.lpad((pid % 1000).cast("string"), 3, "0").alias("padded"),
        F.substring("username", -6, 6).alias("tail"),
        F.left("firstname", F.lit(1)).alias("initial"),
        F.element_at(F.split(F.lit("a,b,c"), ","), (pid % 3 + 1).cast("int")).alias("item"),
        F.date_format("birthdate", "yyMMdd").alias("short_date"),
        F.add_months("birthdate", 12).alias("next_year"),
        (
            F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(mins=pid.cast("int"))
        ).alias("shifted"),
        F.datediff(F.lit("2001-08-03").cast("date"), "birthdate").cast("bigint").alias("days_old"),
        F.abs(pid - 700).alias("distance"),
    )
