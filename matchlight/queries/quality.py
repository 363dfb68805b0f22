"""Data-quality, cascade and reconciliation queries."""

from pyspark.sql import functions as F

from matchlight.operators import quality as Q
from matchlight.queries.base import query
from matchlight.streaming import events as E


def doubled(df, key):
    """A table with some rows present twice, so that a key check has something to find."""
    return df.unionByName(df.filter(F.col(key) % 37 == 0))


@query(
    "dq_duplicates",
    """with m2 as (select match_id from match_history union all
        select match_id from match_history where match_id % 37 = 0),
      p2 as (select * from players union all select * from players where player_id % 37 = 0)
    select 'match.id' as rule, cast(match_id as varchar) as key, count(*) as n
      from m2 group by match_id having count(*) > 1
    union all select 'player.username', username, count(*) from p2 group by 2 having count(*) > 1
    union all select 'player.email', email, count(*) from p2 group by 2 having count(*) > 1
    union all select 'stats.player_game', player_id || '|' || game_id, count(*) from pgs
      group by 2 having count(*) > 1
    union all select 'game.name', name, count(*) from games group by 2 having count(*) > 1""",
)
def _(d):
    players = doubled(d.players, "player_id")
    return Q.union_all(
        [
            Q.duplicates(doubled(d.matches, "match_id"), "match.id", ["match_id"]),
            Q.duplicates(players, "player.username", ["username"]),
            Q.duplicates(players, "player.email", ["email"]),
            Q.duplicates(d.stats, "stats.player_game", ["player_id", "game_id"]),
            Q.duplicates(d.games, "game.name", ["name"]),
        ]
    )


class Without:
    """The domain after some parent rows went missing without their children."""

    def __init__(self, d):
        self.matches, self.moves = d.matches.filter("match_id % 500 <> 1"), d.moves
        self.players = d.players.filter("player_id % 50 <> 3")
        self.games = d.games.filter("game_id <> 4")
        self.stats, self.scored = d.stats, d.scored


@query(
    "dq_orphans",
    """with m as (select * from match_history where match_id % 500 <> 1),
      p as (select * from players where player_id % 50 <> 3),
      g as (select * from games where game_id <> 4)
    select 'match.game' as rule, cast(game_id as varchar) as key, count(*) as n from m
      where game_id not in (select game_id from g) group by all
    union all select 'match.player1', cast(player1_id as varchar), count(*) from m
      where player1_id not in (select player_id from p) group by all
    union all select 'match.player2', cast(player2_id as varchar), count(*) from m
      where player2_id not in (select player_id from p) group by all
    union all select 'match.winner', cast(winner_id as varchar), count(*) from m
      where winner_id is not null and winner_id not in (select player_id from p) group by all
    union all select 'moves.match', cast(match_id as varchar), count(*) from match_moves
      where match_id not in (select match_id from m) group by all
    union all select 'moves.player', cast(player_id as varchar), count(*) from match_moves
      where player_id not in (select player_id from p) group by all
    union all select r.rule, cast(player_id as varchar), count(*)
      from pgs cross join (values ('stats.player'), ('ratings.player')) r(rule)
      where player_id not in (select player_id from p) group by all
    union all select r.rule, cast(game_id as varchar), count(*)
      from pgs cross join (values ('stats.game'), ('ratings.game')) r(rule)
      where game_id not in (select game_id from g) group by all""",
)
def _(d):
    return Q.foreign_keys(Without(d))


@query(
    "dq_domains",
    """select 'rating' as rule, count(*) as rows, count(*) filter (rating not between 1 and 5) as violations
      from scored
    union all select 'player_level', count(*),
      count(*) filter (player_level not in ('novice', 'intermediate', 'expert')) from scored
    union all select 'gender', count(*),
      count(*) filter (gender not in ('Male', 'Female', 'Non-Binary')) from players
    union all select 'result', count(*), count(*) filter (result not in ('win', 'loss', 'draw'))
      from (select case when match_id % 41 = 0 then 'abandoned' else result end as result
            from match_history) t""",
)
def _(d):
    result = F.when(F.col("match_id") % 41 == 0, "abandoned").otherwise(F.col("result"))
    return Q.domain_violations(d.scored, d.players, d.matches.withColumn("result", result))


@query(
    "dq_nulls",
    """select rows, unnest(['match_id', 'game_id', 'player1_id', 'winner_id', 'start_time']) as column_name,
      unnest([a, b, c, e, f]) as nulls
    from (select count(*) as rows, count(*) filter (match_id is null) a,
      count(*) filter (game_id is null) b, count(*) filter (player1_id is null) c,
      count(*) filter (winner_id is null) e, count(*) filter (start_time is null) f
      from match_history) t""",
)
def _(d):
    required = ["match_id", "game_id", "player1_id", "winner_id", "start_time"]
    return Q.null_counts(d.matches, required)


@query(
    "dq_required",
    """select 'players' as table_name, count(*) as rows, count(*) filter (player_id % 19 = 0) as nulls from players
    union all select 'games', count(*), count(*) filter (game_id = 3) from games
    union all select 'match_history', count(*), cast(0 as bigint) from match_history
    union all select 'match_moves', count(*), cast(0 as bigint) from match_moves""",
)
def _(d):
    """Rows that lack a required value, per table, with gaps made on purpose."""
    holed = {
        "players": d.players.withColumn("email", F.when(F.col("player_id") % 19 != 0, F.col("email"))),
        "games": d.games.withColumn("name", F.when(F.col("game_id") != 3, F.col("name"))),
        "match_history": d.matches,
        "match_moves": d.moves,
    }
    return Q.union_all([Q.incomplete(df, name) for name, df in holed.items()])


@query(
    "dq_request_rules",
    """with requests as (select player_id, game_id, total_games_played, total_moves, total_wins,
        total_losses, total_time_played_minutes, case when player_id % 11 = 0 then 250.0::double
          else win_ratio end as win_ratio, case when player_id % 13 = 0 then 130 else age end as age,
        game_name, case when player_id % 17 = 0 then null else gender end as gender, country from star),
    f as (select player_id, game_id, concat_ws(',',
        case when not coalesce(total_games_played > 0, false) then 'games_positive' end,
        case when not coalesce(total_moves > 0, false) then 'moves_positive' end,
        case when not coalesce(total_wins >= 0, false) then 'wins_not_negative' end,
        case when not coalesce(total_losses >= 0, false) then 'losses_not_negative' end,
        case when not coalesce(total_time_played_minutes > 0, false) then 'minutes_positive' end,
        case when not coalesce(win_ratio between 0 and 100, false) then 'win_ratio_percent' end,
        case when not coalesce(age > 0 and age < 120, false) then 'age_in_range' end,
        case when not coalesce(length(game_name) between 1 and 100, false) then 'game_name_length' end,
        case when gender is null then 'gender_given' end,
        case when country is null then 'country_given' end) as failed from requests)
    select * from f where failed <> ''""",
)
def _(d):
    pid = F.col("player_id")
    requests = d.star.withColumns(
        {
            "win_ratio": F.when(pid % 11 == 0, 250.0).otherwise(F.col("win_ratio")),
            "age": F.when(pid % 13 == 0, 130).otherwise(F.col("age")),
            "gender": F.when(pid % 17 != 0, F.col("gender")),
        }
    )
    return (
        Q.failed_rules(requests)
        .filter(F.size("failed") > 0)
        .select("player_id", "game_id", F.concat_ws(",", "failed").alias("failed"))
    )


@query(
    "cascade_delete_players",
    """with gone as (select player_id from players where player_id % 40 = 5),
      m as (select * from match_history where player1_id not in (select player_id from gone)
        and player2_id not in (select player_id from gone))
    select match_id, game_id, player1_id, player2_id,
      case when winner_id in (select player_id from gone) then null else winner_id end as winner_id,
      start_time, end_time, duration_minutes, result from m""",
)
def _(d):
    gone = d.players.filter(F.col("player_id") % 40 == 5)
    return Q.delete_players(d, gone)["match_history"]


@query(
    "cascade_delete_games",
    """select match_id, player_id, moves_count from match_moves join match_history using (match_id)
    where game_id <> 2""",
)
def _(d):
    return Q.delete_games(d, d.games.filter("game_id = 2"))["match_moves"]


@query(
    "cascade_counts",
    """with gone as (select player_id from players where player_id % 40 = 5),
      m as (select match_id from match_history where player1_id not in (select player_id from gone)
        and player2_id not in (select player_id from gone)),
      m2 as (select match_id from match_history where game_id <> 2)
    select 'player' as deleted, 'players' as remaining, count(*) as rows from players where player_id % 40 <> 5
    union all select 'player', 'match_history', count(*) from m
    union all select 'player', 'match_moves', count(*) from match_moves where match_id in (select match_id from m)
    union all select 'player', r.t, count(*) from pgs cross join (values ('player_game_stats'), ('player_ratings')) r(t)
      where player_id not in (select player_id from gone) group by all
    union all select 'game', 'games', count(*) from games where game_id <> 2
    union all select 'game', 'match_history', count(*) from m2
    union all select 'game', 'match_moves', count(*) from match_moves where match_id in (select match_id from m2)
    union all select 'game', r.t, count(*) from pgs cross join (values ('player_game_stats'), ('player_ratings')) r(t)
      where game_id <> 2 group by all""",
)
def _(d):
    """Rows that remain in every table after either delete."""
    after = {
        "player": Q.delete_players(d, d.players.filter(F.col("player_id") % 40 == 5)),
        "game": Q.delete_games(d, d.games.filter("game_id = 2")),
    }
    return Q.union_all(
        [
            df.agg(F.lit(kind).alias("deleted"), F.lit(name).alias("remaining"), F.count("*").alias("rows"))
            for kind, tables in after.items()
            for name, df in tables.items()
        ]
    )


@query(
    "reconcile_events",
    """select 'match_history' as target, count(*) as published,
      count(*) filter (match_id % 10 <> 0) as landed, count(*) filter (match_id % 10 = 0) as missing
      from match_history where match_id % 83 <> 0
    union all select 'players', count(*), count(*) filter (player_id % 20 <> 0),
      count(*) filter (player_id % 20 = 0) from players
    union all select 'player_game_stats', count(*),
      count(*) filter (player_id in (select player_id from pgs)),
      count(*) filter (player_id not in (select player_id from pgs)) from players""",
)
def _(d):
    matches = E.decode_match_events(d.match_messages).filter(~F.col("bad_json"))
    matches = matches.select(F.col("matchId").cast("bigint").alias("match_id"))
    signups = E.decode_signups(d.signup_messages)
    return Q.union_all(
        [
            Q.reconcile(matches, d.matches.filter("match_id % 10 <> 0"), "match_history", "match_id"),
            Q.reconcile(signups, d.players.filter("player_id % 20 <> 0"), "players", "player_id"),
            Q.reconcile(signups, d.stats, "player_game_stats", "player_id"),
        ]
    )
