"""The registry of named queries and the shared tables of their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from matchlight.domain import Domain
from matchlight.sources.testdata import SampleTables

AS_OF = "timestamp '2001-08-03 00:00:00'"

# The same domain in DuckDB SQL, written apart from the Spark code it checks.
DOMAIN_SQL = """
games as (
  select distinct cast(substring(o_orderpriority, 1, 1) as int) as game_id,
    case substring(o_orderpriority, 1, 1) when '1' then 'battleship' when '2' then 'chess'
      when '3' then 'go' when '4' then 'reversi' else 'tic tac toe' end as name,
    substring(o_orderpriority, 1, 1) in ('2', '5') as can_draw
  from orders),
players as (
  select c_custkey as player_id, c_name as username,
    concat('First', cast(c_custkey % 20 as varchar)) as firstname,
    concat('Last', cast(c_custkey % 31 as varchar)) as lastname,
    concat(lower(c_name), '@example.com') as email,
    date '1950-01-01' + cast((c_custkey * 37) % 18000 as int) as birthdate,
    case when c_custkey % 100 = 0 then 'Non-Binary'
      when c_custkey % 100 between 1 and 10 then 'Female' else 'Male' end as gender,
    n_name as country
  from customer join nation on c_nationkey = n_nationkey),
match_history as (
  select o_orderkey as match_id, game_id, o_custkey as player1_id, p2 as player2_id, winner_id,
    start_time, start_time + interval '1' minute * duration_minutes as end_time, duration_minutes,
    case when winner_id is null then 'draw' when winner_id = o_custkey then 'win'
      else 'loss' end as result
  from (
    select o_orderkey, o_custkey, p2, cast(substring(o_orderpriority, 1, 1) as int) as game_id,
      case when o_orderstatus = 'F' then o_custkey
        when o_orderstatus = 'O' or p2 % 5 = 0 then p2 end as winner_id,
      o_orderdate + interval '1' hour * cast(o_orderkey % 24 as int) as start_time,
      cast(5 + o_orderkey % 55 as int) as duration_minutes
    from (select *, case when o_orderkey % 29 = o_custkey then 29
            else o_orderkey % 29 end as p2 from orders) o) t),
match_moves as (
  select l_orderkey as match_id, case when seat = 1 then player1_id else player2_id end as player_id,
    moves_count
  from (select l_orderkey, 1 + l_linenumber % 2 as seat, cast(sum(l_quantity) as bigint) as moves_count
        from lineitem group by l_orderkey, 1 + l_linenumber % 2) l
  join match_history on match_id = l_orderkey),
seats as (
  select match_id, game_id, player1_id as player_id, 1 as seat, winner_id, start_time, end_time,
    duration_minutes from match_history
  union all
  select match_id, game_id, player2_id, 2, winner_id, start_time, end_time, duration_minutes
  from match_history where player2_id <> player1_id),
pgs as (
  select s.player_id, s.game_id, count(distinct s.match_id) as total_games_played,
    count(*) filter (s.winner_id = s.player_id) as total_wins,
    count(*) filter (s.winner_id <> s.player_id) as total_losses,
    count(*) filter (s.winner_id is null) as total_draws,
    cast(coalesce(sum(mm.moves), 0) as bigint) as total_moves,
    cast(sum(s.duration_minutes) as bigint) as total_time_played_minutes,
    min(s.start_time) as first_played, max(s.end_time) as last_played
  from seats s left join (select match_id, player_id, sum(moves_count) as moves from match_moves
                          group by all) mm using (match_id, player_id)
  group by s.player_id, s.game_id),
aged as (
  select player_id, username, firstname || ' ' || lastname as player_name, gender, country,
    cast(2001 - year(birthdate)
      - case when strftime(birthdate, '%m%d') > '0803' then 1 else 0 end as integer) as age
  from players),
scored as (
  select *,
    case when total_games_played = 0 then 0.0 else cast(round(cast(total_wins * 100.0
      / total_games_played as decimal(28,6)), 2) as double) end as win_ratio,
    last_played is null or date_diff('day', last_played, timestamp '2001-08-03') > 30 as is_churned,
    cast(round(cast(greatest(0.0::double, least(100.0::double, total_games_played * 40.0 / 100
      + case when date_diff('day', last_played, timestamp '2001-08-03') < 7 then 40
          when date_diff('day', last_played, timestamp '2001-08-03') < 14 then 30
          when date_diff('day', last_played, timestamp '2001-08-03') < 30 then 20 else 0 end
      + total_time_played_minutes * 20.0 / 1000)) as decimal(28,6)), 2) as double)
      as engagement_level,
    case when total_games_played < 10 then 'novice'
      when total_wins * 100.0 / total_games_played > 65 and total_games_played >= 50 then 'expert'
      else 'intermediate' end as player_level,
    cast(round(cast(greatest(0.1::double, least(0.9::double,
      coalesce(total_wins * 1.0 / nullif(total_games_played, 0), 0.5))) as decimal(28,6)), 4)
      as double) as win_probability,
    case when total_games_played < 5 then 1 else cast(greatest(1, least(5, floor((
        cast(total_wins * 100.0 / total_games_played as decimal(28,6)) * 4
        + least(total_games_played, 100) * 3
        + case when total_time_played_minutes >= 1000 then 100
            else cast(total_time_played_minutes / 10.0 as decimal(28,6)) end * 3) / 200))) as integer)
      end as rating
  from pgs),
star as (
  select s.*, a.username, a.player_name, a.age, a.gender, a.country, g.name as game_name
  from scored s join aged a using (player_id) join games g using (game_id))
"""


@dataclass(frozen=True)
class Query:
    key: str
    run: Callable[[Domain], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(key: str, sql: str | None = None):
    """Register a query under a key with its check SQL, if one exists.

    The SQL may start with its own ``with``; the domain tables come before it.
    """

    def register(run):
        if key in REGISTRY:
            raise ValueError(f"query {key} is registered twice")
        REGISTRY[key] = Query(key, run, full_sql(sql) if sql else None)
        return run

    return register


def full_sql(sql: str) -> str:
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {DOMAIN_SQL.strip()},\n{body[5:]}"
    return f"with {DOMAIN_SQL.strip()}\n{body}"


def r(expression: str, digits: int = 2) -> str:
    """SQL text that rounds on exact decimals and returns a double."""
    return f"cast(round(cast({expression} as decimal(28,6)), {digits}) as double)"


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(entry: Query):
        return lambda spark, sf_dir: entry.run(SampleTables(spark, sf_dir))

    return {key: bind(entry) for key, entry in REGISTRY.items()}


def oracles() -> dict[str, str]:
    return {key: entry.sql for key, entry in REGISTRY.items() if entry.sql}
