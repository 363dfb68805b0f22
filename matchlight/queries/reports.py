"""Report queries with their check SQL."""

from matchlight.plans import reports as R
from matchlight.queries.base import AS_OF, query, r

PLAYER = (
    "player_id, game_id, player_name, game_name, total_games_played, total_wins, total_losses, "
    "total_moves, total_time_played_minutes, win_ratio, age, gender, country"
)
SCORE = """cast(win_ratio * 0.40::double + least(100.0::double, total_games_played / 2.0::double) * 0.25::double
  + case when date_diff('day', last_played, timestamp '2001-08-03') < 30 then 100
      when date_diff('day', last_played, timestamp '2001-08-03') < 60 then 75
      when date_diff('day', last_played, timestamp '2001-08-03') < 90 then 50 else 25 end * 0.20::double
  + least(100.0::double, total_time_played_minutes / 60.0::double) * 0.15::double as decimal(28,6))"""


def mean(x: str, digits: int = 2) -> str:
    exact = f"cast(sum(cast({x} as decimal(28,6))) as double) / nullif(count({x}), 0)"
    return r(exact, digits)


@query("all_player_stats", f"select {PLAYER} from star")
def _(d):
    return R.all_player_stats(d)


@query("game_stats_search", f"select {PLAYER} from star where lower(game_name) like '%es%'")
def _(d):
    return R.game_stats_search(d, "ES")


@query("player_search", f"select {PLAYER} from star where lower(player_name) like '%first1%t2%'")
def _(d):
    return R.player_search(d, "First1%t2")


@query("player_stats_by_id", f"select {PLAYER}, rating, last_played from star where player_id = 7")
def _(d):
    return R.player_stats_by_id(d, 7)


@query("game_stats_by_id", f"select {PLAYER}, rating, last_played from star where game_id = 2")
def _(d):
    return R.game_stats_by_id(d, 2)


@query(
    "players_page",
    f"""select {PLAYER}, rating, last_played from star
    order by last_played desc, player_id, game_id limit 20 offset 20""",
)
def _(d):
    return R.players_page(d, skip=20, limit=20)


@query(
    "active_players",
    f"""select {PLAYER}, last_played from star
    where date_diff('day', last_played, {AS_OF}) <= 90""",
)
def _(d):
    return R.active_players(d)


@query("recent_matches", "select * from match_history order by start_time desc, match_id limit 5")
def _(d):
    return R.recent_matches(d)


@query(
    "recent_players",
    "select player_id, username, country from players order by player_id desc limit 3",
)
def _(d):
    return R.recent_players(d)


@query(
    "top_players_by_game",
    f"""select {PLAYER} from star where game_name = 'chess'
    order by total_games_played desc, win_ratio desc, player_id, game_id limit 3""",
)
def _(d):
    return R.top_players_by_game(d, "chess")


@query(
    "top_rated_by_game",
    """select player_id, player_name, country, total_games_played, total_wins, total_losses,
      win_ratio, rating, last_played from star where game_id = 3
    order by rating desc, win_ratio desc, player_id limit 3""",
)
def _(d):
    return R.top_rated_by_game(d, 3)


@query(
    "top_players_min_games",
    f"""select player_id, player_name, country, total_games_played, total_wins, total_losses,
      {r("total_wins * 100.0 / total_games_played")} as win_rate, total_moves,
      total_time_played_minutes
    from star where game_name = 'battleship' and total_games_played >= 20
    order by win_rate desc, total_games_played desc, player_id limit 10""",
)
def _(d):
    return R.top_players_min_games(d)


@query(
    "top3_per_game",
    f"""with ranked as (
      select *, {SCORE} as score,
        row_number() over (partition by game_id order by {SCORE} desc, player_id) as player_rank
      from star where total_games_played >= 10
        and date_diff('day', last_played, {AS_OF}) <= 90)
    select player_name, game_name, total_games_played, total_wins, total_losses, win_ratio,
      {r("score")} as player_score, player_rank
    from ranked where player_rank <= 3""",
)
def _(d):
    return R.top3_per_game(d)


@query("top3_nested")
def _(d):
    return R.top3_nested(d)


@query(
    "most_played_games",
    f"""select game_name, count(distinct player_id) as unique_players,
      cast(sum(total_games_played) as bigint) as total_matches,
      {mean("win_ratio", 4)} as average_win_ratio
    from star group by game_name order by total_matches desc, game_name limit 10""",
)
def _(d):
    return R.most_played_games(d)


@query(
    "most_played_games_rated",
    f"""select game_id, game_name, count(distinct player_id) as unique_players,
      cast(sum(total_games_played) as bigint) as total_matches,
      {mean("rating", 4)} as average_rating, max(last_played) as last_played
    from star group by game_id, game_name order by total_matches desc, game_id limit 10""",
)
def _(d):
    return R.most_played_games_rated(d)


@query(
    "top_games_by_players",
    f"""select game_name, count(distinct player_id) as player_count, {mean("rating", 4)} as avg_rating
    from star group by game_name order by player_count desc, game_name limit 5""",
)
def _(d):
    return R.top_games_by_players(d)


@query(
    "platform_summary",
    f"""select count(distinct player_id) as total_players, count(distinct game_id) as total_games,
      cast(sum(total_games_played) as bigint) as total_matches_played,
      {mean("win_ratio", 4)} as average_win_ratio, {mean("rating", 4)} as average_rating,
      max(last_played) as last_activity from scored""",
)
def _(d):
    return R.platform_summary(d)


@query(
    "popular_games",
    f"""select g.name as game_name, count(distinct m.match_id) as total_matches,
      count(distinct case when m.player1_id = p.player_id then p.player_id
        when m.player2_id = p.player_id then p.player_id end) as unique_players,
      {r("avg(m.duration_minutes)")} as avg_duration_minutes,
      {r("count(distinct m.match_id) * 100.0 / (select count(*) from match_history)")}
        as match_percentage
    from games g left join match_history m on g.game_id = m.game_id
    left join players p on p.player_id = m.player1_id or p.player_id = m.player2_id
    group by g.name""",
)
def _(d):
    return R.popular_games(d)


@query(
    "country_activity",
    f"""with played as (
      select p.country, p.player_id, m.match_id, m.duration_minutes, g.name as game_name
      from players p
      left join match_history m on p.player_id = m.player1_id or p.player_id = m.player2_id
      left join games g on g.game_id = m.game_id)
    select country, count(distinct player_id) as total_players,
      count(distinct match_id) as total_matches,
      {r("count(distinct match_id) * 1.0 / count(distinct player_id)")} as avg_matches_per_player,
      count(distinct game_name) as unique_games_played,
      {r("sum(duration_minutes) / 60.0")} as total_hours_played,
      {r('''sum(case when game_name = 'battleship' then 1 else 0 end) * 100.0
        / nullif(count(distinct match_id), 0)''')} as battleship_percentage,
      {r('''count(distinct case when game_name = 'battleship' then match_id end) * 100.0
        / nullif(count(distinct match_id), 0)''')} as battleship_match_percentage
    from played group by country""",
)
def _(d):
    return R.country_activity(d)


@query(
    "country_pairings",
    f"""select p1.country as player1_country, p2.country as player2_country,
      count(*) as match_count, {r("avg(m.duration_minutes)")} as avg_duration,
      count(distinct m.game_id) as unique_games
    from match_history m join players p1 on m.player1_id = p1.player_id
    join players p2 on m.player2_id = p2.player_id
    group by p1.country, p2.country having count(*) > 20""",
)
def _(d):
    return R.country_pairings(d, min_matches=20)


@query(
    "game_engagement_summary",
    f"""select game_name, count(distinct player_id) as active_players,
      {mean("total_time_played_minutes / 60.0")} as avg_hours_per_player,
      {mean("total_games_played")} as avg_games_per_player,
      min(total_games_played) as min_games, max(total_games_played) as max_games
    from star group by game_name""",
)
def _(d):
    return R.game_engagement_summary(d)


@query(
    "game_complexity",
    f"""with wide as (
      select m.*, g.name as game_name, a.n as m1, b.n as m2
      from match_history m join games g using (game_id)
      left join (select match_id, player_id, sum(moves_count) n from match_moves group by all) a
        on a.match_id = m.match_id and a.player_id = m.player1_id
      left join (select match_id, player_id, sum(moves_count) n from match_moves group by all) b
        on b.match_id = m.match_id and b.player_id = m.player2_id)
    select game_name, {mean("(m1 + m2)")} as avg_total_moves,
      {mean("duration_minutes")} as avg_duration,
      {mean("((m1 + m2) / nullif(duration_minutes, 0)::double)")} as moves_per_minute,
      count(*) as total_matches
    from wide group by game_name""",
)
def _(d):
    return R.game_complexity(d)


@query(
    "match_counts_by_game",
    """select name as game_name, count(*) as total_matches
    from match_history join games using (game_id) group by name""",
)
def _(d):
    return R.match_counts_by_game(d)


@query(
    "match_share_by_game",
    f"""select name as game_name, count(*) as total_matches,
      {r("count(*) * 100.0 / (select count(*) from match_history)")} as percentage
    from match_history join games using (game_id) group by name""",
)
def _(d):
    return R.match_share_by_game(d)


@query(
    "stats_rows_per_game",
    """select g.game_id, g.name, count(*) as rows, count(s.player_id) as stats
    from games g left join pgs s on g.game_id = s.game_id group by g.game_id, g.name""",
)
def _(d):
    return R.stats_rows_per_game(d)


@query(
    "skill_tiers",
    f"""with per_player as (
      select p.player_id, p.gender, p.country, count(distinct m.game_id) as games_played,
        count(*) as matches,
        {r("sum(case when m.winner_id = p.player_id then 1 else 0 end) * 100.0 / count(*)")} as win_rate
      from players p join match_history m on p.player_id = m.player1_id or p.player_id = m.player2_id
      group by p.player_id, p.gender, p.country)
    select case when win_rate >= 55 then 'Expert' when win_rate >= 45 then 'Intermediate'
        else 'Beginner' end as skill_level,
      count(*) as player_count, {mean("win_rate")} as avg_win_rate,
      {mean("matches")} as avg_matches_played, {mean("games_played")} as avg_different_games
    from per_player group by 1""",
)
def _(d):
    return R.skill_tiers(d)


@query(
    "multi_game_players",
    f"""with counts as (
      select p.player_id, count(distinct s.game_id) as games_played
      from players p join pgs s on p.player_id = s.player_id group by p.player_id)
    select games_played as number_of_games, count(*) as player_count,
      {r("count(*) * 100.0 / (select count(*) from players)")} as percentage_of_players
    from counts group by games_played""",
)
def _(d):
    return R.multi_game_players(d)


@query(
    "player_game_list",
    """select player_id, count(distinct game_name) as games_played,
      string_agg(distinct game_name, ',' order by game_name) as game_list
    from star group by player_id""",
)
def _(d):
    return R.player_game_list(d)


@query(
    "seat_balance",
    """select g.name as game_name, p.player_id, p.username, count(s.match_id) as total_matches,
      count(case when s.seat = 1 then 1 end) as games_as_player1,
      count(case when s.seat = 2 then 1 end) as games_as_player2
    from players p cross join games g
    left join seats s on s.player_id = p.player_id and s.game_id = g.game_id
    group by g.name, p.player_id, p.username""",
)
def _(d):
    return R.seat_balance(d)
