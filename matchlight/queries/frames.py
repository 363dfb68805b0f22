"""Summary-frame queries with their check SQL."""

from matchlight.operators.features import category_vocab
from matchlight.plans import frames as P
from matchlight.queries.base import query, r
from matchlight.queries.reports import mean
from matchlight.sources.exports import feature_export


def even(expression: str) -> str:
    """SQL text that rounds half to even at two decimals on exact decimals."""
    x = f"(cast({expression} as decimal(28,6)) * 100)"
    return (
        f"cast((case when {x} - floor({x}) = 0.5 and cast(floor({x}) as bigint) % 2 = 0 "
        f"then floor({x}) else round({x}, 0) end) as double) / 100.0::double"
    )


def raw_mean(x: str) -> str:
    return f"cast(sum(cast({x} as decimal(28,6))) as double) / nullif(count({x}), 0)"


CHURN_RATE = even(raw_mean("(case when is_churned then 100.0 else 0.0 end)"))


@query(
    "game_popularity",
    f"""select game_name, count(*) as total_players,
      cast(sum(total_games_played) as bigint) as total_games_played,
      cast(sum(total_wins) as bigint) as total_wins,
      {even(raw_mean("rating"))} as average_rating, {CHURN_RATE} as churn_rate
    from star group by game_name""",
)
def _(d):
    return P.game_popularity(d)


@query(
    "country_frame",
    f"""select country, count(*) as total_players,
      cast(sum(total_games_played) as bigint) as total_games,
      {even(raw_mean("total_games_played"))} as avg_games_per_player,
      {even(raw_mean("win_ratio"))} as avg_win_ratio,
      {even(raw_mean("rating"))} as avg_rating, {CHURN_RATE} as churn_rate
    from star group by country""",
)
def _(d):
    return P.country_frame(d)


def distribution(key: str, column: str):
    @query(
        key,
        f"""select {column}, count(*) as n,
          {r("count(*) * 100.0 / (select count(*) from star)", 4)} as share
        from star group by {column}""",
    )
    def _(d):
        return P.value_counts(d.star, column)


distribution("level_distribution", "player_level")
distribution("gender_distribution", "gender")
distribution("churn_distribution", "is_churned")
distribution("training_game_distribution", "game_name")


@query(
    "win_ratio_by_level",
    f"select player_level, {mean('win_ratio', 4)} as avg_win_ratio from scored group by player_level",
)
def _(d):
    return P.mean_by(d.scored, "player_level", "win_ratio", "avg_win_ratio")


def described(x: str) -> str:
    return f"""count({x}) as n, {mean(x, 6)} as mean, {r(f"stddev_samp({x})", 6)} as std,
      cast(min({x}) as double) as low, {r(f"quantile_cont(cast({x} as double), 0.25)", 6)} as q25,
      {r(f"quantile_cont(cast({x} as double), 0.5)", 6)} as q50,
      {r(f"quantile_cont(cast({x} as double), 0.75)", 6)} as q75, cast(max({x}) as double) as high"""


@query("describe_age", f"select {described('age')} from star")
def _(d):
    return P.describe_bounded(d.star, "age")


@query("describe_win_ratio", f"select {described('win_ratio')} from star")
def _(d):
    return P.describe_bounded(d.star, "win_ratio")


CORR = ["total_games_played", "win_ratio", "total_moves", "highest_score", "rating"]
PAIRS = [(a, b) for i, a in enumerate(CORR) for b in CORR[i + 1 :]]


@query(
    "stat_correlations",
    """with best as (
      select user_id as player_id,
        1 + cast(json_extract_string(props, '$.k') as int) % 5 as game_id, max(value) as highest_score
      from events group by all),
    f as (select s.*, b.highest_score from scored s left join best b
      on b.player_id = s.player_id and b.game_id = s.game_id) """
    + " union all ".join(
        f"""select '{a}' as "left", '{b}' as "right",
        {r(f"corr(cast({a} as double), cast({b} as double))", 6)} as r from f"""
        for a, b in PAIRS
    ),
)
def _(d):
    return P.correlations(feature_export(d), CORR)


@query(
    "overall_rates",
    f"""select {mean("total_games_played", 4)} as avg_games_per_player,
      {mean("(case when is_churned then 100.0 else 0.0 end)", 4)} as churn_rate from scored""",
)
def _(d):
    return P.overall_rates(d)


@query(
    "churn_quantile_label",
    f"""with s as (select player_id, game_id, cast(cast(total_time_played_minutes * 0.4::double
        + total_games_played * 0.3::double + total_wins / total_games_played::double * 0.3::double
        as decimal(28,6)) as double) as engagement_score from pgs)
    select *, cast(engagement_score < (select {r("quantile_cont(engagement_score, 0.2)", 6)} from s)
      as int) as churned from s""",
)
def _(d):
    return P.churn_by_quantile(d)


@query(
    "game_time_profile",
    f"""select game_name, {even(raw_mean("total_time_played_minutes"))} as minutes_mean,
      {even("stddev_samp(total_time_played_minutes)")} as minutes_std,
      {even(raw_mean("(total_time_played_minutes / total_games_played::double)"))} as session_mean,
      {even(raw_mean("total_games_played"))} as games_mean,
      {even(raw_mean("win_ratio"))} as win_ratio_mean
    from star group by game_name""",
)
def _(d):
    return P.game_time_profile(d)


@query(
    "time_quartiles_by_game",
    f"""select game_name, {", ".join(
        f"{r(f'quantile_cont(cast(total_time_played_minutes as double), {p})', 6)} as q{int(p * 100)}"
        for p in (0.25, 0.5, 0.75))}
    from star group by game_name""",
)
def _(d):
    return P.time_quartiles_by_game(d)


RATIOS = {
    "avg_session_duration": "total_time_played_minutes",
    "historical_win_rate": "total_wins",
    "avg_moves_per_game": "total_moves",
}


@query(
    "training_summary",
    "with long as ("
    + " union all ".join(
        f"select '{name}' as feature, {top} / total_games_played::double as x from pgs"
        for name, top in RATIOS.items()
    )
    + f""")
    select feature, count(x) as n, {mean("x", 6)} as mean, {r("stddev_samp(x)", 6)} as std,
      {r("min(x)", 6)} as low, {r("max(x)", 6)} as high,
      {r("quantile_cont(cast(cast(x as decimal(28,6)) as double), 0.25)", 6)} as q25,
      {r("quantile_cont(cast(cast(x as decimal(28,6)) as double), 0.5)", 6)} as q50,
      {r("quantile_cont(cast(cast(x as decimal(28,6)) as double), 0.75)", 6)} as q75
    from long group by feature""",
)
def _(d):
    return P.describe_features(P.per_game_features(d), list(RATIOS))


@query(
    "game_avg_win_rate",
    f"""with g as (select game_id, {mean("(total_wins / total_games_played::double)", 6)}
      as game_avg_win_rate from pgs group by game_id)
    select player_id, game_id, game_avg_win_rate from pgs join g using (game_id)""",
)
def _(d):
    return P.game_avg_win_rate(d)


@query(
    "next_win_label",
    f"""select player_id, game_id, cast(total_wins / total_games_played::double >
      (select {raw_mean("(total_wins / total_games_played::double)")} from pgs) as int) as next_game_win
    from pgs""",
)
def _(d):
    return P.next_win_label(d)


@query(
    "category_vocab",
    """select 'country' as feature, country as value from players join pgs using (player_id)
    union select 'gender', gender from players join pgs using (player_id)
    union select 'game_name', name from games join pgs using (game_id)
    union select 'country', 'unknown' union select 'gender', 'unknown'
    union select 'game_name', 'unknown'""",
)
def _(d):
    return category_vocab(d.star, ["country", "gender", "game_name"])
