"""The named reports. Each takes a :class:`Domain` and returns a DataFrame; an empty result is an
empty DataFrame. Every ranking ends in a unique key, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlight.domain import Domain
from matchlight.functions import scoring as S
from matchlight.functions.numbers import days_since, exact_mean, percent, ratio, rounded
from matchlight.operators.participants import with_moves
from matchlight.operators.skew import skew_join

PLAYER_COLUMNS = [
    "player_id",
    "game_id",
    "player_name",
    "game_name",
    "total_games_played",
    "total_wins",
    "total_losses",
    "total_moves",
    "total_time_played_minutes",
    "win_ratio",
    "age",
    "gender",
    "country",
]
PK = ("player_id", "game_id")


def total(name: str) -> Column:
    return F.sum(name).cast("bigint")


def check_limit(limit: int, low: int, high: int) -> int:
    if not low <= limit <= high:
        raise ValueError(f"limit must be between {low} and {high}")
    return limit


def first_rows(
    d: Domain, scored: DataFrame, order: list, limit: int, skip: int = 0
) -> DataFrame:
    """Rank the stats, keep one page, and only then look up names for the few rows left."""
    page = scored.orderBy(*order, *PK)
    page = page.offset(skip).limit(limit) if skip else page.limit(limit)
    return d.named(page).orderBy(*order, *PK)


def games_named(d: Domain, name: str) -> DataFrame:
    return d.games.filter(F.col("name") == name)


# --- player lists -----------------------------------------------------------------------------


def all_player_stats(d: Domain) -> DataFrame:
    return d.star.orderBy(F.desc("last_played"), *PK).select(*PLAYER_COLUMNS)


def matches_text(column: Column, term: str, collation: str | None = None) -> Column:
    """Whether the text contains the term, whatever the case; % and _ are wildcards.

    With a collation such as UNICODE_CI_AI the comparison follows it (accents, too) and the term
    is taken as it is.
    """
    if collation:
        return F.collate(column, collation).contains(F.collate(F.lit(term), collation))
    return F.lower(column).like(f"%{term.lower()}%")


def game_stats_search(d: Domain, term: str, collation: str | None = None) -> DataFrame:
    """Stats of games whose name contains the term, see :func:`matches_text`."""
    found = d.games.filter(matches_text(F.col("name"), term, collation))
    return (
        d.named(d.scored_of_games(found))
        .orderBy(F.desc("win_ratio"), F.desc("total_games_played"), *PK)
        .select(*PLAYER_COLUMNS)
    )


def player_search(d: Domain, term: str, collation: str | None = None) -> DataFrame:
    """Stats of players whose full name contains the term, see :func:`matches_text`."""
    found = d.people.filter(matches_text(F.col("player_name"), term, collation))
    return (
        d.scored_of_players(found)
        .join(found, "player_id")
        .join(d.game_names, "game_id")
        .orderBy(F.desc("win_ratio"), F.desc("total_games_played"), *PK)
        .select(*PLAYER_COLUMNS)
    )


def player_stats_by_id(d: Domain, player_id: int) -> DataFrame:
    return d.named(d.scored_of_player(player_id)).select(*PLAYER_COLUMNS, "rating", "last_played")


def game_stats_by_id(d: Domain, game_id: int) -> DataFrame:
    return (
        d.named(d.scored_of_games(d.games.filter(F.col("game_id") == game_id)))
        .orderBy(F.desc("rating"), F.desc("win_ratio"), *PK)
        .select(*PLAYER_COLUMNS, "rating", "last_played")
    )


def players_page(d: Domain, skip: int = 0, limit: int = 20) -> DataFrame:
    """One page of stats rows, newest first."""
    check_limit(limit, 1, 100)
    page = first_rows(d, d.scored, [F.desc("last_played")], limit, skip)
    return page.select(*PLAYER_COLUMNS, "rating", "last_played")


def active_players(d: Domain, days: int = 90) -> DataFrame:
    idle = days_since(F.col("last_played"), d.as_of)
    return d.star.filter(idle <= days).select(*PLAYER_COLUMNS, "last_played")


def recent_matches(d: Domain, limit: int = 5) -> DataFrame:
    return d.matches.orderBy(F.desc("start_time"), "match_id").limit(limit)


def recent_players(d: Domain, limit: int = 3) -> DataFrame:
    """The newest players; ids are handed out in order of registration."""
    return (
        d.players.select("player_id", "username", "country")
        .orderBy(F.desc("player_id"))
        .limit(limit)
    )


# --- rankings ---------------------------------------------------------------------------------


def top_players_by_game(d: Domain, game: str, limit: int = 3) -> DataFrame:
    """The busiest players of a game, then by win ratio."""
    check_limit(limit, 1, 10)
    order = [F.desc("total_games_played"), F.desc("win_ratio")]
    scored = d.scored_of_games(games_named(d, game))
    return first_rows(d, scored, order, limit).select(*PLAYER_COLUMNS)


def top_rated_by_game(d: Domain, game_id: int, limit: int = 3) -> DataFrame:
    check_limit(limit, 1, 10)
    scored = d.scored_of_games(d.games.filter(F.col("game_id") == game_id))
    return first_rows(d, scored, [F.desc("rating"), F.desc("win_ratio")], limit).select(
        "player_id",
        "player_name",
        "country",
        "total_games_played",
        "total_wins",
        "total_losses",
        "win_ratio",
        "rating",
        "last_played",
    )


def top_players_min_games(
    d: Domain, game: str = "battleship", min_games: int = 20, limit: int = 10
) -> DataFrame:
    """The leaders of a game by win rate among players with enough games."""
    scored = d.scored_of_games(games_named(d, game)).filter(
        F.col("total_games_played") >= min_games
    )
    order = [F.desc("win_ratio"), F.desc("total_games_played")]
    return first_rows(d, scored, order, limit).select(
        "player_id",
        "player_name",
        "country",
        "total_games_played",
        "total_wins",
        "total_losses",
        F.col("win_ratio").alias("win_rate"),
        "total_moves",
        "total_time_played_minutes",
    )


def ranked_players(d: Domain, top: int = 3, min_games: int = 10, active_days: int = 90) -> DataFrame:
    """The best active players of each game by the weighted score.

    Ranking runs on the stats alone, cut to ``top`` per game before its shuffle; names are joined
    to the few rows left.
    """
    g, t, last = F.col("total_games_played"), F.col("total_time_played_minutes"), F.col("last_played")
    score = S.player_score(F.col("win_ratio"), g, t, last, d.as_of)
    window = Window.partitionBy("game_id").orderBy(F.desc("player_score"), "player_id")
    ranked = (
        d.scored.filter((g >= min_games) & (days_since(last, d.as_of) <= active_days))
        .withColumn("player_score", score)
        .withColumn("player_rank", F.row_number().over(window))
        .filter(F.col("player_rank") <= top)
        .withColumn("player_rank", F.col("player_rank").cast("bigint"))
    )
    return (
        ranked.join(d.people, "player_id")
        .join(d.game_names, "game_id")
        .select(
            "player_name", "game_name", "total_games_played", "total_wins", "total_losses",
            "win_ratio", rounded(F.col("player_score")).alias("player_score"), "player_rank",
        )
    )


def top3_per_game(d: Domain) -> DataFrame:
    return ranked_players(d).orderBy("game_name", "player_rank")


def top3_nested(d: Domain) -> DataFrame:
    """One row per game with its ranked players; at most three per list."""
    entry = F.struct(
        F.col("player_rank").alias("rank"),
        "player_name",
        F.col("total_games_played").alias("total_games"),
        F.col("total_wins").alias("wins"),
        F.col("total_losses").alias("losses"),
        "win_ratio",
    )
    return (
        ranked_players(d)
        .groupBy("game_name")
        .agg(F.array_sort(F.collect_list(entry)).alias("top_players"))
        .orderBy("game_name")
    )


# --- games ------------------------------------------------------------------------------------


def _per_game_totals(d: Domain) -> DataFrame:
    return (
        d.scored.groupBy("game_id")
        .agg(
            F.count("*").alias("unique_players"),
            total("total_games_played").alias("total_matches"),
            rounded(exact_mean(F.col("win_ratio")), 4).alias("average_win_ratio"),
            rounded(exact_mean(F.col("rating")), 4).alias("average_rating"),
            F.max("last_played").alias("last_played"),
        )
        .join(d.game_names, "game_id")
    )


def most_played_games(d: Domain, limit: int = 10) -> DataFrame:
    check_limit(limit, 1, 50)
    return (
        _per_game_totals(d)
        .orderBy(F.desc("total_matches"), "game_name")
        .limit(limit)
        .select("game_name", "unique_players", "total_matches", "average_win_ratio")
    )


def most_played_games_rated(d: Domain, limit: int = 10) -> DataFrame:
    check_limit(limit, 1, 50)
    return (
        _per_game_totals(d)
        .orderBy(F.desc("total_matches"), "game_id")
        .limit(limit)
        .select(
            "game_id", "game_name", "unique_players", "total_matches", "average_rating",
            "last_played",
        )
    )


def top_games_by_players(d: Domain, limit: int = 5) -> DataFrame:
    return (
        _per_game_totals(d)
        .orderBy(F.desc("unique_players"), "game_name")
        .limit(limit)
        .select(
            "game_name",
            F.col("unique_players").alias("player_count"),
            F.col("average_rating").alias("avg_rating"),
        )
    )


def platform_summary(d: Domain, approximate: bool = False) -> DataFrame:
    """One row for the whole platform, with exact distinct counts unless asked otherwise."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return d.scored.agg(
        distinct("player_id").alias("total_players"),
        distinct("game_id").alias("total_games"),
        total("total_games_played").alias("total_matches_played"),
        rounded(exact_mean(F.col("win_ratio")), 4).alias("average_win_ratio"),
        rounded(exact_mean(F.col("rating")), 4).alias("average_rating"),
        F.max("last_played").alias("last_activity"),
    )


def popular_games(d: Domain) -> DataFrame:
    """Matches, players, mean duration over participants and share, with idle games kept."""
    per_player = d.participants.groupBy("game_id", "player_id").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("seat") == 1, 1)).alias("matches"),
        total("duration_minutes").alias("minutes"),
    )
    per_game = per_player.groupBy("game_id").agg(
        total("matches").alias("matches"),
        F.count("*").alias("players"),
        ratio(F.sum("minutes"), F.sum("n")).alias("mean_minutes"),
    )
    all_matches = d.matches.agg(F.count("*")).scalar()
    return (
        d.games.join(d.per_game(per_game), "game_id", "left")
        .select(
            F.col("name").alias("game_name"),
            F.coalesce("matches", F.lit(0)).cast("bigint").alias("total_matches"),
            F.coalesce("players", F.lit(0)).cast("bigint").alias("unique_players"),
            rounded(F.col("mean_minutes")).alias("avg_duration_minutes"),
            all_matches.alias("all_matches"),
        )
        .withColumn("match_percentage", percent(F.col("total_matches"), F.col("all_matches")))
        .drop("all_matches")
        .orderBy(F.desc("total_matches"), "game_name")
    )


def game_engagement_summary(d: Domain) -> DataFrame:
    g = F.col("total_games_played")
    return (
        d.stats.groupBy("game_id")
        .agg(
            F.count("*").alias("active_players"),
            rounded(exact_mean(F.col("total_time_played_minutes") / 60.0)).alias(
                "avg_hours_per_player"
            ),
            rounded(exact_mean(g)).alias("avg_games_per_player"),
            F.min(g).alias("min_games"),
            F.max(g).alias("max_games"),
        )
        .join(d.game_names, "game_id")
        .drop("game_id")
        .orderBy(F.desc("active_players"), "game_name")
    )


def game_complexity(d: Domain) -> DataFrame:
    moves = F.col("player1_moves") + F.col("player2_moves")
    minutes = F.col("duration_minutes")
    slim = d.matches.select("match_id", "game_id", "player1_id", "player2_id", "duration_minutes")
    return (
        with_moves(slim, d.moves)
        .join(d.game_names, "game_id")
        .groupBy("game_name")
        .agg(
            rounded(exact_mean(moves)).alias("avg_total_moves"),
            rounded(exact_mean(minutes)).alias("avg_duration"),
            rounded(exact_mean(ratio(moves, minutes))).alias("moves_per_minute"),
            F.count("*").alias("total_matches"),
        )
        .orderBy(F.desc("moves_per_minute"), "game_name")
    )


def match_counts_by_game(d: Domain) -> DataFrame:
    per_game = d.matches.groupBy("game_id").agg(F.count("*").alias("total_matches"))
    return per_game.join(d.game_names, "game_id").select("game_name", "total_matches")


def match_share_by_game(d: Domain) -> DataFrame:
    counts = match_counts_by_game(d)
    all_matches = counts.agg(F.sum("total_matches")).scalar()
    return (
        counts.withColumn("all_matches", all_matches)
        .withColumn("percentage", percent(F.col("total_matches"), F.col("all_matches")))
        .drop("all_matches")
        .orderBy(F.desc("total_matches"), "game_name")
    )


def stats_rows_per_game(d: Domain) -> DataFrame:
    """Rows of the outer join per game (1 for an idle game) next to the true number of stats."""
    per_game = d.stats.groupBy("game_id").agg(F.count("*").alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return d.games.join(d.per_game(per_game), "game_id", "left").select(
        "game_id", "name", F.greatest(n, F.lit(1).cast("bigint")).alias("rows"), n.alias("stats")
    )


# --- countries --------------------------------------------------------------------------------


def country_pair_games(d: Domain, rows_per_task: int | None = None) -> DataFrame:
    """Matches and minutes per (seat-1 country, seat-2 country, game).

    Both country reports are built from this table. The first join spreads busy seat-1 players;
    grouping by the first country then leaves at most countries x games rows per seat-2 player,
    so the second join has no hot key left.
    """
    extra = {"rows_per_task": rows_per_task} if rows_per_task else {}
    home = d.players.select("player_id", "country")
    seat1 = home.select(F.col("player_id").alias("player1_id"), F.col("country").alias("country1"))
    seat2 = home.select(F.col("player_id").alias("player2_id"), F.col("country").alias("country2"))
    slim = d.matches.select("match_id", "player1_id", "player2_id", "game_id", "duration_minutes")
    first = (
        skew_join(slim, seat1, "player1_id", "match_id", **extra)
        .groupBy("country1", "player2_id", "game_id")
        .agg(F.count("*").alias("n"), total("duration_minutes").alias("minutes"))
    )
    return (
        first.join(seat2, "player2_id")
        .groupBy("country1", "country2", "game_id")
        .agg(total("n").alias("matches"), total("minutes").alias("minutes"))
    )


def country_pairings(d: Domain, min_matches: int = 100) -> DataFrame:
    return (
        country_pair_games(d)
        .groupBy("country1", "country2")
        .agg(
            total("matches").alias("match_count"),
            rounded(ratio(F.sum("minutes"), F.sum("matches"))).alias("avg_duration"),
            F.count("*").alias("unique_games"),
        )
        .filter(F.col("match_count") > min_matches)
        .select(
            F.col("country1").alias("player1_country"),
            F.col("country2").alias("player2_country"),
            "match_count",
            "avg_duration",
            "unique_games",
        )
        .orderBy(F.desc("match_count"), "player1_country", "player2_country")
    )


def country_activity(d: Domain, game: str = "battleship") -> DataFrame:
    """Players, matches, games, hours and the share of one game per country.

    A match between two countries counts for both, one inside a country counts once, while hours
    and ``<game>_percentage`` count every participant. ``<game>_match_percentage`` has the
    same matches above and below the line and so stays within 100.
    """
    pairs = country_pair_games(d).join(d.game_names, "game_id")
    home = F.struct(F.col("country1").alias("country"), F.lit(1).alias("first"))
    away = F.struct(
        F.col("country2").alias("country"),
        (F.col("country1") != F.col("country2")).cast("int").alias("first"),
    )
    sides = pairs.select("game_id", "game_name", "matches", "minutes", F.inline(F.array(home, away)))
    chosen = F.col("game_name") == game
    per_country = sides.groupBy("country").agg(
        total_of(F.col("matches") * F.col("first")).alias("total_matches"),
        F.count_distinct("game_id").alias("unique_games_played"),
        total("minutes").alias("minutes"),
        total_of(F.when(chosen, F.col("matches")).otherwise(0)).alias("seats"),
        total_of(F.when(chosen, F.col("matches") * F.col("first")).otherwise(0)).alias("own"),
    )
    people = d.players.groupBy("country").agg(F.count("*").alias("total_players"))
    matches = F.coalesce(F.col("total_matches"), F.lit(0))
    return (
        people.join(per_country, "country", "left")
        .select(
            "country",
            "total_players",
            matches.cast("bigint").alias("total_matches"),
            rounded(ratio(matches, F.col("total_players"))).alias("avg_matches_per_player"),
            F.coalesce("unique_games_played", F.lit(0)).cast("bigint").alias("unique_games_played"),
            rounded(F.col("minutes") / 60.0).alias("total_hours_played"),
            percent(F.col("seats"), F.col("total_matches")).alias(f"{game}_percentage"),
            percent(F.col("own"), F.col("total_matches")).alias(f"{game}_match_percentage"),
        )
        .orderBy(F.desc("total_matches"), "country")
    )


def total_of(column: Column) -> Column:
    return F.sum(column).cast("bigint")


# --- players ----------------------------------------------------------------------------------


def skill_tiers(d: Domain) -> DataFrame:
    """Players per tier of overall win rate. Grouping by (player, game) first keeps the count of
    games free of a distinct."""
    won = F.col("winner_id") == F.col("player_id")
    per_player = (
        d.participants.groupBy("player_id", "game_id")
        .agg(F.count("*").alias("n"), F.count(F.when(won, 1)).alias("wins"))
        .groupBy("player_id")
        .agg(
            F.count("*").alias("games_played"),
            total("n").alias("matches"),
            total("wins").alias("wins"),
        )
        .withColumn("win_rate", percent(F.col("wins"), F.col("matches")))
    )
    return (
        per_player.groupBy(S.skill_tier(F.col("win_rate")).alias("skill_level"))
        .agg(
            F.count("*").alias("player_count"),
            rounded(exact_mean(F.col("win_rate"))).alias("avg_win_rate"),
            rounded(exact_mean(F.col("matches"))).alias("avg_matches_played"),
            rounded(exact_mean(F.col("games_played"))).alias("avg_different_games"),
        )
        .orderBy(F.desc("avg_win_rate"))
    )


def multi_game_players(d: Domain) -> DataFrame:
    players = d.players.agg(F.count("*")).scalar()
    return (
        d.participants.select("player_id", "game_id")
        .distinct()
        .groupBy("player_id")
        .agg(F.count("*").alias("number_of_games"))
        .groupBy("number_of_games")
        .agg(F.count("*").alias("player_count"))
        .withColumn("players", players)
        .withColumn("percentage_of_players", percent(F.col("player_count"), F.col("players")))
        .drop("players")
        .orderBy("number_of_games")
    )


def player_game_list(d: Domain) -> DataFrame:
    """The games of each player as one ordered text; its length is bounded by the catalogue."""
    return (
        d.participants.select("player_id", "game_id")
        .distinct()
        .join(d.game_names, "game_id")
        .groupBy("player_id")
        .agg(
            F.count("*").alias("games_played"),
            F.expr("listagg(game_name, ',') within group (order by game_name)").alias("game_list"),
        )
    )


def seat_balance(d: Domain) -> DataFrame:
    """Matches per seat for every player and game, zeros included.

    The result is the full grid by definition; every player row is expanded by the game catalogue,
    so no player data is shuffled to make it.
    """
    counts = d.participants.groupBy("player_id", "game_id").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("seat") == 1, 1)).alias("s1"),
        F.count(F.when(F.col("seat") == 2, 1)).alias("s2"),
    )
    # Every player with every game is the result itself.
    grid = d.players.select("player_id", "username").crossJoin(d.per_game(d.games.select("game_id", "name")))
    zero = F.lit(0)
    return (
        grid.join(counts, ["player_id", "game_id"], "left")
        .select(
            F.col("name").alias("game_name"),
            "player_id",
            "username",
            F.coalesce("n", zero).cast("bigint").alias("total_matches"),
            F.coalesce("s1", zero).cast("bigint").alias("games_as_player1"),
            F.coalesce("s2", zero).cast("bigint").alias("games_as_player2"),
        )
        .orderBy("game_name", F.desc("total_matches"), "player_id")
    )
