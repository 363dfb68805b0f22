import pytest
from conftest import rows

from matchlight.plans import frames, reports


def test_idle_game_is_kept(small):
    got = {r.game_name: r for r in reports.popular_games(small).collect()}
    assert (got["go"].total_matches, got["go"].unique_players, got["go"].avg_duration_minutes) == (0, 0, None)
    assert got["battleship"].total_matches == 4 and got["battleship"].unique_players == 3
    assert got["battleship"].match_percentage == 66.67


def test_outer_count_of_an_idle_game(small):
    got = {r["name"]: (r["rows"], r["stats"]) for r in reports.stats_rows_per_game(small).collect()}
    assert got["go"] == (1, 0)
    assert got["chess"] == (3, 3)


def test_seat_balance_is_the_full_grid(small):
    got = {(r.username, r.game_name): tuple(r)[3:] for r in reports.seat_balance(small).collect()}
    assert len(got) == 9
    assert got[("ann", "battleship")] == (3, 2, 1)
    assert got[("bob", "go")] == (0, 0, 0)


def test_searches_ignore_case_and_know_wildcards(small):
    assert {r.game_name for r in reports.game_stats_search(small, "CHE").collect()} == {"chess"}
    assert {r.player_name for r in reports.player_search(small, "b%R").collect()} == {"Bob Ray"}
    assert reports.game_stats_search(small, "poker").count() == 0
    accented = reports.game_stats_search(small, "CHÉSS", collation="UNICODE_CI_AI")
    assert {r.game_name for r in accented.collect()} == {"chess"}


def test_top_ranking_and_nesting(small):
    ranked = rows(reports.ranked_players(small, top=2, min_games=1).select("game_name", "player_rank", "player_name"), "game_name", "player_rank")
    assert [r[:2] for r in ranked] == [("battleship", 1), ("battleship", 2), ("chess", 1), ("chess", 2)]
    nested = reports.top3_nested(small)
    assert nested.count() == 0  # nobody has ten games


def test_paging_covers_all_rows_once(small):
    keys = [("player_id", "game_id")]
    pages = [reports.players_page(small, skip, 2).select(*keys[0]).collect() for skip in (0, 2, 4, 6)]
    seen = [tuple(r) for page in pages for r in page]
    assert len(seen) == len(set(seen)) == small.stats.count()


@pytest.mark.parametrize("call", [reports.most_played_games, reports.players_page])
def test_limits_are_checked(small, call):
    with pytest.raises(ValueError):
        call(small, limit=0)


def test_game_list_is_ordered(small):
    got = {r.player_id: r.game_list for r in reports.player_game_list(small).collect()}
    assert got == {1: "battleship,chess", 2: "battleship,chess", 3: "battleship,chess"}


def test_complexity_ignores_matches_without_moves(small):
    got = {r.game_name: r for r in reports.game_complexity(small).collect()}
    assert got["chess"].avg_total_moves == 42.0  # only match 12 has both counts
    assert got["chess"].total_matches == 2


def test_value_counts_add_up(small):
    got = frames.value_counts(small.star, "gender").collect()
    assert sum(r.n for r in got) == small.stats.count()
    assert sum(r.share for r in got) == pytest.approx(100.0, abs=0.01)


def test_a_stored_stats_table_gives_the_same_lookups(small):
    from matchlight.domain import Domain
    from matchlight.session import stored

    tables = {n: getattr(small, n) for n in ("games", "players", "matches", "moves")}
    kept = Domain(small.spark, small.as_of, stats=stored(small.stats, "stats"), **tables)
    for call in (
        lambda d: reports.player_stats_by_id(d, 1),
        lambda d: reports.game_stats_by_id(d, 2),
        lambda d: reports.top_players_by_game(d, "battleship"),
    ):
        assert rows(call(kept), "player_id", "game_id") == rows(call(small), "player_id", "game_id")


def test_few_games_is_checked(small):
    assert small.few_games is True
