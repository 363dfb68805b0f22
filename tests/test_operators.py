import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from matchlight.operators import changes, participants, rollup
from matchlight.operators.neighbors import nearest, smote, vote
from matchlight.operators.ordered import accumulate, exact_quantiles, with_ranges
from matchlight.operators.skew import hot_keys, skew_join
from matchlight.plans import reports

COUNT_COLUMNS = ["player_id", "game_id", *rollup.COUNTS, "first_played", "last_played"]


def test_participants_equal_the_or_join(small):
    m, p = small.matches, small.players.select("player_id")
    joined = m.join(p, (m.player1_id == p.player_id) | (m.player2_id == p.player_id))
    expected = rows(joined.select("match_id", "player_id"), "match_id", "player_id")
    assert rows(small.participants.select("match_id", "player_id"), "match_id", "player_id") == expected
    # five ordinary matches give two rows, the match against oneself gives one
    assert len(expected) == 2 * 5 + 1


def test_rollup_counts_each_match_once_despite_repeated_moves(small):
    got = {(r.player_id, r.game_id): r for r in small.stats.collect()}
    ann = got[(1, 1)]
    assert (ann.total_games_played, ann.total_wins, ann.total_losses, ann.total_draws) == (3, 2, 1, 0)
    assert ann.total_moves == 7 + 3 + 6
    assert ann.total_time_played_minutes == 65
    assert got[(3, 1)].total_games_played == 1 and got[(3, 1)].total_moves == 8
    assert got[(2, 2)].total_moves == 0  # no moves recorded
    for r in got.values():
        assert r.total_wins + r.total_losses + r.total_draws == r.total_games_played


def test_refresh_and_upsert_equal_a_full_rollup(small):
    late = F.col("match_id") >= 13
    before = rollup.player_game_stats(small.matches.filter(~late), small.moves)
    keys = rollup.affected_keys(small.matches.filter(late))
    fresh = rollup.refresh_keys(keys, small.matches, small.moves)
    merged = changes.upsert(before, fresh, ["player_id", "game_id"]).select(*COUNT_COLUMNS)
    full = small.stats.select(*COUNT_COLUMNS)
    assert rows(merged, "player_id", "game_id") == rows(full, "player_id", "game_id")


def test_deleting_the_last_match_leaves_zeros(small):
    gone = F.col("match_id") == 14
    keys = rollup.affected_keys(small.matches.filter(gone))
    left = rollup.refresh_keys(keys, small.matches.filter(~gone), small.moves).collect()
    assert [(r.player_id, r.game_id, r.total_games_played, r.last_played) for r in left] == [(3, 1, 0, None)]


def test_changed_matches_see_a_winner_become_null(small):
    after = small.matches.withColumn("winner_id", F.when(F.col("match_id") != 10, F.col("winner_id")))
    assert rows(changes.changed_matches(small.matches, after).select("match_id")) == [(10,)]


def test_first_seen_and_insert_if_absent(spark):
    stored = spark.createDataFrame([(1,), (2,)], "id int")
    new = spark.createDataFrame([(2, "b"), (3, "c"), (3, "c")], "id int, v string")
    assert rows(changes.first_seen(new, stored, ["id"])) == [(3, "c")]


def test_wide_stats_equal_the_rollup(small):
    wide = rollup.stats_from_wide(small.wide)
    columns = ["player_id", "game_id", "total_games_played", "total_wins", "total_losses"]
    assert rows(wide.select(*columns), *columns) == rows(small.stats.select(*columns), *columns)


def test_participants_with_moves_keeps_every_seat(small):
    got = participants.participants_with_moves(small.matches, small.moves)
    assert got.count() == 11
    assert got.filter("moves is null").count() == 3


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_a_plain_join(spark, how):
    data = [(i, 7 if i % 3 == 0 else (None if i % 17 == 0 else i % 40)) for i in range(600)]
    facts = spark.createDataFrame(data, "id int, k int")
    dim = spark.createDataFrame([(k, f"v{k}") for k in range(30)], "k int, v string")
    assert hot_keys(facts, "k", 50).first()["k"] == 7
    mine = skew_join(facts, dim, "k", "id", how, rows_per_task=10).select("id", "k", "v")
    assert rows(mine, "id") == rows(facts.join(dim, "k", how).select("id", "k", "v"), "id")


def test_country_tables_do_not_depend_on_the_split(small):
    whole = reports.country_pair_games(small)
    split = reports.country_pair_games(small, rows_per_task=1)
    order = ["country1", "country2", "game_id"]
    assert rows(whole.select(*sorted(whole.columns)), *order) == rows(split.select(*sorted(split.columns)), *order)


def test_country_activity_counts(small):
    usa = reports.country_activity(small).filter("country = 'USA'").first()
    # six matches involve the USA except the Japanese match against oneself
    assert (usa.total_players, usa.total_matches, usa.unique_games_played) == (2, 5, 2)
    assert usa.battleship_percentage == 120.0 and usa.battleship_match_percentage == 60.0


def test_quantiles_match_numpy(spark):
    rng = random.Random(3)
    data = [(g, round(rng.expovariate(0.2), 2)) for g in ("a", "b") for _ in range(501)]
    data += [("a", 1.0)] * 400
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    probabilities = {"q0": 0.0, "q20": 0.2, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    for row in exact_quantiles(df, ["g"], F.col("x"), probabilities).collect():
        values = [x for g, x in data if g == row["g"]]
        for name, p in probabilities.items():
            assert row[name] == pytest.approx(np.quantile(values, p), abs=1e-6)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    values = [(i * 7 % 101, i % 5 + 1) for i in range(101)]
    df = with_ranges(spark.createDataFrame(values, "v int, n bigint"), "v", ranges=8)
    df = df.withColumn("g", F.lit(1))
    order = F.desc("v") if descending else F.asc("v")
    got = {r["v"]: (r["n_upto"], r["n_total"]) for r in accumulate(df, ["g"], [order], ["n"], descending).collect()}
    total, running = sum(n for _, n in values), 0
    for v, n in sorted(values, reverse=descending):
        running += n
        assert got[v] == (running, total)


def test_bucketed_tables_meet_without_a_shuffle(small, tmp_path):
    from matchlight.sources.tables import write_bucketed

    spark = small.spark
    m = write_bucketed(small.matches, "bucketed_matches", str(tmp_path / "m"), "match_id", 4)
    v = write_bucketed(small.moves, "bucketed_moves", str(tmp_path / "v"), "match_id", 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stats = rollup.player_game_stats(m, v)
        plan = stats._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        expected = rows(small.stats.select(*COUNT_COLUMNS), "player_id", "game_id")
        assert rows(stats.select(*COUNT_COLUMNS), "player_id", "game_id") == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("drop table bucketed_matches")
        spark.sql("drop table bucketed_moves")


def test_filters_on_match_columns_reach_the_scan(small, tmp_path):
    path = str(tmp_path / "matches")
    small.matches.write.parquet(path)
    read = small.spark.read.parquet(path)
    wide = participants.with_moves(read, small.moves).filter("game_id = 2")
    assert "EqualTo(game_id,2)" in wide._jdf.queryExecution().executedPlan().toString()


def brute(points, query, k, skip=None):
    near = sorted(
        (sum((a - b) ** 2 for a, b in zip(query, p)), label) for i, (p, label) in enumerate(points) if i != skip
    )
    return near[:k]


@pytest.mark.parametrize("blocks", [(20_000, 20_000), (7, 5)])
def test_nearest_equals_brute_force(spark, blocks):
    rng = random.Random(11)
    points = [([float(rng.randint(0, 9)) for _ in range(3)], rng.choice("xyz")) for _ in range(150)]
    points += [([5.0, 5.0, 5.0], "x")] * 60  # many copies of one row
    asked = [[float(rng.randint(0, 9)) for _ in range(3)] for _ in range(40)] + [[5.0, 5.0, 5.0]]
    base = spark.createDataFrame([(p, label) for p, label in points], "vec array<double>, label string")
    queries = spark.createDataFrame(list(enumerate(asked)), "id bigint, vec array<double>")
    near = nearest(queries, base, "id", 5, "label", pivots=9, base_block=blocks[0], query_block=blocks[1])
    found = {}
    for r in near.orderBy("id", "upto").collect():
        left = 5 - (r["upto"] - r["copies"])
        found.setdefault(r["id"], []).extend([(r["distance2"], r["payload"])] * min(left, r["copies"]))
    voted = {r["id"]: r["predicted"] for r in vote(near, "id", 5).collect()}
    for i, q in enumerate(asked):
        expected = brute(points, q, 5)
        assert found[i] == expected
        labels = [label for _, label in expected]
        assert voted[i] == min(set(labels), key=lambda c: (-labels.count(c), c))


def test_nearest_without_self_and_smote(spark):
    rng = random.Random(5)
    points = [([float(rng.randint(0, 20)), float(rng.randint(0, 20))], "") for _ in range(60)]
    points += [points[0]] * 3
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(points)], "id bigint, vec array<double>")
    near = nearest(df, df, "id", 4, exclude_self=True, pivots=5, base_block=8, query_block=8)
    found = {}
    for r in near.orderBy("id", "upto").collect():
        left = 4 - (r["upto"] - r["copies"])
        found.setdefault(r["id"], []).extend([r["distance2"]] * min(left, r["copies"]))
    for i, (p, _) in enumerate(points):
        assert found[i] == [d for d, _ in brute(points, p, 4, skip=i)]
    made = smote(df, "id", copies=3, k=4, pivots=5).collect()
    assert len(made) == 3 * len(points)
    low, high = [min(p[j] for p, _ in points) for j in (0, 1)], [max(p[j] for p, _ in points) for j in (0, 1)]
    assert all(low[j] <= r["vec"][j] <= high[j] for r in made for j in (0, 1))
    again = smote(df.repartition(7), "id", copies=3, k=4, pivots=5).collect()
    assert sorted((r["id"], r["copy"], r["vec"]) for r in made) == sorted((r["id"], r["copy"], r["vec"]) for r in again)


def test_cells_within_reach_take_bounded_memory():
    import tracemalloc

    import numpy as np

    from matchlight.operators.neighbors import _cells_within_reach

    draw = np.random.default_rng(5)
    vecs, centers = draw.random((10_000, 4)), draw.random((300, 4))
    cell, reach = np.repeat(np.arange(300), 5), draw.random(1500) * 0.1
    tracemalloc.start()
    near = _cells_within_reach(vecs, centers, np.full(300, 0.1), cell, reach, np.ones(1500, dtype=int), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert near.shape == (10_000, 300) and near.any(axis=1).all()
    assert peak < 80 << 20  # a matrix of all rows takes 120 MB, and five of them were held
