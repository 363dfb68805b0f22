import pytest
from pyspark.sql import functions as F

from matchlight.functions import scoring as S
from matchlight.ml import models as M
from matchlight.ml import scoring as C
from matchlight.ml import targets as T
from matchlight.operators import features as X
from matchlight.session import stored
from matchlight.sources import generate
from matchlight.operators.participants import participants

TINY = M.Size(trees=3, rounds=2, depth=3, folds=2, iterations=10)


@pytest.fixture(scope="module")
def rows(spark):
    """Feature rows of generated players, stored once."""
    from matchlight.domain import Domain

    ids = spark.range(60).withColumnRenamed("id", "player_id")
    wide = generate.matches(ids, 60, "2023-01-01", "2024-06-01")
    moves = participants(wide.select("match_id", "player1_id", "player2_id", "player1_moves", "player2_moves")).select(
        "match_id", "player_id", F.when(F.col("seat") == 1, F.col("player1_moves")).otherwise(F.col("player2_moves")).alias("moves_count")
    )
    games = spark.range(1).select(F.inline(generate.games_table())).select("game_id", "name", "can_draw")
    d = Domain(
        spark, "2024-06-30", games=games, players=generate.players(ids, "2024-06-30"),
        matches=stored(wide.drop("player1_moves", "player2_moves"), "m"), moves=stored(moves, "mv"),
    )
    return stored(T.training_rows(d), "rows")


def test_training_rows_roll_matches_up_once(small):
    made = T.training_rows(small)
    assert "moves_count" not in made._jdf.queryExecution().optimizedPlan().toString()
    kept = small.stats.where("total_games_played > 0 and total_time_played_minutes > 0")
    columns = ["player_id", "game_id", "total_games_played", "total_wins", "total_moves", "first_played", "last_played"]
    assert sorted(map(tuple, made.select(columns).collect())) == sorted(map(tuple, kept.select(columns).collect()))
    assert made.where("game_avg_win_rate is null or next_game_win is null").count() == 0
    whole = small.rolled_up()
    assert whole.has_stats and whole.rolled_up() is whole and not small.has_stats


def test_training_is_repeatable_and_better_than_chance(rows):
    first = M.train(rows, T.WIN_BINARY, models=("gradient_boosting",), size=TINY)
    again = M.train(rows.repartition(3), T.WIN_BINARY, models=("gradient_boosting",), size=TINY)
    assert first.scores[0][1] == pytest.approx(again.scores[0][1], abs=0.02)
    assert first.scores[0][3] > 0.6
    assert first.best == "gradient_boosting"


def test_best_model_has_the_highest_mean(rows, spark):
    done = M.train(rows, T.ENGAGEMENT, models=("linear", "ridge"), size=TINY)
    means = {name: mean for name, mean, *_ in done.scores}
    assert all(rmse >= mae > 0 for *_, rmse, mae in done.scores)
    assert done.best == max(means, key=means.get)
    assert done.table(spark).filter("best").count() == 1


def test_saved_model_scores_the_same_and_takes_unseen_values(rows, tmp_path):
    model = M.fit_one(rows, T.LEVEL, "random_forest", TINY)
    M.save(model, str(tmp_path / "m"))
    loaded = M.load(str(tmp_path / "m"))
    odd = rows.limit(20).withColumn("country", F.lit("Jamaica")).withColumn("game_name", F.lit("COD"))
    labels = C.level_labels(model)
    a = C.score_level(odd, model, labels).select("player_id", "game_id", "predicted_level", "level_confidence").collect()
    b = C.score_level(odd, loaded, labels).select("player_id", "game_id", "predicted_level", "level_confidence").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 20


def test_vote_and_unified_scores(rows):
    models = {n: M.fit_one(rows, T.CHURN, n, TINY) for n in ("logistic", "svm")}
    voted = M.soft_vote(rows, models, T.CHURN)
    assert voted.filter("probability between 0 and 1").count() == rows.count()
    every = {
        "churn": models["logistic"],
        "win": M.fit_one(rows, T.WIN, "linear", TINY),
        "engagement": M.fit_one(rows, T.ENGAGEMENT, "linear", TINY),
        "level": M.fit_one(rows, T.LEVEL, "logistic", TINY),
    }
    out = C.score_all(rows, every, "2024-06-30", "v1")
    one = out.filter("predictions.win_probability.win_prediction not between 0 and 1")
    assert one.count() == 0 and out.count() == rows.count()


def test_synthetic_rows_balance_the_classes(rows):
    data = M.prepare(rows, T.CHURN, 2).filter("is_train")
    from pyspark.ml import Pipeline

    ready = Pipeline(stages=M.feature_stages(T.CHURN)).fit(data).transform(data)
    before = dict(ready.groupBy("label").count().collect())
    after = dict(M.with_synthetic(ready, T.CHURN).groupBy("label").count().collect())
    assert max(after.values()) == max(before.values())
    assert min(after.values()) > 0.8 * max(after.values())


def made_features(spark, moved=None):
    """Forty rows of two classes in two folds; class 1 of a fold may be moved far away. Fold 2 has two rows of class 1."""
    from pyspark.ml.functions import array_to_vector

    def row(i):
        label, fold = float(i % 4 == 0), i // 4 % 2 if i < 72 else 2
        shift = 1000.0 if moved == fold and label else 0.0
        return (i, i % 3, label, fold, 1.0, [shift + (i * 37 % 11) / 3, shift + (i * 53 % 7) / 5])

    df = spark.createDataFrame([row(i) for i in range(80)], "player_id long, game_id long, label double, fold int, weight double, x array<double>")
    return df.withColumn("features", array_to_vector("x")).withColumnRenamed("weight", M.WEIGHT).drop("x")


def test_synthetic_rows_depend_on_their_own_fold_only(spark):
    def by_fold(moved):
        out = M.with_synthetic(made_features(spark, moved), T.CHURN).filter("real = 0").collect()
        return {f: sorted(tuple(round(x, 9) for x in r.features) for r in out if r.fold == f) for f in (0, 1, 2)}

    plain, moved = by_fold(None), by_fold(1)
    assert plain[0] == moved[0] and plain[2] == moved[2] and all(plain.values())
    assert all(x[0] >= 1000 for x in moved[1]) and len(moved[1]) == len(plain[1])


def test_folds_are_judged_on_given_rows(spark):
    from matchlight.ml.boosting import Boosting

    both = M.with_synthetic(made_features(spark).filter("fold < 2"), T.CHURN)
    # Every synthetic row gets a label the features speak against; it would be judged wrong.
    judged = both.filter("real = 1").unionByName(both.filter("real = 1").withColumn("label", 1 - F.col("label")).withColumn(M.WEIGHT, F.lit(1e-9)).withColumn("real", F.lit(0.0)))
    booster = Boosting(featuresCol="features", labelCol="label", weightCol=M.WEIGHT, loss="logistic", rounds=2, depth=2)
    with_them = booster.cross_validate(judged, 2)[1]
    without = booster.cross_validate(both.filter("real = 1"), 2)[1]
    assert with_them == pytest.approx(without, abs=1e-6) and len(with_them) == 2


def test_training_with_synthetic_rows(rows):
    out = M.train(rows, T.CHURN, models=("logistic", "gradient_boosting"), size=TINY, balance=True)
    assert all(0.5 < mean <= 1 for _, mean, *_ in out.scores)


def test_unknown_model_is_refused():
    with pytest.raises(ValueError):
        M.estimator(T.CHURN, "magic")


def test_group_split_keeps_players_whole(rows):
    train, test = X.group_split(rows, "player_id")
    assert train.join(test, "player_id", "left_semi").count() == 0
    assert train.count() + test.count() == rows.count()


def test_stratified_folds_differ_by_at_most_one(rows):
    dealt = X.stratified_folds(rows.select("player_id", "game_id", "player_level"), "player_level", ["player_id", "game_id"], 4)
    sizes = {}
    for r in dealt.groupBy("player_level", "fold").count().collect():
        sizes.setdefault(r["player_level"], []).append(r["count"])
    for counts in sizes.values():
        assert max(counts) - min(counts) <= 1


def test_one_hot_drops_the_first_value(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "x string")
    got = {r["x"]: (r["x_b"], r["x_c"]) for r in X.one_hot(df, "x").collect()}
    assert got == {"a": (0, 0), "b": (1, 0), "c": (0, 1)}


def test_strict_encoding_raises_on_unseen_values(spark):
    seen = spark.createDataFrame([("a",)], "x string")
    new = spark.createDataFrame([("z",)], "x string")
    with pytest.raises(Exception):
        X.encoder(seen, "x", "c", "error").transform(new).collect()
    assert X.encoder(seen, "x", "c").transform(new).first()["c"] == 1.0


# --- generated data ---------------------------------------------------------------------------


def test_generated_players_do_not_depend_on_partitions(spark):
    ids = spark.range(2000).withColumnRenamed("id", "player_id")
    a = generate.players(ids, "2024-06-30")
    b = generate.players(ids.repartition(7), "2024-06-30")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.select("username").distinct().count() == 2000 == a.select("email").distinct().count()
    usa = a.filter("country = 'USA'").count()
    assert 240 <= usa <= 360  # 15 percent
    assert a.filter("firstname = 'James'").count() > 0


def test_matches_are_drawn_by_many_tasks(spark):
    ids = spark.range(5000).withColumnRenamed("id", "player_id").coalesce(1)
    made = generate.matches(ids, 5000, "2023-01-01", "2024-06-01")
    assert made.select(F.spark_partition_id()).distinct().count() == generate.matches_parts(5000) == 3


def test_generated_matches(spark):
    ids = spark.range(50).withColumnRenamed("id", "player_id")
    m = generate.matches(ids, 50, "2024-01-01", "2024-12-13", skip=("2024-03-31", "2024-03-31"))
    bad = (
        (F.col("player1_id") == F.col("player2_id"))
        | ~F.col("player2_id").between(0, 49)
        | (F.to_date("start_time") == F.lit("2024-03-31").cast("date"))
        | ((F.col("result") == "draw") != F.col("winner_id").isNull())
        | (F.col("game_id").isin(1, 5, 6, 7) & F.col("winner_id").isNull())
    )
    assert m.filter(bad).count() == 0
    assert m.select("match_id").distinct().count() == m.count() > 1000


def test_level_samples_of_the_scoring_requests(spark):
    df = spark.createDataFrame([(130, 96), (123, 39), (4, 1)], "g int, w int")
    got = [r[0] for r in df.select(S.player_level(F.col("g"), F.col("w"))).collect()]
    assert got == ["expert", "intermediate", "novice"]


def test_missing_values_lose_no_row(rows):
    """NULL numbers are filled with the training mean, NULL categories have a code of their own."""
    holes = rows.withColumns(
        {"age": F.when(F.col("player_id") % 2 == 0, F.col("age")), "country": F.lit(None).cast("string")}
    )
    assert M.prepare(holes, T.CHURN, 2).count() == rows.count()
    model = M.fit_one(holes, T.CHURN, "logistic", TINY)
    scored = C.score_churn(holes, model)
    assert scored.count() == rows.count() and scored.where("churn_probability is null").count() == 0
    assert not [c for c in scored.columns if c.endswith("_filled")]


def test_three_class_vote_takes_the_largest_mean(rows):
    models = {n: M.fit_one(rows, T.LEVEL, n, TINY) for n in ("random_forest", "svm")}
    labels = C.level_labels(models["svm"])
    voted = M.soft_vote(rows, models, T.LEVEL, labels).collect()
    assert len(voted) == rows.count()
    for r in voted[:50]:
        mean = [(a + b) / 2 for a, b in zip(r.p_random_forest, r.p_svm)]
        assert r.prediction == labels[max(range(len(labels)), key=lambda i: (round(mean[i], 6), -i))]


def test_tasks_side_by_side_run_at_the_same_time_and_keep_their_order(spark):
    import threading

    from matchlight.session import side_by_side

    meet = threading.Barrier(2, timeout=60)

    def task(n):
        meet.wait()
        return spark.range(n).count()

    assert side_by_side(spark, [lambda: task(3), lambda: task(5)], 2) == [3, 5]


def test_grid_search_tries_every_model_on_its_whole_grid(spark, monkeypatch):
    from types import SimpleNamespace

    from matchlight.queries import models as Q
    from matchlight.queries.base import REGISTRY

    asked = {}
    monkeypatch.setattr(Q.T, "training_rows", lambda d: None)
    monkeypatch.setattr(Q.M, "train", lambda rows, target, **options: asked.update(options, target=target) or SimpleNamespace(table=lambda s: None))
    REGISTRY["grid_search"].run(SimpleNamespace(spark=None))
    assert (asked.get("models") or asked["target"].models) == T.CLASSIFIERS
    sizes = {}
    for name in T.CLASSIFIERS:
        stages = M.estimator(T.CHURN, name)
        sizes[name] = len(M._grid(stages, asked["grid"][name]))
    assert sizes == {"random_forest": 6, "gradient_boosting": 18, "logistic": 6, "svm": 6}
    assert asked["grid"]["random_forest"]["numTrees"] == [100, 200] and max(asked["grid"]["random_forest"]["maxDepth"]) == 30


def test_grids_of_all_models(rows):
    grid = {
        "svm": {"regParam": [0.01, 0.001], "featuresCol": ["features", "fourier"]},
        "gradient_boosting": {"rounds": [1, 3], "rate": [0.1, 0.5], "depth": [1, 2]},
    }
    done = M.train(rows, T.CHURN, models=tuple(grid), size=TINY, grid=grid)
    assert all(0.5 < mean <= 1 for _, mean, *_ in done.scores) and len(done.scores) == 2


def test_fewer_rounds_are_the_first_of_more(rows):
    from pyspark.ml import Pipeline

    data = M.prepare(rows, T.CHURN, 2)
    ready = Pipeline(stages=M.feature_stages(T.CHURN)).fit(data).transform(data)
    short, long = (M.Boosting(loss="logistic", rounds=n, depth=2, rate=0.3) for n in (2, 4))
    for (model, scores), alone in zip(long.staged(ready, 2, [2, 4]), (short, long)):
        other, expected = alone.cross_validate(ready, 2)
        assert scores == pytest.approx(expected)
        got, want = (sorted(p[1] for p in M.F.broadcast(m.transform(ready)).select("probability").toPandas()["probability"]) for m in (model, other))
        assert got == pytest.approx(want)
