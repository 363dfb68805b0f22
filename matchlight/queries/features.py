"""Feature and evaluation queries with their check SQL."""

from pyspark.sql import functions as F

from matchlight.functions.numbers import exact_mean, ratio, rounded
from matchlight.functions.scoring import churn_rule
from matchlight.operators import evaluation as V
from matchlight.operators import features as X
from matchlight.queries.base import query, r
from matchlight.queries.reports import mean
from matchlight.schemas import LEVELS
from matchlight.sources.exports import feature_export

HASH = "(((player_id % 1000003) * 2654435761) % 1000)"


@query(
    "label_encode",
    """with codes as (select country, dense_rank() over (order by country) - 1 as code
      from (select distinct country from star) t)
    select player_id, game_id, cast(code as int) as country_code
    from star join codes using (country)""",
)
def _(d):
    coded = X.label_encode(d.star, "country", "code")
    return coded.select("player_id", "game_id", F.col("code").cast("int").alias("country_code"))


@query(
    "safe_encode",
    """select player_id, game_id, case game_name when 'battleship' then 0 when 'chess' then 1
      when 'go' then 2 when 'reversi' then 3 else 4 end as game_code from star""",
)
def _(d):
    seen = d.star.filter("game_name <> 'tic tac toe'")
    coded = X.encoder(seen, "game_name", "code").transform(d.star)
    return coded.select("player_id", "game_id", F.col("code").cast("int").alias("game_code"))


@query(
    "one_hot",
    """select player_id, game_id, cast(gender = 'Male' as int) as "gender_Male",
      cast(gender = 'Non-Binary' as int) as "gender_Non-Binary" from star""",
)
def _(d):
    return X.one_hot(d.star.select("player_id", "game_id", "gender"), "gender").drop("gender")


@query(
    "impute_mean",
    f"""with best as (
      select user_id as player_id,
        1 + cast(json_extract_string(props, '$.k') as int) % 5 as game_id, max(value) as highest_score
      from events group by all),
    f as (select s.player_id, s.game_id, b.highest_score from pgs s left join best b
      on b.player_id = s.player_id and b.game_id = s.game_id)
    select player_id, game_id,
      {r("coalesce(highest_score, (select avg(highest_score) from f))", 4)} as highest_score from f""",
)
def _(d):
    filled = X.impute_mean(feature_export(d), ["highest_score"])
    value = rounded(F.col("highest_score"), 4).alias("highest_score")
    return filled.select("player_id", "game_id", value)


SCALED = ["total_games_played", "win_ratio", "total_moves", "age"]


@query(
    "standard_scale",
    "with s as (select "
    + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in SCALED)
    + " from star) select player_id, game_id, "
    + ", ".join(f"{r(f'({c} - m_{c}) / s_{c}', 4)} as {c}" for c in SCALED)
    + " from star cross join s",
)
def _(d):
    base = d.star.select("player_id", "game_id", *SCALED)
    return X.standard_scale(base, SCALED, digits=4)


@query("hash_split", f"select player_id, game_id, {HASH} < 800 as is_train from pgs")
def _(d):
    return X.hash_split(d.stats.select("player_id", "game_id"), F.col("player_id"))


@query(
    "group_split",
    f"""select case when {HASH} < 800 then 'train' else 'test' end as side, player_id, game_id
    from pgs""",
)
def _(d):
    train, test = X.group_split(d.stats.select("player_id", "game_id"), "player_id")
    return train.withColumn("side", F.lit("train")).unionByName(
        test.withColumn("side", F.lit("test"))
    )


@query(
    "class_weights",
    f"""with c as (select is_churned, count(*) as n from scored group by is_churned)
    select is_churned, n,
      {r("(select count(*) from scored) / ((select count(*) from c) * n)::double", 6)} as weight
    from c""",
)
def _(d):
    return X.class_weights(d.scored, "is_churned")


@query(
    "stratified_folds",
    f"""select player_id, game_id, is_churned, cast((row_number() over (partition by is_churned
      order by ({HASH} + game_id * 7) % 1000, player_id, game_id) - 1) % 5 as int) as fold
    from scored""",
)
def _(d):
    rows = d.scored.select("player_id", "game_id", "is_churned")
    return X.stratified_folds(rows, "is_churned", ["player_id", "game_id"])


# --- evaluation of a simple predictor derived from the rating ---------------------------------

LEVEL_SQL = """p as (select player_level, case when rating >= 4 then 'expert' when rating >= 2
      then 'intermediate' else 'novice' end as predicted from scored)"""


def level_guess(d):
    guess = F.when(F.col("rating") >= 4, "expert").when(F.col("rating") >= 2, "intermediate")
    return d.scored.select("player_level", guess.otherwise("novice").alias("predicted"))


@query(
    "accuracy",
    f"""with {LEVEL_SQL} select count(*) as rows,
      {mean("(case when player_level = predicted then 1 else 0 end)", 6)} as accuracy from p""",
)
def _(d):
    return V.accuracy(level_guess(d), "player_level", "predicted")


@query(
    "confusion_matrix",
    f"""with {LEVEL_SQL} select player_level, """
    + ", ".join(f"count(*) filter (predicted = '{c}') as predicted_{c}" for c in LEVELS)
    + " from p group by player_level",
)
def _(d):
    return V.confusion_matrix(level_guess(d), "player_level", "predicted", list(LEVELS))


@query(
    "classification_report",
    f"""with {LEVEL_SQL}, classes as (select player_level as class from p union select predicted from p),
    c as (select class, (select count(*) from p where player_level = class) as support,
        (select count(*) from p where predicted = class) as predicted,
        (select count(*) from p where player_level = class and p.predicted = class) as hits
      from classes),
    m as (select class, support, coalesce(hits / nullif(predicted, 0)::double, 0) as a,
      coalesce(hits / nullif(support, 0)::double, 0) as b from c)
    select class, {r("a", 6)} as precision, {r("b", 6)} as recall,
      {r("coalesce(a * b * 2.0::double / nullif(a + b, 0), 0)", 6)} as f1, support from m""",
)
def _(d):
    return V.classification_report(level_guess(d), "player_level", "predicted")


CHURN_SQL = """p as (select cast(total_games_played < 10 or total_wins / total_games_played::double < 0.2
      as int) as label, cast(round(cast(1 - engagement_level / 100 as decimal(28,6)), 4) as double)
      as score from scored)"""


def churn_guess(d):
    rate = ratio(F.col("total_wins"), F.col("total_games_played"))
    return d.scored.select(
        churn_rule(F.col("total_games_played"), rate).cast("int").alias("label"),
        rounded(F.lit(1.0) - F.col("engagement_level") / 100.0, 4).alias("score"),
    )


@query(
    "roc_curve",
    f"""with {CHURN_SQL}, t as (select score, sum(label) as pos, sum(1 - label) as neg from p group by score),
    c as (select score, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp,
      sum(pos) over () as pp, sum(neg) over () as nn from t)
    select score as threshold, {r("fp / nn::double", 6)} as fpr, {r("tp / pp::double", 6)} as tpr from c""",
)
def _(d):
    return V.roc_curve(churn_guess(d), "label", "score")


@query(
    "roc_auc",
    f"""with {CHURN_SQL}, t as (select score, sum(label) as pos, sum(1 - label) as neg from p group by score),
    c as (select *, coalesce(sum(neg) over (order by score rows between unbounded preceding
      and 1 preceding), 0) as below from t)
    select cast(sum(pos) as bigint) as positives, cast(sum(neg) as bigint) as negatives,
      {r("cast(sum(pos * (below * 2 + neg)) as double) / (cast(sum(pos) as double) * sum(neg) * 2)", 6)}
        as auc from c""",
)
def _(d):
    return V.roc_auc(churn_guess(d), "label", "score")


WIN_SQL = f"""g as (select game_id, {mean("win_probability", 4)} as predicted from scored group by game_id),
    p as (select win_probability as actual, predicted from scored join g using (game_id))"""


def win_guess(d):
    """Win probabilities next to the mean of the game as a plain prediction."""
    per_game = d.scored.groupBy("game_id").agg(
        rounded(exact_mean(F.col("win_probability")), 4).alias("predicted")
    )
    return d.scored.join(d.per_game(per_game), "game_id").select(
        F.col("win_probability").alias("actual"), "predicted"
    )


@query(
    "regression_metrics",
    f"""with {WIN_SQL}, s as (select count(*) as rows,
      cast(sum(cast((actual - predicted) * (actual - predicted) as decimal(28,6))) as double) as sse,
      cast(sum(cast(abs(actual - predicted) as decimal(28,6))) as double) as sae,
      var_pop(actual) as v from p)
    select rows, {r("sqrt(sse / rows)", 6)} as rmse, {r("sae / rows", 6)} as mae,
      {r("1.0::double - sse / (v * rows)", 6)} as r2 from s""",
)
def _(d):
    return V.regression_metrics(win_guess(d), "actual", "predicted")


@query(
    "prediction_histogram",
    f"""with {WIN_SQL}, l as (select 'actual' as series, actual as x from p
      union all select 'predicted', predicted from p),
    m as (select min(x) as low, max(x) as high from l)
    select series, cast(least(29, floor(cast((x - low) / ((high - low) / 30.0::double)
      as decimal(28,6)))) as int) as bin, count(*) as n
    from l cross join m group by all""",
)
def _(d):
    return V.histogram(win_guess(d), ["actual", "predicted"])
