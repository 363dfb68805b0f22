"""The prediction targets: features, labels and candidate models of each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlight.domain import Domain
from matchlight.functions import scoring as S
from matchlight.functions.numbers import fractional_days_since, ratio

CATEGORIES = ("gender", "country", "game_name")


@dataclass(frozen=True)
class Target:
    """What to predict from what. Scoring uses the same lists, so the two cannot drift apart."""

    name: str
    label: str
    kind: str  # binary, multiclass or regression
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = CATEGORIES
    models: tuple[str, ...] = field(default=())

    @property
    def metric(self) -> str:
        return {"binary": "accuracy", "multiclass": "accuracy", "regression": "r2"}[self.kind]


CLASSIFIERS = ("random_forest", "gradient_boosting", "logistic", "svm")
REGRESSORS = ("random_forest", "gradient_boosting", "linear", "svm")

CHURN = Target(
    "churn",
    "is_churned",
    "binary",
    ("total_games_played", "win_ratio", "total_time_played_minutes", "total_moves", "age"),
    models=CLASSIFIERS,
)
WIN = Target(
    "win",
    "win_probability",
    "regression",
    ("total_games_played", "total_moves", "total_wins", "total_losses", "age"),
    ("player_level", *CATEGORIES),
    REGRESSORS,
)
# The same five features at training and at scoring time.
WIN_BINARY = Target(
    "win_binary",
    "next_game_win",
    "binary",
    (
        "avg_session_duration",
        "historical_win_rate",
        "avg_moves_per_game",
        "games_experience",
        "age",
    ),
    (),
    ("gradient_boosting",),
)
WIN_BINARY_GAMES = Target(
    "win_binary_games",
    "next_game_win",
    "binary",
    (
        "avg_session_duration",
        "historical_win_rate",
        "avg_moves_per_game",
        "game_avg_win_rate",
        "age",
    ),
    ("game_name",),
    ("gradient_boosting",),
)
ENGAGEMENT = Target(
    "engagement",
    "total_time_played_minutes",
    "regression",
    ("total_games_played", "win_ratio", "age"),
    models=(*REGRESSORS, "ridge", "lasso"),
)
SESSION = Target(
    "session",
    "avg_session_duration",
    "regression",
    (
        "age",
        "total_games_played",
        "win_ratio",
        "rating",
        "avg_moves_per_game",
        "games_per_day",
        "days_since_last_play",
    ),
    ("game_name",),
    REGRESSORS,
)
FUTURE = Target(
    "future",
    "future_engagement",
    "regression",
    (
        "avg_session_duration",
        "historical_win_rate",
        "avg_moves_per_game",
        "total_games_played",
        "age",
        "total_time_played_minutes",
    ),
    (),
    REGRESSORS,
)
LEVEL = Target(
    "level",
    "player_level",
    "multiclass",
    (
        "total_games_played",
        "total_moves",
        "total_wins",
        "total_losses",
        "win_ratio",
        "total_time_played_minutes",
        "age",
    ),
    models=CLASSIFIERS,
)
TARGETS = {
    t.name: t
    for t in (CHURN, WIN, WIN_BINARY, WIN_BINARY_GAMES, ENGAGEMENT, SESSION, FUTURE, LEVEL)
}


def training_rows(d: Domain) -> DataFrame:
    """One row per player and game with every feature and label of every target."""
    d = d.rolled_up()  # read for the rows, for the games' means and for the overall mean
    g, w = F.col("total_games_played"), F.col("total_wins")
    t, days = F.col("total_time_played_minutes"), fractional_days_since(F.col("last_played"), d.as_of)
    rate: Column = ratio(w, g)
    rows = d.star.filter((g > 0) & (t > 0)).withColumns(
        {
            "avg_session_duration": ratio(t, g),
            "historical_win_rate": rate,
            "avg_moves_per_game": ratio(F.col("total_moves"), g),
            "games_experience": F.log1p(g),
            "days_since_last_play": days,
            "games_per_day": ratio(g, days + 1),
            "future_engagement": S.future_engagement(g, w, t, F.col("age")),
            # The rule label: inactivity would be known, not predicted, from last_played.
            "is_churned": S.churn_rule(g, rate).cast("int"),
        }
    )
    per_game = d.stats.groupBy("game_id").agg(F.avg(rate).alias("game_avg_win_rate"))
    overall = d.stats.agg(F.avg(rate)).scalar()
    return (
        rows.join(d.per_game(per_game), "game_id", "left")
        .withColumn("_overall", overall)
        .withColumn("next_game_win", (F.col("historical_win_rate") > F.col("_overall")).cast("int"))
        .drop("_overall")
    )
