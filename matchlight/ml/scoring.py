"""Batch scoring: fitted pipelines over stats rows, then post-processing and advice columns."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlight.functions import scoring as S
from matchlight.functions.numbers import clamp, rounded
from matchlight.ml.models import class_probability

HELPERS = (
    "label", "raw_features", "features", "fourier", "rawPrediction", "probability", "prediction",
    "gender_code", "country_code", "game_name_code", "player_level_code",
)


def _clean(df: DataFrame) -> DataFrame:
    return df.drop(*HELPERS, *[c for c in df.columns if c.endswith("_filled")])


def score_churn(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Churn yes/no with its probability and advice."""
    out = model.transform(rows)
    out = out.withColumns(
        {
            "churn_result": F.when(F.col("prediction") == 1, "Yes").otherwise("No"),
            "churn_probability": rounded(class_probability(), 6),
        }
    )
    return _clean(
        out.withColumn("churn_advice", S.churn_advice(F.col("churn_probability"), F.col("win_ratio")))
    )


def score_win(rows: DataFrame, model: PipelineModel, level: str | None = "intermediate") -> DataFrame:
    """Win probability in 0..1 and in percent. The level is a constant by default."""
    source = rows.withColumn("_level", F.col("player_level"))
    if level is not None:
        source = source.withColumn("player_level", F.lit(level))
    p = clamp(F.col("prediction"), 0.0, 1.0)
    out = model.transform(source).withColumn("win_prediction", rounded(p, 6))
    out = out.withColumns(
        {
            "win_percent": rounded(F.col("win_prediction") * 100.0, 1),
            "win_advice": S.win_advice(F.col("win_prediction"), F.col("player_level")),
        }
    )
    return _clean(out.withColumn("player_level", F.col("_level")).drop("_level"))


def score_win_binary(rows: DataFrame, model: PipelineModel) -> DataFrame:
    out = model.transform(rows)
    return _clean(out.withColumn("next_win_probability", rounded(class_probability(), 6)))


def score_engagement(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Forecast minutes as month and day text, raw minutes and advice."""
    minutes = F.greatest(F.col("prediction"), F.lit(0.0))
    return _clean(
        model.transform(rows).withColumns(
            {
                "monthly_forecast": S.hours_minutes(minutes, "month"),
                "daily_average": S.hours_minutes(minutes / 30.0, "day"),
                "engagement_minutes": rounded(F.col("prediction")),
                "engagement_advice": S.engagement_advice(F.col("prediction")),
            }
        )
    )


def score_level(rows: DataFrame, model: PipelineModel, labels: list[str]) -> DataFrame:
    """Predicted level with the confidence (largest class probability, where there is one)."""
    derived = rows.withColumn("win_ratio", S.win_ratio(F.col("total_wins"), F.col("total_games_played")))
    out = model.transform(derived)
    named = IndexToString(inputCol="prediction", outputCol="predicted_level", labels=labels).transform(out)
    if "probability" in out.columns:
        confidence = rounded(F.array_max(vector_to_array("probability")), 6)
    else:
        confidence = F.lit(None).cast("double")
    return _clean(
        named.withColumns(
            {
                "level_confidence": confidence,
                "skill_advice": S.skill_advice(F.col("predicted_level"), F.col("win_ratio")),
            }
        )
    )


def level_labels(model: PipelineModel) -> list[str]:
    """Class names in code order, from the label encoder at the front of the pipeline."""
    return list(model.stages[0].labels)


def score_all(rows: DataFrame, models: dict[str, PipelineModel], as_of, version: str) -> DataFrame:
    """All four predictions per row as one nested result with metadata."""
    out = score_churn(rows, models["churn"])
    out = score_win(out, models["win"])
    out = score_engagement(out, models["engagement"])
    out = score_level(out, models["level"], level_labels(models["level"]))
    stats = F.struct(
        F.col("total_games_played").alias("games_played"),
        F.col("win_ratio").alias("win_rate"),
        F.col("total_time_played_minutes").alias("total_playtime"),
    )
    return out.select(
        "player_id",
        "game_id",
        F.struct(
            F.struct("churn_result", "churn_probability", "churn_advice").alias("churn_prediction"),
            F.struct("win_prediction", "win_percent", "win_advice").alias("win_probability"),
            F.struct(
                "monthly_forecast", "daily_average", "engagement_minutes", "engagement_advice"
            ).alias("engagement_prediction"),
            F.struct(
                "predicted_level", "level_confidence", stats.alias("current_stats"), "skill_advice"
            ).alias("skill_assessment"),
        ).alias("predictions"),
        F.struct(
            F.lit(version).alias("model_version"),
            F.lit(str(as_of)).alias("timestamp"),
            F.lit("comprehensive").alias("analysis_type"),
        ).alias("metadata"),
    )
