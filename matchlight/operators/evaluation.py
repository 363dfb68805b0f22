"""Model evaluation as aggregates over (label, prediction) or (label, score) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlight.functions.numbers import exact, exact_mean, ratio, rounded
from matchlight.operators.ordered import accumulate, with_ranges
from matchlight.session import stored


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("int")
    return df.agg(F.count("*").alias("rows"), rounded(exact_mean(hit), 6).alias("accuracy"))


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: list) -> DataFrame:
    """One row per true class, one count column per predicted class."""
    counts = df.groupBy(label).pivot(prediction, classes).agg(F.count(F.lit(1)))
    return counts.select(
        label, *[F.coalesce(F.col(str(c)), F.lit(0)).cast("bigint").alias(f"predicted_{c}") for c in classes]
    )


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, f1 and support per class; 0 where a ratio is undefined."""
    pair = F.array(
        F.struct(F.col(label).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")),
        F.struct(F.col(prediction).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")),
    )
    cells = df.groupBy(label, prediction).agg(F.count("*").alias("n"))
    hit = F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0)
    per_class = (
        cells.select("n", hit.alias("hit"), F.inline(pair))
        .groupBy("class")
        .agg(
            F.sum(F.col("n") * F.col("t")).alias("support"),
            F.sum(F.col("n") * F.col("p")).alias("predicted"),
            F.sum(F.col("hit") * F.col("t")).alias("hits"),
        )
    )

    def share(top: Column, bottom: Column) -> Column:
        return F.coalesce(ratio(top, bottom), F.lit(0.0))

    precision = share(F.col("hits"), F.col("predicted"))
    recall = share(F.col("hits"), F.col("support"))
    return per_class.select(
        "class",
        rounded(precision, 6).alias("precision"),
        rounded(recall, 6).alias("recall"),
        rounded(share(precision * recall * 2.0, precision + recall), 6).alias("f1"),
        F.col("support").cast("bigint").alias("support"),
    )


def _score_totals(df: DataFrame, label: str, score: str, descending: bool) -> DataFrame:
    """Positives and negatives per distinct score, with running and total counts."""
    positive = F.col(label).cast("int")
    per_score = df.groupBy(exact(F.col(score)).alias("_score")).agg(
        F.sum(positive).cast("bigint").alias("pos"),
        F.sum(1 - positive).cast("bigint").alias("neg"),
    )
    order = F.desc("_score") if descending else F.asc("_score")
    kept = stored(per_score, "score-counts")
    ranged = with_ranges(kept, "_score").withColumn("_all", F.lit(1))
    return accumulate(ranged, ["_all"], [order], ["pos", "neg"], descending).drop("_all")


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """True and false positive rate at every distinct threshold."""
    return _score_totals(df, label, score, descending=True).select(
        F.col("_score").cast("double").alias("threshold"),
        rounded(ratio(F.col("neg_upto"), F.col("neg_total")), 6).alias("fpr"),
        rounded(ratio(F.col("pos_upto"), F.col("pos_total")), 6).alias("tpr"),
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve: the share of (positive, negative) pairs in the right order.

    Counted from running totals; ties count half.
    """
    totals = _score_totals(df, label, score, descending=False)
    below = F.col("neg_upto") - F.col("neg")
    wins = F.col("pos") * (below * 2 + F.col("neg"))
    return totals.agg(
        F.sum(wins.cast("decimal(38,0)")).alias("w"),
        F.max("pos_total").alias("p"),
        F.max("neg_total").alias("n"),
    ).select(
        F.col("p").alias("positives"),
        F.col("n").alias("negatives"),
        rounded(
            F.try_divide(F.col("w").cast("double"), F.col("p").cast("double") * F.col("n") * 2.0), 6
        ).alias("auc"),
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """RMSE, MAE and R2 in one pass."""
    y = F.col(actual).cast("double")
    error = y - F.col(predicted).cast("double")
    sums = df.agg(
        F.count("*").alias("rows"),
        F.sum(exact(error * error)).cast("double").alias("sse"),
        F.sum(exact(F.abs(error))).cast("double").alias("sae"),
        F.var_pop(y).alias("v"),
    )
    n = F.col("rows").cast("double")
    return sums.select(
        "rows",
        rounded(F.sqrt(F.col("sse") / n), 6).alias("rmse"),
        rounded(F.col("sae") / n, 6).alias("mae"),
        rounded(F.lit(1.0) - ratio(F.col("sse"), F.col("v") * n), 6).alias("r2"),
    )


def histogram(df: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """Counts per bin for several columns over their common range."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("x")) for c in columns]
    )
    long = df.select(F.inline(pairs)).filter("x is not null")
    limits = long.agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high"))).scalar()
    width = (F.col("l.high") - F.col("l.low")) / F.lit(float(bins))
    position = F.floor(exact(F.try_divide(F.col("x") - F.col("l.low"), width)))
    return (
        long.withColumn("l", limits)
        .withColumn("bin", F.least(F.lit(bins - 1), F.coalesce(position, F.lit(0))).cast("int"))
        .groupBy("series", "bin")
        .agg(F.count("*").alias("n"))
    )
