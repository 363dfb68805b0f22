"""Training: one pipeline per model, chosen by cross-validation on repeatable folds.

Encoders, scaler and estimator live in one PipelineModel, so what is saved is what is scored.
Scaling inside a pipeline uses the sample deviation; it differs from the population one by a
constant factor close to 1 and matters to none of the models here.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import (
    Imputer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlight.functions.identifiers import key_hash, pair_key
from matchlight.functions.numbers import rounded
from matchlight.ml.boosting import Boosting
from matchlight.ml.kernels import CalibratedSVC, FourierFeatures
from matchlight.ml.targets import Target
from matchlight.operators import features as X
from matchlight.operators.neighbors import smote
from matchlight.session import side_by_side, stored

SEED = 42
WEIGHT = "class_weight"


@dataclass(frozen=True)
class Size:
    """How much work a training run does."""

    trees: int = 100
    rounds: int = 100
    depth: int = 5
    folds: int = 5
    iterations: int = 100
    parallelism: int = 4


def feature_stages(target: Target) -> list:
    """Fill missing numbers with the training mean, encode, assemble in fixed order, scale.

    Unseen and missing categories get a code of their own, so no row is lost at training or scoring.
    """
    filled = [f"{c}_filled" for c in target.numeric]
    coded = [f"{c}_code" for c in target.categorical]
    stages = [Imputer(strategy="mean", inputCols=list(target.numeric), outputCols=filled)]
    if coded:
        stages.append(
            StringIndexer(
                inputCols=list(target.categorical),
                outputCols=coded,
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            )
        )
    assembler = VectorAssembler(inputCols=[*filled, *coded], outputCol="raw_features")
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)
    return [*stages, assembler, scaler]


def feature_names(target: Target) -> list[str]:
    return [*target.numeric, *target.categorical]


def label_stage(target: Target) -> list:
    if target.kind != "multiclass":
        return []
    return [
        StringIndexer(
            inputCol=target.label,
            outputCol="label",
            stringOrderType="alphabetAsc",
            handleInvalid="keep",
        )
    ]


def estimator(target: Target, model: str, size: Size = Size()) -> list:
    """The stages of one model by name.

    ``svm`` works on random Fourier features: a linear support vector machine with calibrated probabilities for two
    classes, multinomial logistic regression for more (a kernel machine of one loss for all classes), and
    for regression a linear model with the robust Huber loss.
    """
    common = {"featuresCol": "features", "labelCol": "label"}
    weighted = {"weightCol": WEIGHT} if target.kind != "regression" else {}
    tree = {"maxDepth": size.depth, "seed": SEED, "maxBins": 512}
    steps = {"maxIter": size.iterations}
    fourier = FourierFeatures(inputCol="features", outputCol="fourier", seed=SEED)
    on_fourier = {"featuresCol": "fourier", "labelCol": "label"}
    if target.kind == "regression":
        linear = {
            "linear": {},
            "ridge": {"regParam": 0.1, "elasticNetParam": 0.0},
            "lasso": {"regParam": 0.1, "elasticNetParam": 1.0},
        }
        if model in linear:
            return [LinearRegression(**common, **steps, **linear[model])]
        if model == "random_forest":
            return [RandomForestRegressor(**common, **tree, numTrees=size.trees)]
        if model == "gradient_boosting":
            return [Boosting(**common, loss="squared", rounds=size.rounds, depth=size.depth)]
        if model == "svm":
            return [fourier, LinearRegression(**on_fourier, **steps, loss="huber", regParam=0.01)]
    else:
        many = target.kind == "multiclass"
        if model == "random_forest":
            return [RandomForestClassifier(**common, **weighted, **tree, numTrees=size.trees)]
        if model == "logistic":
            return [LogisticRegression(**common, **weighted, **steps, regParam=0.01)]
        if model == "gradient_boosting":
            loss = "softmax" if many else "logistic"
            return [Boosting(**common, **weighted, loss=loss, rounds=size.rounds, depth=size.depth)]
        if model == "svm":
            if many:
                return [fourier, LogisticRegression(**on_fourier, **weighted, **steps, regParam=0.001)]
            return [fourier, CalibratedSVC(**on_fourier, **weighted, **steps)]
    raise ValueError(f"no model {model} for a {target.kind} target")


def prepare(rows: DataFrame, target: Target, folds: int) -> DataFrame:
    """Keep the needed columns, add label, class weight, fold and train flag, and store the result.

    Folds are stratified by class for classifiers and follow a hash of the player for regressors.
    """
    needed = ["player_id", "game_id", *feature_names(target), target.label]
    # Only a row without a label teaches nothing.
    base = rows.select(*dict.fromkeys(needed)).na.drop(subset=[target.label])
    base = base.withColumns({c: F.col(c).cast("double") for c in target.numeric if c != target.label})
    if target.kind != "multiclass":
        base = base.withColumn("label", F.col(target.label).cast("double"))
    base = X.hash_split(base, F.col("player_id"))
    if target.kind == "regression":
        fold = F.pmod(key_hash(F.col("player_id")), F.lit(folds)).cast("int")
        return stored(base.withColumn("fold", fold), f"train-{target.name}")
    weights = X.class_weights(base.filter("is_train"), target.label).select(
        target.label, F.col("weight").alias(WEIGHT)
    )
    # One row per class: far below any broadcast bound.
    weighted = base.join(F.broadcast(weights), target.label, "left").na.fill(1.0, [WEIGHT])
    kept = stored(weighted, f"weighted-{target.name}")
    dealt = X.stratified_folds(kept, target.label, ["player_id", "game_id"], folds)
    return stored(dealt, f"train-{target.name}")


def evaluator(target: Target):
    if target.kind == "regression":
        return RegressionEvaluator(metricName=target.metric)
    return MulticlassClassificationEvaluator(metricName=target.metric)


@dataclass
class Trained:
    target: Target
    best: str
    model: PipelineModel
    models: dict[str, PipelineModel]
    scores: list[tuple[str, float, float, float, float | None, float | None]]

    def table(self, spark: SparkSession) -> DataFrame:
        """Model, mean and spread of the fold scores, hold-out score, and RMSE and MAE where the label is a number."""
        return spark.createDataFrame(
            [(self.target.name, *row, row[0] == self.best) for row in self.scores],
            "target string, model string, cv_mean double, cv_2std double, holdout double, holdout_rmse double, "
            "holdout_mae double, best boolean",
        )


def train(
    rows: DataFrame,
    target: Target,
    models: tuple[str, ...] | None = None,
    size: Size = Size(),
    balance: bool = False,
    grid: dict[str, dict[str, list]] | None = None,
) -> Trained:
    """Fit the candidate models, score each by cross-validation and on the hold-out rows, and keep
    the one with the best mean. ``balance`` adds synthetic minority rows to the training side."""
    data = prepare(rows, target, size.folds)
    train_rows, test_rows = data.filter("is_train"), data.filter("NOT is_train")
    shared = Pipeline(stages=[*label_stage(target), *feature_stages(target)]).fit(train_rows)
    ready = shared.transform(train_rows)
    if balance:
        ready = with_synthetic(ready, target)
    keep = ["label", "features", "fold"] + ([WEIGHT] if target.kind != "regression" else []) + (["real"] if balance else [])
    ready = stored(ready.select(*keep), f"ready-{target.name}")
    judge = evaluator(target)
    fold_judge = judge.copy({judge.weightCol: "real"}) if balance else judge

    def candidate(name: str) -> tuple[PipelineModel, tuple]:
        fit_stages, mean, spread = validate(ready, estimator(target, name, size), (grid or {}).get(name, {}), fold_judge, size)
        whole = PipelineModel(stages=[*shared.stages, *fit_stages])
        return whole, (name, mean, 2 * spread, *holdout(whole.transform(test_rows), judge, target))

    names = models or target.models
    done = side_by_side(rows.sparkSession, [partial(candidate, name) for name in names], size.parallelism)
    fitted, scores = {name: whole for name, (whole, _) in zip(names, done)}, [score for _, score in done]
    winner = max(scores, key=lambda row: row[1])[0]
    return Trained(target, winner, fitted[winner], fitted, scores)


def holdout(scored: DataFrame, judge, target: Target) -> tuple[float, float | None, float | None]:
    """The target's metric on hold-out rows and, for regression, RMSE and MAE from the same pass."""
    if target.kind != "regression":
        return float(judge.evaluate(scored)), None, None
    error = F.col("prediction") - F.col("label")
    n, squares, absolute, spread = scored.agg(F.count("*"), F.sum(error * error), F.sum(F.abs(error)), F.var_pop("label")).first()
    if not n or not spread:
        return float("nan"), None, None
    return 1 - squares / (n * spread), float(np.sqrt(squares / n)), absolute / n


def validate(ready: DataFrame, stages: list, grid: dict[str, list], judge, size: Size) -> tuple[list, float, float]:
    """The stages fitted to all rows with the best point of a grid, and the mean and deviation of its fold scores."""
    if isinstance(stages[-1], Boosting):
        # Its folds grow beside the whole model, and points that differ in the number of rounds only are one run.
        points = [stages[-1].copy(point) for point in _grid(stages, grid)]
        runs: dict[tuple, list[int]] = {}
        for i, p in enumerate(points):
            runs.setdefault((p.getOrDefault(p.depth), p.getOrDefault(p.rate)), []).append(i)

        def run(which: list[int]) -> list[tuple]:
            counts = [points[i].getOrDefault(points[i].rounds) for i in which]
            return list(zip(which, points[which[0]].staged(ready, size.folds, counts)))

        made = side_by_side(ready.sparkSession, [partial(run, which) for which in runs.values()], size.parallelism)
        found = [result for _, result in sorted((pair for pairs in made for pair in pairs), key=lambda pair: pair[0])]
        best = max(range(len(found)), key=lambda i: float(np.mean(found[i][1])))
        model, scores = found[best]
        return [model], float(np.mean(scores)), float(np.std(scores))
    validated = CrossValidator(
        estimator=Pipeline(stages=stages),
        estimatorParamMaps=_grid(stages, grid),
        evaluator=judge,
        numFolds=size.folds,
        foldCol="fold",
        parallelism=size.parallelism,
        seed=SEED,
    ).fit(ready)
    best = max(range(len(validated.avgMetrics)), key=validated.avgMetrics.__getitem__)
    return validated.bestModel.stages, float(validated.avgMetrics[best]), float(validated.stdMetrics[best])


def _grid(stages: list, values: dict[str, list]):
    builder = ParamGridBuilder()
    for name, options in values.items():
        builder = builder.addGrid(stages[-1].getParam(name), options)
    return builder.build()


def fit_one(rows: DataFrame, target: Target, model: str, size: Size = Size()) -> PipelineModel:
    """Fit one model on the training rows without cross-validation."""
    data = prepare(rows, target, size.folds).filter("is_train")
    stages = [*label_stage(target), *feature_stages(target), *estimator(target, model, size)]
    return Pipeline(stages=stages).fit(data)


def fit_many(rows: DataFrame, target: Target, models: tuple[str, ...], size: Size = Size()) -> dict[str, PipelineModel]:
    """The models ``fit_one`` gives, from training rows prepared and encoded once."""
    data = prepare(rows, target, size.folds).filter("is_train")
    shared = Pipeline(stages=[*label_stage(target), *feature_stages(target)]).fit(data)
    keep = ["label", "features"] + ([WEIGHT] if target.kind != "regression" else [])
    ready = stored(shared.transform(data).select(*keep), f"ready-{target.name}")

    def fitted(name: str) -> PipelineModel:
        model = Pipeline(stages=estimator(target, name, size)).fit(ready)
        return PipelineModel(stages=[*shared.stages, *model.stages])

    return dict(zip(models, side_by_side(rows.sparkSession, [partial(fitted, m) for m in models], size.parallelism)))


def with_synthetic(ready: DataFrame, target: Target) -> DataFrame:
    """Add synthetic rows of the smaller class until both are about equal.

    A synthetic row lies between two rows of one fold and belongs to it, so a fold's training rows do not depend on
    the rows held out from it. The fold, times more than the spread of the features, is one more coordinate of the
    neighbour search, which therefore looks into the own fold first. Where that holds fewer rows than neighbours are
    asked for, a neighbour of another fold is passed over and the row itself is repeated. ``real`` is 1 for
    given and 0 for synthetic rows; only given rows are judged.
    """
    given = ready.withColumn("real", F.lit(1.0))
    sizes = ready.groupBy("label").agg(F.count("*").alias("n")).collect()
    counts = {row["label"]: row["n"] for row in sizes}
    if len(counts) != 2:
        return given
    small = min(counts, key=lambda c: (counts[c], c))
    large = max(counts.values())
    copies = large / counts[small] - 1
    if copies == 0:
        return given
    keyed = ready.withColumn("row_id", pair_key(F.col("player_id"), F.col("game_id")))
    minority = keyed.filter(F.col("label") == small).withColumn("own", vector_to_array("features"))
    square = F.aggregate("own", F.lit(0.0), lambda a, x: a + x * x)
    apart = 1.0 + 4.0 * float(np.sqrt(minority.agg(F.max(square)).first()[0]))  # over twice what lies between two rows
    side = F.col("fold") * F.lit(apart)
    made = smote(minority.select("row_id", F.array_append("own", side).alias("vec")), "row_id", copies)
    origin = minority.select("row_id", "label", "fold", WEIGHT, "own")
    inside = F.element_at("vec", -1) == side
    between = F.when(inside, F.slice("vec", F.lit(1), F.size("own"))).otherwise(F.col("own"))
    synthetic = made.join(origin, "row_id").select(
        "label", array_to_vector(between).alias("features"), "fold", WEIGHT, F.lit(0.0).alias("real")
    )
    both = given.select("label", "features", "fold", WEIGHT, "real").unionByName(synthetic)
    return both.withColumn(WEIGHT, F.lit(1.0))  # balanced rows need no class weight


def importances(trained_model: PipelineModel, target: Target) -> list[tuple[str, float]]:
    """Feature importances of a tree model, largest first."""
    values = trained_model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(feature_names(target), values), key=lambda x: (-x[1], x[0]))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def class_probability(column: str = "probability", index: int = 1):
    return F.get(vector_to_array(column), F.lit(index))


def class_shares(out: DataFrame, classes: int):
    """Probabilities of all classes from a model's output.

    A model without probabilities gives the logistic of its margins, divided by their sum.
    """
    if "probability" in out.columns:
        return F.slice(vector_to_array("probability"), 1, classes)
    margins = F.slice(vector_to_array("rawPrediction"), 1, classes)
    odds = F.transform(margins, lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(-m)))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    return F.transform(odds, lambda x: x / total)


def soft_vote(
    rows: DataFrame, models: dict[str, PipelineModel], target: Target, labels: list[str] | None = None
) -> DataFrame:
    """Mean probability of every class over several classifiers of one target, and the winner.

    ``labels`` names the classes of a target with more than two, in code order. ``probability`` is
    that of class 1 for two classes, that of the winning class otherwise; the first of equals wins.
    """
    classes = len(labels) if labels else 2
    current = rows.select("player_id", "game_id", *dict.fromkeys([*feature_names(target), target.label]))
    kept = list(current.columns)
    parts = []
    for name, model in sorted(models.items()):
        out = model.transform(current)
        parts.append(f"p_{name}")
        current = out.select(*kept, class_shares(out, classes).alias(parts[-1]))
        kept = list(current.columns)
    mean = F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda i: rounded(sum((F.get(F.col(p), i) for p in parts), F.lit(0.0)) / F.lit(float(len(parts))), 6),
    )
    voted = current.withColumn("probabilities", mean)
    winner = (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int")
    if labels is None:
        return voted.withColumn("probability", F.get("probabilities", F.lit(1))).withColumn(
            "prediction", (F.col("probability") >= 0.5).cast("int")
        )
    return voted.withColumn("probability", F.array_max("probabilities")).withColumn(
        "prediction", F.get(F.array(*[F.lit(x) for x in labels]), winner)
    )
