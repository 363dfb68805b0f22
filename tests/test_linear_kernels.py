"""Linear grids from fold sums and kernel machines."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from matchlight.ml import kernels as K
from matchlight.ml import linear as L


@pytest.fixture(scope="module")
def lines(spark):
    draw = np.random.default_rng(1)
    x = draw.standard_normal((300, 5)) * [1, 2, 0.5, 3, 1] + [0, 5, 0, -2, 1]
    x[:, 4] = 2.0  # a constant feature
    y = x @ [3, 0, -2, 0.5, 1] + 10 + draw.standard_normal(300)
    rows = [(Vectors.dense(a), float(b), int(i % 4)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["features", "label", "fold"]).repartition(3)


@pytest.mark.parametrize("point", [(0.0, 0.0), (0.1, 0.0), (2.0, 0.0), (0.05, 1.0), (0.5, 1.0), (0.3, 0.4)])
def test_coefficients_and_scores_equal_sparks(lines, point):
    got = L.grid(lines, [point])[0]
    spark_model = LinearRegression(regParam=point[0], elasticNetParam=point[1], tol=1e-12, maxIter=1000)
    whole = spark_model.fit(lines)
    assert np.abs(np.array(got.coefficients) - whole.coefficients.toArray()).max() < 1e-6
    assert got.intercept == pytest.approx(whole.intercept, abs=1e-6)
    r2 = [spark_model.fit(lines.where(F.col("fold") != f)).evaluate(lines.where(F.col("fold") == f)).r2 for f in range(2)]
    mine = L.fold_products(lines)
    total = sum(mine.values())
    assert [L.judged(mine[f], *L.solve(total - mine[f], *point))[0] for f in range(2)] == pytest.approx(r2, abs=1e-6)


@pytest.fixture(scope="module")
def circles(spark):
    draw = np.random.default_rng(2)
    angle, inner = draw.uniform(0, 2 * np.pi, 1200), draw.random(1200) < 0.5
    r = np.where(inner, 0.8, 1.8) + 0.15 * draw.standard_normal(1200)
    rows = [(Vectors.dense([a, b]), float(c), 1.0) for a, b, c in zip(r * np.cos(angle), r * np.sin(angle), inner)]
    return spark.createDataFrame(rows, ["features", "label", "weight"])


def test_only_the_kernel_machine_separates_circles(circles, tmp_path):
    train, test = circles.randomSplit([0.5, 0.5], 3)

    def accuracy(model):
        return model.transform(test).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]

    kernel = Pipeline(stages=[K.FourierFeatures(), K.CalibratedSVC(weightCol="weight")]).fit(train)
    assert accuracy(LinearSVC().fit(train)) < 0.7 and accuracy(kernel) > 0.9
    kernel.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    told = [[tuple(r.probability) for r in m.transform(test).collect()] for m in (kernel, again)]
    assert told[0] == told[1]


def test_probabilities_are_calibrated(spark):
    draw = np.random.default_rng(4)
    x = draw.uniform(-2, 2, (3000, 2))
    p = 1 / (1 + np.exp(-3 * (np.hypot(x[:, 0], x[:, 1]) - 1.2)))
    rows = [(Vectors.dense(a), float(b)) for a, b in zip(x, draw.random(3000) < p)]
    train, test = spark.createDataFrame(rows, ["features", "label"]).randomSplit([0.6, 0.4], 5)
    out = Pipeline(stages=[K.FourierFeatures(), K.CalibratedSVC()]).fit(train).transform(test)
    got = np.array([(r.probability[1], r.label) for r in out.select("probability", "label").collect()])
    for low in (0.0, 0.5):
        part = got[(got[:, 0] >= low) & (got[:, 0] <= low + 0.5)]
        assert abs(part[:, 0].mean() - part[:, 1].mean()) < 0.05


def test_products_come_near_the_kernel(spark):
    rows = spark.createDataFrame([(Vectors.dense([i / 3, (i % 4) / 2]),) for i in range(12)], ["features"])
    out = K.FourierFeatures(size=4096, gamma=0.7).transform(rows).collect()
    x, z = (np.array([r[c].toArray() for r in out]) for c in ("features", "fourier"))
    want = np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 0.06
