"""Ridge and lasso grids from one pass over the rows.

The pass gathers, for every fold, the products of (1, features, label) with themselves. The sums of a
training side are the total less one fold, so every point of the grid for every fold is solved, and its R2
and RMSE on the fold left out computed, from small matrices; no row is read again.

Objective and scaling are those of Spark's ``LinearRegression``: squared error / 2n plus
regParam (elasticNet |w| + (1 - elasticNet) / 2 w^2) on features and label of deviation 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlight.session import ship_code

STEPS, TOLERANCE = 10_000, 1e-12


def fold_products(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per fold the sum of z z' with z = (1, features, label), of rows (features, label, fold)."""
    ship_code(rows.sparkSession)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for fold, part in frame.groupby("fold"):
                x = np.stack(part["x"])
                z = np.hstack([np.ones((len(x), 1)), x, part["label"].to_numpy()[:, None]])
                total[fold] = total.get(fold, 0.0) + z.T @ z
        yield pd.DataFrame({"fold": list(total), "data": [t.tobytes() for t in total.values()]}).astype({"fold": "int32"})

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for fold, data in zip(frame["fold"], frame["data"]):
                total[fold] = total.get(fold, 0.0) + np.frombuffer(data)
        yield pd.DataFrame({"fold": list(total), "data": [t.tobytes() for t in total.values()]}).astype({"fold": "int32"})

    source = rows.select(F.col("fold").cast("int").alias("fold"), F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))
    parts = source.mapInPandas(sums, "fold int, data binary").repartition("fold").sortWithinPartitions("fold", "data")
    out = {}
    for r in parts.mapInPandas(added, "fold int, data binary").collect():
        flat = np.frombuffer(r["data"])
        out[r["fold"]] = flat.reshape(int(np.sqrt(len(flat))), -1)
    return out


def solve(products: np.ndarray, reg: float, elastic: float) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) for a point of the grid."""
    n = products[0, 0]
    mean = products[0] / n
    cov = products / n - np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(cov), 0.0))
    used = np.flatnonzero(deviation[1:-1] > 1e-12 * np.maximum(1.0, np.abs(mean[1:-1]))) + 1
    w = np.zeros(len(products) - 2)
    if deviation[-1] == 0 or not len(used):
        return mean[-1], w
    a = cov[np.ix_(used, used)] / np.outer(deviation[used], deviation[used])
    b = cov[used, -1] / (deviation[used] * deviation[-1])
    l1, l2 = (reg / deviation[-1] * share for share in (elastic, 1 - elastic))
    if l1 == 0:
        scaled = np.linalg.lstsq(a + l2 * np.eye(len(used)), b, rcond=None)[0]
    else:
        scaled = np.zeros(len(used))
        for _ in range(STEPS):
            before = scaled.copy()
            for j in range(len(used)):
                rest = b[j] - a[j] @ scaled + a[j, j] * scaled[j]
                scaled[j] = np.sign(rest) * max(abs(rest) - l1, 0.0) / (a[j, j] + l2)
            if np.abs(scaled - before).max() < TOLERANCE:
                break
    w[used - 1] = scaled * deviation[-1] / deviation[used]
    return float(mean[-1] - mean[1:-1] @ w), w


def judged(products: np.ndarray, intercept: float, w: np.ndarray) -> tuple[float, float]:
    """(R2, RMSE) of a line on rows given by their products."""
    v = np.concatenate([[-intercept], -w, [1.0]])
    n, total = products[0, 0], products[-1, -1] - products[0, -1] ** 2 / products[0, 0]
    errors = max(float(v @ products @ v), 0.0)
    return 1 - errors / total if total > 0 else float("nan"), float(np.sqrt(errors / n))


@dataclass(frozen=True)
class Point:
    reg: float
    elastic: float
    r2: float  # means over the folds
    r2_spread: float
    rmse: float
    intercept: float  # of all rows
    coefficients: tuple[float, ...]


def grid(rows: DataFrame, points: list[tuple[float, float]]) -> list[Point]:
    """Every (regParam, elasticNet) of ``points`` cross-validated over the folds of rows (features, label, fold)."""
    of_fold = fold_products(rows)
    whole = sum(of_fold.values())
    out = []
    for reg, elastic in points:
        scores = [judged(p, *solve(whole - p, reg, elastic)) for _, p in sorted(of_fold.items())]
        r2, rmse = np.array(scores).T
        intercept, w = solve(whole, reg, elastic)
        out.append(Point(reg, elastic, float(r2.mean()), float(r2.std()), float(rmse.mean()), intercept, tuple(w)))
    return out
