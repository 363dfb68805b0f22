"""Whitening of vectors by shifted Cholesky QR.

A pass sums the Gram matrix of the centred rows, as the factors found so far leave them. Its
Cholesky factor, of the shifted matrix in the first pass, is the next triangle; every row is solved
against the triangles in turn, so no inverse is formed. After a few passes the rows are
orthonormal, and the product of the triangles is the R of a QR factorisation of the whole table.
The singular values and right vectors of that small matrix give variances and directions.

The driver and the broadcasts hold a few matrices of dimension x dimension, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlight.llm.text import prepare, with_fields
from matchlight.llm.wholes import matrix, whole_numbers
from matchlight.session import stored

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
PASSES = 5  # Gram passes at most; three do unless columns depend on each other
RANK = 1e-12  # a component with less than this share of the largest variance has none
LOW_BITS = 26
LONG = 2**63 - 1
ROWS = 4096


@dataclass
class Whitening:
    n: int
    sums: list[int]  # exact, per dimension
    factors: list[np.ndarray]  # triangles in the order of the passes
    variances: np.ndarray  # falling
    directions: np.ndarray  # a column per component
    total: float  # the trace of the covariance

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.total


class Centre:
    """Rows less their mean. Whole parts go first, so what is left has all its digits."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = [s // n for s in sums]
        self.rest = [s - n * w for s, w in zip(sums, self.whole)]

    def shifted(self, data) -> np.ndarray:
        return matrix(data) - np.array(self.whole, dtype=np.int64)

    def rows(self, data) -> np.ndarray:
        return self.shifted(data) - np.array(self.rest, dtype=np.float64) / self.n

    def deviations(self, data) -> list[int | None]:
        """sum((n * x - S)^2) of every row, exact; None beyond a long."""
        x = self.shifted(data)
        most = self.n * (int(np.abs(x).max(initial=0)) + 1)
        if x.shape[1] * most**2 <= LONG:
            off = self.n * x - np.array(self.rest, dtype=np.int64)
            return (off * off).sum(axis=1).tolist()
        off = self.n * x.astype(object) - np.array(self.rest, dtype=object)
        return [d if d <= LONG else None for d in (off * off).sum(axis=1).tolist()]


def solve(rows: np.ndarray, triangle: np.ndarray) -> np.ndarray:
    """The rows q with q @ triangle = rows, for an upper triangle, column by column."""
    out = np.empty_like(rows)
    for j in range(triangle.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ triangle[:j, j]) / triangle[j, j]
    return out


def valid_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x): the vectors that take part, as whole numbers.

    Vectors that are NULL or empty or hold NULL or non-finite components are dropped, and so are those of
    another length than the most frequent one (of equally frequent lengths, the greatest stays).
    """
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    x = whole_numbers(F.col("vector"), scale, offset)
    rows = stored(source.select("vec_id", x.alias("x")).where("x is not null"), "whole")
    lengths = rows.groupBy(F.length("x").alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes")).first()
    return rows.where(F.length("x") == (lengths["bytes"] if lengths else 0))


def blocks(frames: Iterator[pd.DataFrame], rows: int = ROWS) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    for frame in frames:
        held.extend(frame["x"])
        if len(held) >= rows:
            yield held
            held = []
    if held:
        yield held


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, parts = 0, None
        for data in blocks(frames):
            x = matrix(data)
            halves = np.stack([(x >> LOW_BITS).sum(axis=0), (x & ((1 << LOW_BITS) - 1)).sum(axis=0)])
            n, parts = n + len(x), halves if parts is None else parts + halves
        if n:
            yield pd.DataFrame({"dim": np.arange(parts.shape[1]), "n": n, "high": parts[0], "low": parts[1]})

    wide = {c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")}
    found = rows.select("x").mapInPandas(run, "dim int, n long, high long, low long").groupBy("dim").agg(*wide.values())
    sums = sorted((r["dim"], int(r["n"]), (int(r["high"]) << LOW_BITS) + int(r["low"])) for r in found.collect())
    return (sums[0][1] if sums else 0), [s for _, _, s in sums]


def gram(rows: DataFrame, make: Callable[[list[bytes]], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of y' y for the rows y that ``make`` gives of a block.

    Each task gives one partial matrix, by rows; partial rows are added in an order that does not
    depend on the scheduling, and the driver reads ``size`` rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = np.zeros((size, size))
        for data in blocks(frames):
            y = make(data)
            part += y.T @ y
        yield pd.DataFrame({"i": np.arange(size), "data": [row.tobytes() for row in part]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for i, data in zip(frame["i"], frame["data"]):
                sums[i] = sums.get(i, 0.0) + np.frombuffer(data)
        yield pd.DataFrame({"i": list(sums), "data": [s.tobytes() for s in sums.values()]}).astype({"i": "int32"})

    parts = rows.select("x").mapInPandas(run, "i int, data binary")
    added = parts.repartition("i").sortWithinPartitions("i", "data").mapInPandas(add, "i int, data binary")
    out = np.zeros((size, size))
    for row in added.collect():
        out[row["i"]] = np.frombuffer(row["data"])
    return out


def triangle_of(g: np.ndarray, shift: float) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix plus ``shift`` on its diagonal.

    A matrix that rounding has made indefinite gets the least shift with which it has a factor.
    """
    eye = np.eye(len(g))
    while True:
        try:
            return np.linalg.cholesky(g + shift * eye).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, np.finfo(float).eps * max(np.trace(g), np.finfo(float).tiny))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows (x); None without rows.

    Components without variance are left out, so there may be fewer than ``components``.
    """
    n, sums = totals(rows)
    if not n:
        return None
    size, centre = len(sums), Centre(n, sums)
    factors: list[np.ndarray] = []
    eps = np.finfo(float).eps
    for turn in range(PASSES):
        done = list(factors)

        def orthogonal(data: list[bytes]) -> np.ndarray:
            y = centre.rows(data)
            for r in done:
                y = solve(y, r)
            return y

        g = gram(rows, orthogonal, size)
        if turn == 0:
            if not np.trace(g) > 0:
                break
            shift = 11 * (n * size + size * (size + 1)) * eps * np.linalg.norm(g, 2)
        else:
            shift = 0.0
            if np.abs(g - np.eye(size)).max() <= 16 * size * eps:
                break
        factors.append(triangle_of(g, shift))
    if not factors:  # all rows are equal
        return Whitening(n, sums, [], np.zeros(0), np.zeros((size, 0)), 0.0)
    whole = np.eye(size)
    for r in factors:
        whole = r @ whole
    _, singular, right = np.linalg.svd(whole)
    variances = singular**2 / n
    kept = min(components, int((variances > RANK * variances[0]).sum()))
    return Whitening(n, sums, factors, variances[:kept], right[:kept].T, float(variances.sum()))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened rows less the identity."""
    centre, k = Centre(model.n, model.sums), len(model.variances)
    to = model.directions / np.sqrt(model.variances)

    def whitened(data: list[bytes]) -> np.ndarray:
        return np.hstack([centre.rows(data) @ to, np.ones((len(data), 1))])

    g = gram(rows, whitened, k + 1) / model.n
    return float(np.abs(g[:k, :k] - np.outer(g[k, :k], g[k, :k]) - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Dropped vectors (see :func:`valid_rows`) have no rows; repeated rows count and return as often as they
    occur, those with a NULL id, too. Components are numbered from 1 by falling variance; components
    without variance have no rows, so equal vectors give none, and neither does an empty table. ``deviation`` is exact, and
    NULL where it does not fit a long.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = valid_rows(vectors, id_col, vector_col)
    model = fit(rows, components)
    fields = "deviation long, whitened array<double>"
    if model is None or not len(model.variances):
        model, error = Whitening(0, [], [], np.zeros(0), np.zeros((0, 0)), 0.0), 0.0
        rows = rows.where(F.lit(False))
    else:
        error = identity_error(rows, model)
    to = model.directions / np.sqrt(model.variances)
    n, sums = model.n, model.sums

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        centre = Centre(n, sums) if n else None
        for data in series:
            if not len(data) or centre is None:
                yield pd.DataFrame({"deviation": pd.Series([None] * len(data), dtype="Int64"), "whitened": [[]] * len(data)})
                continue
            deviation = pd.array(centre.deviations(list(data)), dtype="Int64")
            yield pd.DataFrame({"deviation": deviation, "whitened": list(centre.rows(list(data)) @ to)})

    shares = F.array(*[F.lit(float(e)) for e in (model.explained if n else [])]).cast("array<double>")
    made = with_fields(rows, F.col("x"), run, fields)
    return made.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
