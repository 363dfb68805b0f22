"""Exact k nearest neighbours between two tables, without forming all pairs.

The base rows are divided into cells around pivots, whose number grows with the root of the rows. For a query row the pivots
alone give an upper bound on its k-th distance; by the triangle inequality every cell further
away than that bound can be left out. Query rows go only to the cells that remain. Cells are cut
into blocks of bounded size on both sides, and each pair of blocks returns at most k rows per
query. Equal base rows are one row with a count, so copies cost nothing.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlight.session import stored

# Ship the helpers below with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIVOTS = (16, 1024)  # least and most pivots, which is what the driver sees
ROWS_PER_PIVOT = 16  # per pivot for few rows; the number of pivots grows with the root of the rows
BASE_BLOCK = 20_000
QUERY_BLOCK = 20_000
SLACK = 1e-9
CELLS_AT_ONCE = 1 << 20  # numbers in a matrix of distances


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by direct differences, so whole-number input gives exact results."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j : j + 1] - b[:, j]) ** 2
    return out


def _slices(rows: int, width: int):
    """Slices of some rows whose matrix with so many columns stays within ``CELLS_AT_ONCE``."""
    step = max(1, CELLS_AT_ONCE // max(1, width))
    return [slice(at, at + step) for at in range(0, rows, step)]


def _cells_within_reach(vecs, centers, radius, close_cell, close_reach, close_copies, need) -> np.ndarray:
    """Which cells (columns) may hold one of the ``need`` nearest rows of each vector (rows).

    The innermost rows of all cells, at most pivots x need, bound the distance; memory is bounded whatever the rows.
    """
    near = np.zeros((len(vecs), len(centers)), dtype=bool)
    for part in _slices(len(vecs), len(close_cell)):
        d = np.sqrt(_distances(vecs[part], centers))
        upper = d[:, close_cell] + close_reach
        order = np.argsort(upper, axis=1)
        covered = np.cumsum(close_copies[order], axis=1) >= need
        first = np.where(covered.any(axis=1), covered.argmax(axis=1), upper.shape[1] - 1)
        bound = np.take_along_axis(upper, order, axis=1)[np.arange(len(d)), first]
        bound[~covered.any(axis=1)] = np.inf
        near[part] = d - radius <= (bound * (1 + SLACK) + SLACK)[:, None]
    return near


def nearest(
    queries: DataFrame,
    base: DataFrame,
    key: str,
    k: int,
    payload: str | None = None,
    exclude_self: bool = False,
    pivots: int | None = None,
    base_block: int = BASE_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The k nearest base rows of every query row.

    Both tables have ``vec`` (array of double) and a key; ``payload`` is a string column of the
    base to carry along. Returns (key, distance2, payload, vec, copies, upto): base rows in order
    of distance, then payload, then vector, with the running number of rows; the last one may
    reach beyond k because it stands for several equal rows. With ``exclude_self``, the query
    row itself is in the base and is not counted.
    """
    need = k + 1 if exclude_self else k
    spark = base.sparkSession
    label = F.col(payload) if payload else F.lit("")
    distinct = stored(
        base.groupBy("vec", label.alias("payload")).agg(F.count("*").alias("copies")), "base-rows"
    )

    if pivots is None:
        low, high = PIVOTS
        pivots = int(min(high, max(low, distinct.count() ** 0.5 * 4 / ROWS_PER_PIVOT**0.5)))
    chosen = distinct.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(pivots).collect()
    centers = np.array([row["vec"] for row in chosen], dtype="float64")
    if not len(centers):
        return spark.createDataFrame(
            [], f"{key} bigint, distance2 double, payload string, vec array<double>, copies bigint, upto bigint"
        )

    @F.pandas_udf("struct<cell int, reach double>")
    def place(vec: pd.Series) -> pd.DataFrame:
        rows, cell, reach = _matrix(vec), np.zeros(len(vec), dtype="int32"), np.zeros(len(vec))
        for part in _slices(len(rows), len(centers)):
            d = _distances(rows[part], centers)
            cell[part], reach[part] = d.argmin(axis=1), np.sqrt(d.min(axis=1))
        return pd.DataFrame({"cell": cell, "reach": reach})

    placed = stored(
        distinct.withColumn("p", place("vec")).select(
            "vec", "payload", "copies", "p.cell", "p.reach"
        ),
        "base-cells",
    )
    # Per cell: size, radius, and the distances of its innermost rows. Bounded by pivots x need.
    inner = Window.partitionBy("cell").orderBy("reach", "vec", "payload")
    close = (
        placed.withColumn("r", F.row_number().over(inner))
        .filter(F.col("r") <= need)
        .groupBy("cell")
        .agg(F.collect_list(F.struct("reach", "copies")).alias("close"))
    )
    sizes = placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("reach").alias("radius"))
    cells = sorted(sizes.join(close, "cell").collect(), key=lambda row: row["cell"])
    ids = np.array([c["cell"] for c in cells])
    radius = np.array([c["radius"] for c in cells])
    blocks = {c["cell"]: int(-(-c["rows"] // base_block)) for c in cells}
    close_cell = np.concatenate([[i] * len(c["close"]) for i, c in enumerate(cells)]).astype(int)
    close_reach = np.array([x["reach"] for c in cells for x in c["close"]])
    close_copies = np.array([x["copies"] for c in cells for x in c["close"]])

    @F.pandas_udf("array<int>")
    def candidates(vec: pd.Series) -> pd.Series:
        near = _cells_within_reach(_matrix(vec), centers[ids], radius, close_cell, close_reach, close_copies, need)
        return pd.Series([ids[row].tolist() for row in near])

    sent = stored(
        queries.select(key, "vec", F.explode(candidates("vec")).alias("cell")), "query-cells"
    )
    asked = sent.groupBy("cell").agg(F.count("*").alias("n")).collect()
    demand = {row["cell"]: int(-(-row["n"] // query_block)) for row in asked}
    plan = F.broadcast(  # one row per pivot
        spark.createDataFrame(
            [(int(c), blocks[c], demand.get(c, 1)) for c in blocks],
            "cell int, base_blocks int, query_blocks int",
        )
    )

    def numbers(count: str):
        return F.sequence(F.lit(0), F.col(count) - 1)

    left = (
        sent.join(plan, "cell")
        .withColumn("qb", F.pmod(F.xxhash64(key), F.col("query_blocks")).cast("int"))
        .withColumn("bb", F.explode(numbers("base_blocks")))
        .select("cell", "qb", "bb", key, "vec")
        .toDF("cell", "qb", "bb", key, "query_vec")
    )
    right = (
        placed.join(plan, "cell")
        .withColumn("bb", F.pmod(F.xxhash64("vec", "payload"), F.col("base_blocks")).cast("int"))
        .withColumn("qb", F.explode(numbers("query_blocks")))
        .select("cell", "qb", "bb", "vec", "payload", "copies")
        .toDF("cell", "qb", "bb", "vec", "payload", "copies")
    )

    def best(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = [key, "distance2", "payload", "vec", "copies"]
        if q.empty or b.empty:
            return pd.DataFrame({c: [] for c in columns})
        b = b.assign(_v=b["vec"].map(tuple)).sort_values(["payload", "_v"])
        base_vecs, found = _matrix(b["vec"]), []
        for rows_of in _slices(len(q), len(b)):
            part = q.iloc[rows_of]
            d = _distances(_matrix(part["query_vec"]), base_vecs)
            keep = np.argsort(d, axis=1, kind="stable")[:, : min(need, d.shape[1])]
            rows = keep.ravel()
            found.append(
                pd.DataFrame(
                    {
                        key: np.repeat(part[key].to_numpy(), keep.shape[1]),
                        "distance2": np.take_along_axis(d, keep, axis=1).ravel(),
                        "payload": b["payload"].to_numpy()[rows],
                        "vec": b["vec"].to_numpy()[rows],
                        "copies": b["copies"].to_numpy()[rows],
                    }
                )
            )
        return pd.concat(found)

    keys = ["cell", "qb", "bb"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        best, f"{key} bigint, distance2 double, payload string, vec array<double>, copies bigint"
    )
    if exclude_self:
        own = F.when(F.col("distance2") == 0, 1).otherwise(0)
        pairs = pairs.withColumn("copies", F.col("copies") - own).filter("copies > 0")
    ranked = (
        Window.partitionBy(key)
        .orderBy("distance2", "payload", "vec")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = pairs.withColumn("upto", F.sum("copies").over(ranked))
    return counted.filter(F.col("upto") - F.col("copies") < k)


def vote(neighbors: DataFrame, key: str, k: int) -> DataFrame:
    """The most frequent payload among the k nearest; the alphabetically first among equals."""
    counted = F.least("copies", F.lit(k) - (F.col("upto") - F.col("copies")))
    votes = neighbors.groupBy(key, "payload").agg(F.sum(counted).alias("votes"))
    ordered = votes.groupBy(key).agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("votes")).alias("v"), F.col("payload").alias("p")))
        ).alias("all")
    )
    return ordered.select(key, F.get("all", F.lit(0))["p"].alias("predicted"))


def smote(
    minority: DataFrame, key: str, copies: float, k: int = 5, seed: int = 42, **options
) -> DataFrame:
    """Synthetic rows between minority rows and their neighbours.

    Each row is used ``copies`` times, a fraction being the share of rows used once more; every
    time one of its k nearest minority neighbours and a point on the line to it are drawn from a
    hash of row, copy and seed. Returns (key, copy, vec).
    """
    near = nearest(minority, minority, key, k, exclude_self=True, **options)
    take = F.least("copies", F.lit(k) - (F.col("upto") - F.col("copies")))
    low = F.col("upto") - F.col("copies")
    chosen = near.select(
        key, F.col("vec").alias("other"), low.alias("low"), (low + take).alias("high")
    )
    total = chosen.groupBy(key).agg(F.max("high").alias("n"))

    def draw(name: str, *columns: str):
        part = F.pmod(F.xxhash64(key, *columns, F.lit(f"{seed}-{name}")), F.lit(1 << 30))
        return part.cast("double") / F.lit(float(1 << 30))

    times = F.floor(F.lit(float(copies)) + draw("times")).cast("int")
    turns = minority.filter(times > 0).select(
        key, "vec", F.explode(F.sequence(F.lit(1), times)).alias("copy")
    )
    picked = (
        turns.join(total, key)
        .withColumn("pick", F.floor(draw("neighbour", "copy") * F.col("n")))
        .join(chosen, key)
        .filter((F.col("low") <= F.col("pick")) & (F.col("pick") < F.col("high")))
        .withColumn("step", draw("step", "copy"))
    )
    between = F.zip_with("vec", "other", lambda a, b: a + (b - a) * F.col("step"))
    return picked.select(key, "copy", between.alias("vec"))
