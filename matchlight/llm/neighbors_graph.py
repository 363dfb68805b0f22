"""Near-duplicate vectors by NN-descent.

A neighbour graph starts from buckets of random hyperplanes and is refined by local joins: the
neighbours of a vector, in either direction, are compared with each other, and every vector keeps its best.
A list that is saturated, all of it over the threshold, is enlarged. Edges over the threshold make
components. Lists of a component that outgrow any bound are not stored: links inside
a component are counted by comparing its blocks pairwise, so dense groups are exact. A brute-force audit of a bounded
sample measures the recall, and rounds go on, between the components found so far, until it is reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlight.llm.components import components
from matchlight.llm.text import prepare, whole_groups
from matchlight.session import stored

THRESHOLD = 0.95
NEIGHBOURS = 8  # kept for every vector, and
ENLARGED = 32  # for one whose list is saturated
TABLES = 8  # random hyperplane tables of a round
BUCKET = 16  # vectors of a bucket aimed at
BLOCK = 256  # vectors of a bucket compared at a time; the next block overlaps by half
DESCENTS = 3
QUIET = 0.01  # descents end when this share of the lists' places changes at most
AUDIT_ROWS, RECALL = 1000, 0.98
ROUNDING = 1e-9
COUNT_BLOCK = 2048
EDGES = "a long, b long, sim double"


def raw(values, dtype: str) -> bytes | None:
    """The components as bytes; None for a vector that links with nothing."""
    if values is None:
        return None
    x = np.asarray(values, dtype=np.float64)
    if not len(x) or not np.isfinite(x).all() or not x.any():
        return None
    return (x + 0.0).astype(dtype).tobytes()  # adding zero makes -0.0 equal to 0.0


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, data, node): node stands for equal vectors; both NULL for vectors without links.

    ``data`` has the components as they are, in single precision if they came so.
    """
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    dtype = dtype_of(vectors, vector_col)

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in series:
            yield pd.Series([raw(v, dtype) for v in values], dtype=object)

    made = source.select("vec_id", F.pandas_udf(run, "binary")("vector").alias("data"))
    return made.withColumn("node", F.when(F.col("data").isNotNull(), F.xxhash64("data")))


def dtype_of(vectors: DataFrame, vector_col: str = "embedding") -> str:
    return "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"


def _matrix(data, dtype: str) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = np.frombuffer(b"".join(data), dtype=dtype).reshape(len(data), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _edges(
    node: np.ndarray, component: np.ndarray, sims: np.ndarray, most: int, floor: np.ndarray | None = None
) -> pd.DataFrame:
    """For every row its ``most`` best columns in other components, as edges; below ``floor`` they are no news."""
    sims[component[:, None] == component[None, :]] = -2.0
    most = min(most, len(node) - 1)
    best = np.argpartition(-sims, most - 1, axis=1)[:, :most]
    a = np.repeat(np.arange(len(node)), most)
    b = best.ravel()
    sim = sims[a, b]
    keep = sim > (floor[a] if floor is not None else -1.5)
    return pd.DataFrame({"a": node[a[keep]], "b": node[b[keep]], "sim": sim[keep]})


def first_graph(nodes: DataFrame, bits: int, seed: int, dtype: str) -> DataFrame:
    """Edges between vectors in the same bucket of one of ``TABLES`` hyperplane tables."""

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                x = _matrix(part["data"].tolist(), dtype)
                for table in range(TABLES):
                    planes = np.random.default_rng([seed, table, int(dim)]).standard_normal((int(dim), bits + 1))
                    side = x @ planes
                    code = (side[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    bucket = (code * TABLES + table) * 100_003 + int(dim)
                    yield pd.DataFrame(
                        {"bucket": bucket, "along": side[:, bits], "node": part["node"], "component": part["component"], "dim": part["dim"], "data": part["data"]}
                    )

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["bucket"], len, 4000):
            for _, part in frame.groupby(["bucket", "dim"], sort=False):
                node, component = part["node"].to_numpy(), part["component"].to_numpy()
                x = _matrix(part["data"].tolist(), dtype)
                for start in range(0, max(1, len(node) - BLOCK // 2), BLOCK // 2):
                    own = x[start : start + BLOCK]
                    if len(own) > 1:
                        yield _edges(node[start : start + BLOCK], component[start : start + BLOCK], own @ own.T, NEIGHBOURS)

    return (
        nodes.select("node", "component", "dim", "data")
        .mapInPandas(hashed, "bucket long, along double, node long, component long, dim int, data binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "along")
        .mapInPandas(linked, EDGES)
    )


def best_edges(edges: DataFrame, threshold: float) -> DataFrame:
    """The ``NEIGHBOURS`` best edges of every vector, more of them over the threshold."""
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    ranked = edges.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= ENLARGED).where((F.col("rank") <= NEIGHBOURS) | (F.col("sim") >= threshold))


def descend(graph: DataFrame, nodes: DataFrame, threshold: float, dtype: str) -> DataFrame:
    """One local join: news for the graph from comparing each vector's neighbours with each other."""
    floor = graph.groupBy("a").agg(
        F.when(F.count("*") >= NEIGHBOURS, F.min("sim")).otherwise(-2.0).alias("floor"),
        (F.min("sim") >= threshold).alias("saturated"),
    )
    both = graph.select("a", "b", "sim").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    members = (
        both.groupBy("a", "b")
        .agg(F.max("sim").alias("sim"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= 2 * NEIGHBOURS)
        .select(F.col("a").alias("centre"), F.col("b").alias("node"))
    )
    # A saturated list has room for more.
    limit = F.when(F.col("saturated"), F.least("floor", F.lit(threshold))).otherwise(F.col("floor"))
    carried = nodes.join(floor, F.col("node") == F.col("a")).select("node", "component", "data", limit.alias("floor"))

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["centre"], len, 2000):
            out = []
            for _, part in frame.groupby("centre", sort=False):
                if len(part) > 1:
                    x = _matrix(part["data"].tolist(), dtype)
                    sides = (part[c].to_numpy() for c in ("node", "component"))
                    out.append(_edges(*sides, x @ x.T, NEIGHBOURS, part["floor"].to_numpy()))
            if out:
                yield pd.concat(out).drop_duplicates(["a", "b"])

    return (
        members.join(carried, "node")
        .repartition("centre")
        .sortWithinPartitions("centre")
        .mapInPandas(compared, EDGES)
    )


def count_links(labelled: DataFrame, threshold: float, dtype: str) -> DataFrame:
    """(node, n): rows linked to a row of each node of (node, component, data, rows), exactly.

    Components are cut into blocks of about ``COUNT_BLOCK``; each pair of blocks is compared in one task,
    and only counts leave it.
    """
    sizes = labelled.groupBy("component").agg(F.ceil(F.count("*") / COUNT_BLOCK).cast("int").alias("blocks"), F.count("*").alias("size"))
    pairs = (
        labelled.join(sizes.where("size > 1").drop("size"), "component")
        .withColumn("own", F.pmod(F.hash("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .repartition("component", "low", "high")
        .sortWithinPartitions("component", "low", "high")
    )

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = ["component", "low", "high"]
        for frame in whole_groups(frames, keys, len, 4096):
            for (_, low, high), part in frame.groupby(keys, sort=False):
                x, weight = _matrix(part["data"].tolist(), dtype), part["rows"].to_numpy(dtype=np.int64)
                in_low = (part["own"] == low).to_numpy()
                n = np.zeros(len(part), dtype=np.int64)
                sides = ((in_low, in_low),) if low == high else ((in_low, ~in_low), (~in_low, in_low))
                for mine, theirs in sides:
                    place, target, heavy = np.flatnonzero(mine), x[theirs].T, weight[theirs]
                    for start in range(0, len(place), 512):
                        at = place[start : start + 512]
                        n[at] += (x[at] @ target >= threshold) @ heavy
                if low == high:
                    # A vector's link to itself is not one.
                    n -= np.where(np.einsum("ij,ij->i", x, x) >= threshold, weight, 0)
                yield pd.DataFrame({"node": part["node"].to_numpy(), "n": n})

    return pairs.mapInPandas(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def across(graph: DataFrame, labelled: DataFrame) -> DataFrame:
    """The edges between different components."""
    of = labelled.select("node", "component")
    a = of.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
    b = of.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
    return graph.join(a, "a").join(b, "b").where("of_a <> of_b").select("a", "b", "sim")


def audit(labelled: DataFrame, threshold: float, dtype: str, rows: int = AUDIT_ROWS) -> float:
    """The mean, over those of at most ``rows`` vectors that have links, of the share that lies inside components.

    Every vector counts alike, so a large group does not hide what small ones lack. Links at the
    threshold but for rounding are not asked for.
    """
    asked = labelled.orderBy(F.hash("node"), "node").limit(rows).select("node", "dim", "data", "component").toPandas()
    if not len(asked):
        return 1.0
    shared = labelled.sparkSession.sparkContext.broadcast(
        {dim: (_matrix(p["data"].tolist(), dtype), p["node"].to_numpy(), p["component"].to_numpy()) for dim, p in asked.groupby("dim")}
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {dim: np.zeros((2, len(node)), dtype=np.int64) for dim, (_, node, _) in shared.value.items()}
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                if dim in sums:
                    q, node, component = shared.value[dim]
                    near = q @ _matrix(part["data"].tolist(), dtype).T >= threshold + ROUNDING
                    link = near & (node[:, None] != part["node"].to_numpy()[None, :])
                    within = link & (component[:, None] == part["component"].to_numpy()[None, :])
                    sums[dim] += np.stack([link.sum(axis=1), within.sum(axis=1)])
        for dim, (true, found) in sums.items():
            some = true > 0
            yield pd.DataFrame({"node": shared.value[dim][1][some], "true": true[some], "found": found[some]})

    counts = labelled.select("node", "dim", "data", "component").mapInPandas(run, "node long, true long, found long")
    of_each = counts.groupBy("node").agg((F.sum("found") / F.sum("true")).alias("share"))
    mean = of_each.agg(F.avg("share")).first()[0]
    return 1.0 if mean is None else mean


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall): one row per input row.

    NULL, empty and zero vectors and those with NULL or non-finite components link with nothing;
    vectors of different lengths don't link. Equal vectors are one node with a count. ``recall`` is
    that of the audit. Rows with a NULL vec_id count as links of others; their own component_id is the
    smallest id in their component, if there is one.
    """
    prepare(vectors.sparkSession)
    dtype = dtype_of(vectors)
    rows = stored(valid_vectors(vectors), "vectors")
    nodes = stored(
        rows.where("node is not null")
        .groupBy("node")
        .agg(F.first("data").alias("data"), F.count("*").alias("rows"), F.min("vec_id").alias("least_id"))
        .withColumn("dim", (F.length("data") / np.dtype(dtype).itemsize).cast("int")),
        "nodes",
    )
    size = nodes.count()
    bits = int(np.clip(np.ceil(np.log2(max(1, size) / BUCKET)), 1, 40))
    # Each turn looks for links between the components of the turn before, so that a list
    # full of links within a component hides none to another.
    labelled = nodes.withColumn("component", F.col("node"))
    graph, turn = None, 0
    while True:
        start = first_graph(labelled, bits, seed + turn, dtype)
        kept = start if graph is None else across(graph, labelled).unionByName(start)
        graph = stored(best_edges(kept, threshold), "graph")
        for _ in range(DESCENTS):
            news = descend(graph, labelled, threshold, dtype)
            new = stored(best_edges(graph.select("a", "b", "sim").unionByName(news), threshold), "graph")
            changed = new.join(graph, ["a", "b"], "left_anti").count()
            graph = new
            if changed <= QUIET * NEIGHBOURS * size:
                break
        fresh = graph.where(F.col("sim") >= threshold).select(F.col("a").alias("u"), F.col("b").alias("v"))
        known = labelled.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        label = components(known.unionByName(fresh))
        labelled = stored(
            nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled"
        )
        recall = audit(labelled, threshold, dtype)
        turn += 1
        if recall >= RECALL and fresh.count() <= QUIET * size:
            break
    smallest = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_node = (
        labelled.join(smallest, "component")
        .join(count_links(labelled, threshold, dtype), "node", "left")
        .select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    )
    # A NULL node finds no partner: a vector without links is its own component.
    result = rows.select("vec_id", "node").join(by_node, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).withColumn(
        "recall", F.lit(float(recall))
    )
