"""Second-order gradient boosting over binned features, with all classes and all folds in one pass.

Every level of every tree is one pass over the rows (over a table of one partition, every tree): a task sums gradients and second derivatives per (model, class, node,
feature, bin), sums of tasks are added by node, and the best split of each node, one row, goes to the driver. The
models of all folds and the one of all rows grow side by side, so cross-validation costs no passes of its own.

Rows travel as blocks of arrays. The blocks of a round, with the margins of all rounds before, are kept in memory or on disk by the executors for
the passes of its levels; every few rounds they are written to the shared folder, from which a lost block is made again.

The driver and the tasks hold trees, one block, and one histogram per open node, whatever the number of rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlight.session import dropped, scratch_path, ship_code, stored

BINS = 64
RIDGE = 1.0  # added to the second derivatives of a node
LEAST_WEIGHT = 1e-3  # second derivatives a child needs
GAIN = 1e-9
RATE = 0.1
STORE_EVERY = 10  # rounds
LEFT = 255  # a cut no bin is above: all rows go left
LOSSES = ("squared", "logistic", "softmax")
PACKED = "bins binary, label binary, weight binary, fold binary, real binary"


class Tree:
    """A complete binary tree. A node that is not split sends all its rows left."""

    def __init__(self, depth: int):
        self.feature = np.zeros(2**depth - 1, dtype=np.int64)
        self.cut = np.full(2**depth - 1, LEFT, dtype=np.int64)
        self.leaf = np.zeros(2**depth)

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        return walk([self], bins, levels)[0]


def walk(trees: list[Tree], bins: np.ndarray, levels: int) -> np.ndarray:
    """The node at a level of every row (columns) in every tree (rows).

    A split compares one feature of all rows, a run of bytes, so no value is looked up by row.
    """
    out = np.zeros((len(trees), len(bins)), dtype=np.min_scalar_type(2**levels - 1))
    for tree, node in zip(trees, out):
        for level in range(levels):
            first = 2**level - 1
            right = np.zeros(len(bins), dtype=bool)
            for n in np.flatnonzero(tree.cut[first : 2 * first + 1] < LEFT).tolist():
                right |= (node == n) & (bins[:, tree.feature[first + n]] > int(tree.cut[first + n]))
            node *= 2
            node += right
    return out


def values(trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    """What every row (rows) gets from every tree (columns)."""
    nodes = walk(trees, bins, int(np.log2(len(trees[0].leaf))))
    return np.stack([t.leaf[node] for t, node in zip(trees, nodes)]).T


def derivatives(loss: str, margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the margins (rows x classes)."""
    if loss == "squared":
        return margin - label[:, None], np.ones_like(margin)
    p = shares(loss, margin)[:, -margin.shape[1] :]
    hit = label[:, None] == (np.arange(p.shape[1]) if loss == "softmax" else 1)
    return p - hit, p * (1 - p)


def shares(loss: str, margin: np.ndarray) -> np.ndarray:
    """Probabilities of all classes."""
    if loss == "logistic":
        p = 1 / (1 + np.exp(-margin))
        return np.hstack([1 - p, p])
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def histogram(bins: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, size: int = BINS) -> np.ndarray:
    """Sums of g and h per (node, feature, bin)."""
    out = np.empty((nodes, bins.shape[1], size, 2))
    start, at = node.astype(np.int64) * size, np.empty(len(node), dtype=np.int64)
    for f in range(bins.shape[1]):
        np.add(start, bins[:, f], out=at)
        for i, v in enumerate((g, h)):
            out[:, f, :, i] = np.bincount(at, v, nodes * size).reshape(nodes, size)
    return out


def best_split(sums: np.ndarray) -> tuple[int, int, float, float, float, float]:
    """(feature, cut, g and h left, g and h) of a node's histogram; no split is a cut at ``LEFT``.

    Of splits that are equal but for rounding, the first by feature and bin counts.
    """
    g, h = sums[0].sum(axis=0)
    left = sums.cumsum(axis=1)[:, :-1]
    gl, hl = left[..., 0], left[..., 1]
    gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
    gain[(hl < LEAST_WEIGHT) | (h - hl < LEAST_WEIGHT)] = 0.0
    most = gain.max(initial=0.0)
    if most <= GAIN:
        return 0, LEFT, g, h, g, h
    feature, cut = np.unravel_index(np.argmax(gain >= most * (1 - 1e-9)), gain.shape)
    return int(feature), int(cut), gl[feature, cut], hl[feature, cut], g, h


def cut_points(rows: DataFrame, size: int) -> list[list[float]]:
    """At most ``BINS`` - 1 cut points of each feature, at quantiles."""
    wide = rows.select(*[F.get(vector_to_array("features"), F.lit(i)).alias(f"f{i}") for i in range(size)])
    shares_ = [i / BINS for i in range(1, BINS)]
    return [sorted(set(points)) for points in wide.approxQuantile(wide.columns, shares_, 1 / (4 * BINS))]


def binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """How many cut points lie below each value."""
    return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1)


def bins_of(frame: pd.DataFrame) -> np.ndarray:
    """Bins of all rows as bytes, each feature a run of its own."""
    return np.asfortranarray(np.frombuffer(b"".join(frame["bins"]), dtype=np.uint8).reshape(len(frame), -1))


def open_nodes(sums: np.ndarray) -> list[int]:
    """The nodes of a histogram that have rows."""
    return [n for n in range(len(sums)) if sums[n, 0, :, 1].any()]


class Block(NamedTuple):
    """Some rows as arrays; ``margins`` are rows x models x classes, or None before the first tree."""

    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    fold: np.ndarray
    real: np.ndarray
    margins: np.ndarray | None


def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row of bytes for each batch of rows."""
    for frame in frames:
        if len(frame):
            numbers = {c: [frame[c].to_numpy(dtype=kind).tobytes()] for c, kind in (("label", "f8"), ("weight", "f8"), ("fold", "i4"), ("real", "f8"))}
            yield pd.DataFrame({"bins": [bins_of(frame).tobytes("F")], **numbers})


def unpacked(row) -> Block:
    label, weight, fold, real = (np.frombuffer(row[c], dtype=kind) for c, kind in (("label", "f8"), ("weight", "f8"), ("fold", "i4"), ("real", "f8")))
    return Block(np.frombuffer(row["bins"], dtype=np.uint8).reshape(-1, len(label)).T, label, weight, fold, real > 0, None)


def blocks_of(table: DataFrame, tasks: int | None = None) -> RDD:
    """The blocks of a table of rows, dealt evenly to ``tasks`` if that is given."""
    if "real" not in table.columns:
        table = table.withColumn("real", F.lit(1.0))
    rows = table.select("bins", "label", "weight", "fold", "real").mapInPandas(packed, PACKED)
    return (rows.repartition(tasks) if tasks else rows).rdd.map(unpacked)


class Growing:
    """Trees of several models, grown together. Model m leaves out fold m; the last one leaves out none."""

    def __init__(self, loss: str, classes: int, models: int, depth: int, base: np.ndarray, rate: float = RATE):
        self.loss, self.classes, self.depth, self.base, self.rate = loss, classes, depth, base, rate
        self.rounds: list[list[list[Tree]]] = []
        self.models = models

    def recent(self, since: int) -> Growing:
        """What tasks need when the margins of all rounds before ``since`` are stored."""
        out = Growing(self.loss, self.classes, self.models, self.depth, self.base, self.rate)
        out.rounds = self.rounds[since:]
        return out

    def upto(self, rounds: int) -> Growing:
        """The models as they were after some rounds."""
        out = self.recent(0)
        out.rounds = self.rounds[:rounds]
        return out

    def margins(self, block: Block) -> np.ndarray:
        """rows x models x classes, from the margins of the block, if there are any, and the rounds here."""
        given = block.margins
        if given is None:
            given = np.broadcast_to(self.base, (len(block.label), *self.base.shape))
        if not self.rounds:
            return given
        out = given.copy()
        for trees in self.rounds:
            out += values([t for of_model in trees for t in of_model], block.bins).reshape(out.shape)
        return out

    def new_trees(self) -> list[list[Tree]]:
        return [[Tree(self.depth) for _ in range(self.classes)] for _ in range(self.models)]

    def place(self, trees: list[list[Tree]], level: int, splits) -> None:
        """Put splits (model, class, node and what ``best_split`` gives) of a level into the trees; those of the last level give the leaves."""
        for model, class_, node, feature, cut, g_left, h_left, g, h in splits:
            tree = trees[model][class_]
            at = 2**level - 1 + node
            tree.feature[at], tree.cut[at] = feature, cut
            if level == self.depth - 1:
                for side, (gs, hs) in enumerate(((g_left, h_left), (g - g_left, h - h_left))):
                    tree.leaf[2 * node + side] = -self.rate * gs / (hs + RIDGE) if hs > 0 else 0.0

    def sums(self, block: Block, margin: np.ndarray, trees: list[list[Tree]], level: int) -> np.ndarray:
        """The histograms of some rows: models x classes x nodes x features x bins x 2."""
        out = np.empty((self.models, self.classes, 2**level, block.bins.shape[1], BINS, 2))
        at = walk([t for of_model in trees for t in of_model], block.bins, level)
        by_class = np.ascontiguousarray(margin.transpose(1, 2, 0))
        for m in range(self.models):
            # Rows left out have no weight.
            mine = np.where(block.fold == m, 0.0, block.weight) if m < self.models - 1 else block.weight
            g, h = derivatives(self.loss, by_class[m].T, block.label)
            for k in range(self.classes):
                out[m, k] = histogram(block.bins, at[m * self.classes + k], 2**level, g[:, k] * mine, h[:, k] * mine)
        return out

    def all_sums(self, blocks: Iterator[Block], trees: list[list[Tree]], level: int) -> np.ndarray | None:
        total = None
        for block in blocks:
            part = self.sums(block, self.margins(block), trees, level)
            total = part if total is None else np.add(total, part, out=total)
        return total

    def open_nodes(self, sums: np.ndarray | None) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
        """(model, class, node) with rows and their sums."""
        if sums is not None:
            for m, k in np.ndindex(sums.shape[:2]):
                for n in open_nodes(sums[m, k]):
                    yield (m, k, n), sums[m, k, n]

    def best_splits(self, blocks: RDD, trees: list[list[Tree]], level: int, since: int) -> list[tuple]:
        """One pass: the best split of every open node of a level."""
        grown, nodes = self.recent(since), 2**level

        def summed(part: Iterator[Block]) -> Iterator[tuple[int, tuple]]:
            for (m, k, n), sums in grown.open_nodes(grown.all_sums(part, trees, level)):
                yield (m * grown.classes + k) * nodes + n, ((m, k, n), sums)

        def added(part: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
            total: dict[tuple[int, int, int], np.ndarray] = {}
            for _, (key, sums) in part:
                total[key] = total[key] + sums if key in total else sums
            return iter([(*key, *best_split(sums)) for key, sums in total.items()])

        tasks = min(blocks.getNumPartitions(), self.models * self.classes * nodes)
        return blocks.mapPartitions(summed).partitionBy(tasks, int).mapPartitions(added).collect()

    def whole_round(self, blocks: RDD, since: int) -> list[tuple]:
        """The splits of all levels, with the level, from a table that is one partition: its task has all sums already."""
        grown = self.recent(since)

        def run(part: Iterator[Block]) -> Iterator[tuple]:
            trees = grown.new_trees()
            held = [b._replace(margins=grown.margins(b)) for b in part]
            bare = grown.recent(len(grown.rounds))
            for level in range(grown.depth):
                splits = [(*key, *best_split(s)) for key, s in bare.open_nodes(bare.all_sums(iter(held), trees, level))]
                bare.place(trees, level, splits)
                for s in splits:
                    yield (*s, level)

        return blocks.mapPartitions(run).collect()

    def grow_round(self, rows: DataFrame | RDD, since: int, tasks: int) -> None:
        """One more tree per model and class. A level is a pass; a table of a single partition needs one job a round."""
        trees, blocks = self.new_trees(), rows if isinstance(rows, RDD) else blocks_of(rows)
        if tasks == 1:
            splits = self.whole_round(blocks, since)
            for level in range(self.depth):
                self.place(trees, level, [s[:-1] for s in splits if s[-1] == level])
        else:
            for level in range(self.depth):
                self.place(trees, level, self.best_splits(blocks, trees, level, since))
        self.rounds.append(trees)

    def with_margins(self, blocks: RDD, since: int) -> RDD:
        """The blocks with the margins of all rounds so far."""
        grown = self.recent(since)
        return blocks.map(lambda b: b._replace(margins=grown.margins(b)))


def grow(
    rows: DataFrame, loss: str, folds: int, rounds: int, depth: int, rate: float = RATE
) -> tuple[Growing, list[list[float]], DataFrame, list[RDD]]:
    """Grow the models of ``rows`` (features, label, weight, fold); gives them with the cut points, the binned rows, and the blocks
    the executors keep: those with the margins of all rounds first."""
    ship_code(rows.sparkSession)
    first = rows.select(F.size(vector_to_array("features"))).first()
    cuts = cut_points(rows, first[0])

    def bins(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in series:
            yield pd.Series([b.tobytes() for b in binned(np.stack(x), cuts).astype(np.uint8)] if len(x) else [], dtype=object)

    fold = F.col("fold").cast("int") if folds else F.lit(-1)
    table = stored(
        rows.select(
            F.pandas_udf(bins, "binary")(vector_to_array("features")).alias("bins"),
            F.col("label").cast("double").alias("label"),
            F.col("weight").cast("double").alias("weight"),
            fold.alias("fold"),
            (F.col("real") if "real" in rows.columns else F.lit(1.0)).cast("double").alias("real"),
        ),
        "binned",
    )
    base, classes = _base(table, loss, folds)
    grown = Growing(loss, classes, folds + 1, depth, base, rate)
    spark = rows.sparkSession
    several = table.rdd.getNumPartitions() > 1
    base = blocks_of(table, spark.sparkContext.defaultParallelism if several else None).persist(StorageLevel.MEMORY_AND_DISK)
    since, path, current = 0, None, base
    for turn in range(rounds):
        grown.grow_round(current, turn, current.getNumPartitions())
        if turn + 1 - since < STORE_EVERY:
            after = grown.with_margins(base, since).persist(StorageLevel.MEMORY_AND_DISK)
        else:
            written, since = scratch_path(spark, "margins"), turn + 1
            grown.with_margins(current, turn).saveAsPickleFile(written, 1)
            after = spark.sparkContext.pickleFile(written, 1).persist(StorageLevel.MEMORY_AND_DISK)
            base.unpersist()
            base = after
            if path:
                dropped(spark, path)
            path = written
        if current is not base:
            current.unpersist()
        current = after
    return grown, cuts, table, [current, base]


def _base(table: DataFrame, loss: str, folds: int) -> tuple[np.ndarray, int]:
    """Margins before the first tree, models x classes: the mean, or logarithms of the class shares."""
    group = ["fold"] if loss == "squared" else ["fold", "label"]
    sums = table.groupBy(*group).agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("label")).alias("s")).collect()
    models = range(folds + 1)
    if loss == "squared":
        kept = [[r for r in sums if r["fold"] != m] or sums for m in models]
        return np.array([[sum(r["s"] for r in k) / sum(r["w"] for r in k)] for k in kept]), 1
    classes = 2 if loss == "logistic" else int(max(r["label"] for r in sums)) + 1
    share = np.full((folds + 1, classes), 1e-3)
    for r in sums:
        for m in models:
            if r["fold"] != m:
                share[m, int(r["label"])] += r["w"]
    logs = np.log(share / share.sum(axis=1, keepdims=True))
    return (logs[:, 1:] - logs[:, :1], 1) if loss == "logistic" else (logs, classes)


class _BoostingParams(HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol):
    loss = Param(Params._dummy(), "loss", "squared, logistic or softmax", TypeConverters.toString)


class Boosting(Estimator, _BoostingParams, HasLabelCol, HasWeightCol):
    """Boosted trees for numbers (squared), two classes (logistic) or more (softmax)."""

    rounds = Param(Params._dummy(), "rounds", "trees per class", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of splits", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "share of its step that a tree takes", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, loss="squared", rounds=100, depth=5, rate=RATE, featuresCol="features", labelCol="label", weightCol=None):
        super().__init__()
        self._setDefault(loss="squared", rounds=100, depth=5, rate=RATE)
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        if given.get("loss", "squared") not in LOSSES:
            raise ValueError(f"no loss {given['loss']}")
        self._set(**given)

    def _grow(self, dataset: DataFrame, folds: int):
        weight = F.col(self.getWeightCol()) if self.isDefined(self.weightCol) else F.lit(1.0)
        rows = dataset.select(
            F.col(self.getFeaturesCol()).alias("features"), F.col(self.getLabelCol()).alias("label"), weight.alias("weight"),
            *(["fold"] if folds else []),
            *(["real"] if "real" in dataset.columns else []),
        )
        get = self.getOrDefault
        return grow(rows, get(self.loss), folds, get(self.rounds), get(self.depth), get(self.rate))

    def _model(self, grown: Growing, cuts: list[list[float]]) -> BoostingModel:
        trees = [[[t.feature.tolist(), t.cut.tolist(), t.leaf.tolist()] for t in of[-1]] for of in grown.rounds]
        text = json.dumps({"cuts": cuts, "base": grown.base[-1].tolist(), "trees": trees})
        model = BoostingModel()
        model._set(loss=grown.loss, forest=text, featuresCol=self.getFeaturesCol())
        return model

    def _fit(self, dataset: DataFrame) -> BoostingModel:
        grown, cuts, _, kept = self._grow(dataset, 0)
        for blocks in kept:
            blocks.unpersist()
        return self._model(grown, cuts)

    def cross_validate(self, dataset: DataFrame, folds: int) -> tuple[BoostingModel, list[float]]:
        """The model of all rows, and for each fold (column ``fold``) the accuracy or R2 on its rows of the model without it.

        Rows with 0 in a column ``real`` take part in training and are not judged.
        """
        return self.staged(dataset, folds, [self.getOrDefault(self.rounds)])[0]

    def staged(self, dataset: DataFrame, folds: int, counts: list[int]) -> list[tuple[BoostingModel, list[float]]]:
        """What ``cross_validate`` gives for each number of rounds: the shorter models are the first rounds of the longest."""
        longest = max(counts)
        grown, cuts, _, kept = self.copy({self.rounds: longest})._grow(dataset, folds)
        out = []
        for count in counts:
            part = grown.upto(count)
            blocks = kept[0] if count == longest else kept[0].map(lambda b, part=part: b._replace(margins=part.margins(b._replace(margins=None))))
            out.append((self._model(part, cuts), self._scores(blocks, grown.loss)))
        for blocks in kept:
            blocks.unpersist()
        return out

    @staticmethod
    def _scores(blocks: RDD, loss: str) -> list[float]:
        """The accuracy or R2 of each fold's rows by the model without them."""

        def judged(part: Iterator[Block]) -> Iterator[tuple[int, tuple]]:
            for block in part:
                margin = block.margins[np.arange(len(block.label)), block.fold]
                guess = margin[:, 0] if loss == "squared" else shares(loss, margin).argmax(axis=1)
                for fold in np.unique(block.fold[block.real]):
                    mine = block.real & (block.fold == fold)
                    label = block.label[mine]
                    good = ((label - guess[mine]) ** 2).sum() if loss == "squared" else (label == guess[mine]).sum()
                    yield int(fold), (len(label), float(label.mean()), float(((label - label.mean()) ** 2).sum()), float(good))

        found = sorted(blocks.mapPartitions(judged).reduceByKey(_joined, 1).collect())
        return [1 - good / squares if loss == "squared" else good / n for _, (n, _, squares, good) in found]


def _joined(a: tuple, b: tuple) -> tuple:
    """Rows, mean, squares about the mean and a sum of two parts."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * b[0] / n, a[2] + b[2] + apart**2 * a[0] * b[0] / n, a[3] + b[3]


class BoostingModel(Model, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    forest = Param(Params._dummy(), "forest", "cut points, base and trees as JSON", TypeConverters.toString)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_code(dataset.sparkSession)
        text, loss = self.getOrDefault(self.forest), self.getOrDefault(self.loss)

        def margins(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            forest = json.loads(text)
            base = np.array(forest["base"])
            trees = []
            for of in forest["trees"]:
                trees.append([])
                for feature, cut, leaf in of:
                    tree = object.__new__(Tree)
                    tree.feature, tree.cut, tree.leaf = np.array(feature), np.array(cut), np.array(leaf)
                    trees[-1].append(tree)
            for x in series:
                out = np.repeat(base[None], len(x), axis=0)
                if len(x):
                    bins = np.asfortranarray(binned(np.stack(x), forest["cuts"]).astype(np.uint8))
                    for of in trees:
                        out += values(of, bins)
                yield pd.Series(list(out), dtype=object)

        margin = F.pandas_udf(margins, "array<double>")(vector_to_array(self.getFeaturesCol()))
        out = dataset.withColumn(self.getRawPredictionCol(), margin)
        raw = F.col(self.getRawPredictionCol())
        if loss == "squared":
            return out.withColumn(self.getPredictionCol(), F.get(raw, F.lit(0))).drop(self.getRawPredictionCol())
        if loss == "logistic":
            p = 1 / (1 + F.exp(-F.get(raw, F.lit(0))))
            odds = F.array(1 - p, p)
        else:
            e = F.transform(raw, lambda m: F.exp(m - F.array_max(raw)))
            total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
            odds = F.transform(e, lambda v: v / total)
        out = out.withColumn(self.getProbabilityCol(), odds)
        first = F.array_position(self.getProbabilityCol(), F.array_max(self.getProbabilityCol())) - 1
        raw_vector = array_to_vector(F.array(-F.get(raw, F.lit(0)), F.get(raw, F.lit(0))) if loss == "logistic" else raw)
        return (
            out.withColumn(self.getPredictionCol(), first.cast("double"))
            .withColumn(self.getProbabilityCol(), array_to_vector(self.getProbabilityCol()))
            .withColumn(self.getRawPredictionCol(), raw_vector)
        )
