"""Boosting with all classes and folds in a pass, against plain computations."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.linalg import Vectors

from matchlight.ml import boosting as B


def table(spark, x, y, folds=2):
    draw = np.random.default_rng(0)
    fold = draw.integers(0, folds, len(y))
    rows = [(Vectors.dense(a), float(b), 1.0 + i % 3, int(f)) for i, (a, b, f) in enumerate(zip(x, y, fold))]
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    schema = StructType([StructField("features", VectorUDT()), StructField("label", DoubleType()), StructField("weight", DoubleType()), StructField("fold", IntegerType())])
    return spark.createDataFrame(rows, schema).repartition(3)


def three_classes(n=600):
    draw = np.random.default_rng(1)
    x = draw.uniform(-1, 1, (n, 3))
    return x, (np.hypot(x[:, 0], x[:, 1]) > 0.5).astype(int) + (x[:, 2] > 0.4)


def test_first_round_equals_plain_sums_and_splits(spark):
    x, y = three_classes(300)
    rows = table(spark, x, y)
    grown, cuts, stored, _ = B.grow(rows, "softmax", 2, 1, 2)
    got = stored.toPandas()
    bins = np.stack([np.frombuffer(b, dtype=np.uint8) for b in got["bins"]]).astype(int)
    label, weight, fold = (got[c].to_numpy() for c in ("label", "weight", "fold"))
    for m in range(3):
        mine = fold != m if m < 2 else np.ones(len(fold), bool)
        share = np.array([weight[mine & (label == k)].sum() for k in range(3)])
        assert np.abs(B.shares("softmax", grown.base[[m]])[0] - share / share.sum()).max() < 1e-4
        p = B.shares("softmax", grown.base[[m]])[0]
        for k in range(3):
            g, h = (p[k] - (label == k)) * weight * mine, p[k] * (1 - p[k]) * weight * mine
            gains = {}
            for f in range(3):
                for cut in range(B.BINS - 1):
                    left = bins[:, f] <= cut
                    if h[left].sum() >= B.LEAST_WEIGHT and h[~left].sum() >= B.LEAST_WEIGHT:
                        gains[f, cut] = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1)
            tree = grown.rounds[0][m][k]
            assert gains[int(tree.feature[0]), int(tree.cut[0])] == pytest.approx(max(gains.values()))
            for leaf in range(4):
                here = (tree.nodes(bins, 2) == leaf) & mine
                want = -B.RATE * g[here].sum() / (h[here].sum() + 1) if here.any() else 0.0
                assert tree.leaf[leaf] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("loss", ["softmax", "squared"])
def test_one_partition_gives_the_same_trees_as_many(spark, loss):
    x, y = three_classes(300)
    rows = table(spark, x, y)
    first, _, stored, _ = B.grow(rows, loss, 2, 0, 3)  # the binned rows, no round yet
    found = []
    for df, tasks in ((stored.repartition(3), 3), (stored.coalesce(1), 1)):
        grown = B.Growing(loss, first.classes, 3, 3, first.base)
        grown.grow_round(df, 0, tasks)
        grown.grow_round(df, 0, tasks)
        found.append([t for r in grown.rounds for of in r for t in of])
    for a, b in zip(*found):
        assert a.feature.tolist() == b.feature.tolist() and a.cut.tolist() == b.cut.tolist()
        assert np.allclose(a.leaf, b.leaf)


def test_histograms_equal_brute_force():
    draw = np.random.default_rng(2)
    bins, node, g, h = draw.integers(0, 8, (50, 3)), draw.integers(0, 4, 50), draw.random(50), draw.random(50)
    got = B.histogram(bins, node, 4, g, h, 8)
    for n in range(4):
        for f in range(3):
            for b in range(8):
                at = (node == n) & (bins[:, f] == b)
                assert got[n, f, b] == pytest.approx([g[at].sum(), h[at].sum()])


def test_no_worse_than_one_against_the_rest(spark):
    x, y = three_classes()
    rows = table(spark, x, y)
    train, test = rows.where("fold = 0"), rows.where("fold = 1")

    def accuracy(model):
        out = model.transform(test).select("label", "prediction").collect()
        return np.mean([r.label == r.prediction for r in out])

    mine = accuracy(B.Boosting(loss="softmax", rounds=15, depth=3, weightCol="weight").fit(train))
    other = accuracy(OneVsRest(classifier=GBTClassifier(maxIter=5, maxDepth=3, weightCol="weight"), weightCol="weight").fit(train))
    assert mine >= other - 0.02 and mine > 0.85


@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_folds_equal_models_without_them(spark, loss):
    x, y = three_classes(300)
    y = y > 0 if loss == "logistic" else x[:, 0] * 3 + y
    rows = table(spark, x, y)
    est = B.Boosting(loss=loss, rounds=7, depth=2, weightCol="weight")
    model, scores = est.cross_validate(rows, 2)
    assert len(scores) == 2 and min(scores) > 0.6
    whole = est.fit(rows)
    a, b = (m.transform(rows).orderBy("features").select("prediction").toPandas()["prediction"] for m in (model, whole))
    assert np.abs(a - b).max() < 1e-9


def test_saved_model_gives_the_same(spark, tmp_path):
    x, y = three_classes(200)
    rows = table(spark, x, y)
    model = Pipeline(stages=[B.Boosting(loss="softmax", rounds=2, depth=2)]).fit(rows)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    get = lambda m: [tuple(r.probability) for r in m.transform(rows).select("probability").collect()]
    assert get(model) == get(again)
    out = model.transform(rows).first()
    assert abs(sum(out.probability) - 1) < 1e-12 and len(out.rawPrediction) == 3


def test_a_pass_holds_bytes_and_equals_lookups_by_row():
    draw = np.random.default_rng(3)
    import pandas as pd

    plain = draw.integers(0, 64, (400, 5)).astype(np.uint8)
    bins = B.bins_of(pd.DataFrame({"bins": [b.tobytes() for b in plain]}))
    assert bins.dtype == np.uint8 and bins.flags.f_contiguous and (bins == plain).all()
    tree = B.Tree(4)
    tree.feature[:], tree.cut[:] = draw.integers(0, 5, 15), draw.integers(0, 63, 15)
    tree.cut[2] = B.LEFT
    want = []
    for row in plain.astype(int):
        node = 0
        for level in range(4):
            at = 2**level - 1 + node
            node = 2 * node + int(row[tree.feature[at]] > tree.cut[at])
        want.append(node)
    assert tree.nodes(bins, 4).tolist() == want
    assert B.walk([tree], bins, 4).nbytes == 400


@pytest.mark.parametrize("parts", [1, 3])
def test_blocks_carry_margins_and_written_ones_go(spark, parts, monkeypatch):
    from pathlib import Path

    from matchlight.session import _scratch_root

    x, y = three_classes(300)
    monkeypatch.setattr(B, "STORE_EVERY", 2)
    folder = Path(_scratch_root(spark).removeprefix("file:"))
    before = {f.name for f in folder.glob("margins-*")}
    grown, _, stored, kept = B.grow(table(spark, x, y).coalesce(parts), "softmax", 2, 7, 2)
    blocks = kept[0].collect()
    assert sum(len(b.label) for b in blocks) == 300 and kept[0].is_cached
    assert (kept[0].getNumPartitions() == 1) == (parts == 1)
    assert sorted(b for k in blocks for b in map(bytes, k.bins)) == sorted(map(bytes, stored.toPandas()["bins"]))
    for block in blocks:
        assert np.allclose(block.margins, grown.margins(block._replace(margins=None)))
    assert len({f.name for f in folder.glob("margins-*")} - before) == 1
    for rdd in kept:
        rdd.unpersist(True)
    held = len(spark.sparkContext._jsc.getPersistentRDDs())
    B.Boosting(loss="softmax", rounds=3, depth=2).fit(table(spark, x, y))
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == held
