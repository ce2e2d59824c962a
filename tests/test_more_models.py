"""Extra trees, easy ensembles and stochastic gradient descent: saved, repeated, and as good as what they stand beside."""

import numpy as np
import pytest
from pyspark.ml import classification as C
from pyspark.sql import functions as F

from tessera.operators import models, random_trees, relational, sgd, stats, tree_shap


def made(spark, seed=0, n=1500, d=6, rare=0.5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    margin = 1.5 * x[:, 0] - x[:, 1] + 0.8 * x[:, 2] * x[:, 3] + rng.normal(0, 0.6, n)
    y = (margin > np.quantile(margin, 1 - rare)).astype(int)
    return models.assemble(spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "vec_id long, x array<double>, label int").repartition(3), array_col="x")


def auc(scored):
    return stats.roc_auc(scored, "label", "p").first()["auc"]


def test_extra_trees_are_near_the_forest_and_the_same_when_loaded(spark, tmp_path):
    df = relational.folds(made(spark), "label", "vec_id", 3)
    mine, theirs = None, models.cross_validate(df, C.RandomForestClassifier(numTrees=40, maxDepth=8, seed=1, labelCol="label"), 3)
    for k in range(3):
        trees = random_trees.extra_trees(df.filter(F.col("fold") != k), "label", "x", n_trees=40, max_depth=8, n_drawn=4)
        part = random_trees.score(df.filter(F.col("fold") == k).drop("features"), trees, "x").select("vec_id", "x", "label", "p")
        mine = part if mine is None else mine.unionByName(part)
    assert auc(mine) > auc(theirs) - 0.01
    random_trees.save(spark, trees, f"{tmp_path}/trees")
    again = random_trees.load(spark, f"{tmp_path}/trees")
    rows = df.filter("fold = 2").drop("features")
    first, second = ({r.vec_id: r.p for r in random_trees.score(rows, t, "x").collect()} for t in (trees, again))
    assert first == second
    same = random_trees.extra_trees(df.filter("fold <> 2").repartition(5), "label", "x", n_trees=3, max_depth=4, n_drawn=4)
    other = random_trees.extra_trees(df.filter("fold <> 2"), "label", "x", n_trees=3, max_depth=4, n_drawn=4)
    assert [{i: (n.feature, n.threshold) for i, n in t.nodes.items()} for t in same] == [{i: (n.feature, n.threshold) for i, n in t.nodes.items()} for t in other]
    for r in tree_shap.contributions(rows.limit(5), trees, "x", 6).collect():
        assert r.base + sum(r.contributions) == pytest.approx(r.margin, abs=1e-9)


def test_nodes_hold_the_rows_that_reach_them(spark):
    df = made(spark, 2, 300)
    trees = random_trees.extra_trees(df, "label", "x", n_trees=2, max_depth=5)
    rows = df.select("x", "label").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows])
    for tree in trees:
        assert len(tree.nodes) > 5
        for i, here in tree.reached(x).items():
            assert tree.nodes[i].cover == here.sum() and tree.nodes[i].value == pytest.approx(y[here].mean())
    null = spark.createDataFrame([(1, None, 1), (2, [0.0] * 6, 0)], "vec_id long, x array<double>, label int")
    assert {r.vec_id: r.p is None for r in random_trees.score(null, trees, "x").collect()} == {1: True, 2: False}
    assert len(random_trees.extra_trees(df.limit(0), "label", "x", n_trees=1)[0].nodes) == 1


def test_easy_ensemble_weights_and_recall(spark):
    df = made(spark, 3, 1500, rare=0.05)
    rows = df.select("vec_id", "label", "features", F.lit(1.0).alias("w"))
    tree, say, moved = random_trees.boosted_round(rows, 1, 1)
    wrong = {r.vec_id: r.prediction != r.label for r in tree.transform(rows).collect()}
    error = np.mean(list(wrong.values()))
    assert say == pytest.approx(np.log((1 - error) / error))
    weights = {i: np.exp(say) if bad else 1.0 for i, bad in wrong.items()}
    total = sum(weights.values())
    assert {r.vec_id: r.w for r in moved.collect()} == pytest.approx({i: w / total for i, w in weights.items()})
    train, test = df.filter("vec_id % 3 > 0"), df.filter("vec_id % 3 = 0")
    found = random_trees.easy_score(test, random_trees.easy_ensemble(train, bags=3, rounds=6))
    forest = models.positive(C.RandomForestClassifier(numTrees=20, maxDepth=8, seed=1, labelCol="label").fit(train).transform(test))
    recall = lambda scored: scored.filter("label = 1").agg(F.avg((F.col("p") >= 0.5).cast("int"))).first()[0]
    assert recall(found) > recall(forest)
    assert "x" in found.columns and not [c for c in found.columns if c.startswith("__")]


def test_sgd_is_repeatable_and_near_the_logistic_fit(spark):
    df = made(spark, 4, 2000)
    one, two = (sgd.fit(d, "label", "x", "vec_id", seed=7) for d in (df, df.repartition(7)))
    assert one.weights == pytest.approx(two.weights, abs=1e-9) and one.course == pytest.approx(two.course)
    fitted = C.LogisticRegression(labelCol="label", regParam=0.0).fit(df)
    loss = lambda scored: stats.log_loss(scored, "label", "p").first()["log_loss"]
    assert loss(one.score(df, "x")) < 1.01 * loss(models.positive(fitted.transform(df)))
    assert len(sgd.fit(df, "label", "x", "vec_id", seed=7, tolerance=0.01).course) < 20
    heavy = sgd.fit(made(spark, 5, 1500, rare=0.1), "label", "x", "vec_id", epochs=5, balanced=True)
    assert heavy.score(made(spark, 5, 1500, rare=0.1), "x").agg(F.avg("p")).first()[0] > 0.2
    assert sgd.fit(df.limit(0), "label", "x", "vec_id").weights == []
