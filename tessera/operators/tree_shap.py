"""Exact additive contributions of tree models: which feature moved a row's margin by how much.

The contributions are Shapley values of the path-dependent expectation: a feature that is not given is averaged over by the shares of rows that
went either way at its splits. A path to a leaf has few distinct features, and a row either passes all of a feature's splits on it or not, so
a row's pattern on a path is a few bits; the weights of a pattern come from the coefficients of the product of ``(share + passed * y)`` over the path's features,
with one factor divided out for each feature. Patterns are looked up, so the work per row is the number of splits and leaves.

Contributions and base value add up to the model's margin on every row: the mean probability of label 1 for a forest, the weighted sum of
trees for boosted trees (half the log odds).

Defined cases: missing values (NaN) go to the right at every split, as in the models; null vectors give null contributions. A node that no row reached
sends half of its share either way. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import workdir


@dataclass
class Node:
    """A split (rows with a value of at most ``threshold``, or of one of ``categories``, go left) or a leaf."""

    feature: int = -1
    threshold: float = 0.0
    categories: frozenset[float] | None = None
    left: int = -1
    right: int = -1
    value: float = 0.0
    cover: float = 0.0

    def goes_left(self, x: np.ndarray) -> np.ndarray:
        values = x[:, self.feature]
        return np.isin(values, list(self.categories)) if self.categories is not None else values <= self.threshold


@dataclass
class Tree:
    """Nodes by number; 0 is the root."""

    nodes: dict[int, Node]
    weight: float = 1.0
    paths: list[tuple[int, list[int], list[list[tuple[int, bool]]], np.ndarray]] = field(default_factory=list)

    def __post_init__(self):
        self.recount({i: n.cover for i, n in self.nodes.items()})

    def recount(self, cover: dict[int, float]) -> Tree:
        """Sets what reached each node, and each leaf's path: its features, their splits with sides, and the shares that went the path's way."""
        for i, n in self.nodes.items():
            n.cover = float(cover.get(i, 0.0))
        self.paths, todo = [], [(0, {})]
        while todo:
            at, seen = todo.pop()
            node = self.nodes[at]
            if node.feature < 0:
                self.paths.append((at, list(seen), [s for s, _ in seen.values()], np.array([z for _, z in seen.values()])))
                continue
            for child, left in ((node.right, False), (node.left, True)):
                share = self.nodes[child].cover / node.cover if node.cover > 0 else 0.5
                splits, z = seen.get(node.feature, ([], 1.0))
                todo.append((child, seen | {node.feature: ([*splits, (at, left)], z * share)}))
        return self

    def base(self) -> float:
        return self.weight * sum(self.nodes[leaf].value * float(np.prod(z)) for leaf, _, _, z in self.paths)

    def left(self, x: np.ndarray) -> dict[int, np.ndarray]:
        return {i: n.goes_left(x) for i, n in self.nodes.items() if n.feature >= 0}

    def reached(self, x: np.ndarray) -> dict[int, np.ndarray]:
        """Rows that come to each node."""
        left, rows = self.left(x), {0: np.ones(len(x), bool)}
        todo = [0]
        while todo:
            at = todo.pop()
            node = self.nodes[at]
            if node.feature >= 0:
                rows[node.left], rows[node.right] = rows[at] & left[at], rows[at] & ~left[at]
                todo += [node.left, node.right]
        return rows

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = self.reached(x)
        return self.weight * sum(self.nodes[leaf].value * rows[leaf] for leaf, *_ in self.paths)

    def add_contributions(self, x: np.ndarray, phi: np.ndarray) -> None:
        left = self.left(x)
        for leaf, features, splits, z in self.paths:
            value = self.weight * self.nodes[leaf].value
            if not features or value == 0:
                continue
            bits = np.zeros(len(x), np.int64)
            for j, mine in enumerate(splits):
                passed = np.ones(len(x), bool)
                for at, side in mine:
                    passed &= left[at] == side
                bits |= passed.astype(np.int64) << j
            present, place = np.unique(bits, return_inverse=True)
            passed = (present[:, None] >> np.arange(len(z)) & 1).astype(np.float64)
            phi[:, features] += value * shares(passed, z)[place]


def shares(passed: np.ndarray, z: np.ndarray) -> np.ndarray:
    """For each pattern (row) and feature: the part of a leaf's value that is the feature's."""
    d = len(z)
    weight = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
    product = np.zeros((len(passed), d + 1))
    product[:, 0] = 1
    for j in range(d):
        product[:, 1:] = product[:, 1:] * z[j] + product[:, :-1] * passed[:, j, None]
        product[:, 0] *= z[j]
    out = np.empty((len(passed), d))
    for j in range(d):
        # where the feature passed, the factor (z + y) is divided out from the top; else it is z alone
        rest = np.zeros((len(passed), d))
        rest[:, d - 1] = product[:, d]
        for k in range(d - 1, 0, -1):
            rest[:, k - 1] = product[:, k] - z[j] * rest[:, k]
        other = product[:, :d] / z[j] if z[j] > 0 else np.zeros((len(passed), d))
        out[:, j] = (passed[:, j] - z[j]) * (np.where(passed[:, j, None] > 0, rest, other) @ weight)
    return out


def from_model(spark: SparkSession, model) -> list[Tree]:
    """Node tables of a fitted forest, boosted model or single tree of Spark ML, read from its saved form; their size is the model's."""
    path = workdir.shared(spark, "trees")
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data")
    if "nodeData" in rows.columns:
        rows = rows.select("treeID", "nodeData.*")
    else:
        rows = rows.withColumn("treeID", F.lit(0))
    boosted = hasattr(model, "treeWeights") and "GBT" in type(model).__name__
    weights = list(model.treeWeights) if boosted else [1 / model.getNumTrees] * model.getNumTrees if hasattr(model, "trees") else [1.0]
    nodes: list[dict[int, Node]] = [{} for _ in weights]
    regression = boosted or "Regression" in type(model).__name__
    for r in rows.collect():
        stats, split = r["impurityStats"], r["split"]
        # counts, sums and squares where numbers are predicted; else what each label weighs
        node = Node(cover=stats[0], value=r["prediction"]) if regression else Node(cover=sum(stats), value=stats[1] / sum(stats) if len(stats) > 1 else 0.0)
        if r["leftChild"] >= 0:
            node.feature, node.left, node.right = split["featureIndex"], r["leftChild"], r["rightChild"]
            if split["numCategories"] < 0:
                node.threshold = split["leftCategoriesOrThreshold"][0]
            else:
                node.categories = frozenset(split["leftCategoriesOrThreshold"])
        nodes[r["treeID"]][r["id"]] = node
    workdir.remove(spark, path)
    return [Tree(n, w) for n, w in zip(nodes, weights, strict=True)]


def rows_of(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def covered(trees: list[Tree], df: DataFrame, array_col: str) -> list[Tree]:
    """The trees with the rows of ``df`` counted at every node, instead of those that they were fitted to."""

    def run(batches):
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            x = rows_of(batch.column(0))
            for t, tree in enumerate(trees):
                for i, rows in tree.reached(x).items() if len(x) else ():
                    total[t, i] = total.get((t, i), 0) + int(rows.sum())
        yield pa.RecordBatch.from_pydict({"t": pa.array([t for t, _ in total], pa.int32()), "i": pa.array([i for _, i in total], pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    counted = df.select(F.col(array_col).cast("array<double>").alias("x")).filter("x IS NOT NULL").mapInArrow(run, "t int, i int, n long").groupBy("t", "i").agg(F.sum("n").alias("n"))
    found: list[dict[int, float]] = [{} for _ in trees]
    for r in counted.collect():  # a row a node
        found[r["t"]][r["i"]] = r["n"]
    return [tree.recount(cover) for tree, cover in zip(trees, found, strict=True)]


def contributions(df: DataFrame, trees: list[Tree], array_col: str, n_features: int) -> DataFrame:
    """``df`` with ``base``, ``margin`` and ``contributions``, one for each feature; added or replaced."""
    df = df.drop("base", "margin", "contributions")
    base, columns = sum(tree.base() for tree in trees), df.columns

    def run(batches):
        for batch in batches:
            given, n = batch.column("__x"), batch.num_rows
            known = np.flatnonzero(given.is_valid().to_numpy(zero_copy_only=False))
            x = rows_of(given.take(pa.array(known))).reshape(-1, n_features)
            phi, margin = np.zeros((len(known), n_features)), np.zeros(len(known))
            for tree in trees:
                tree.add_contributions(x, phi)
                margin += tree.margin(x)
            lists, margins = [None] * n, [None] * n
            for place, row, m in zip(known.tolist(), phi.tolist(), margin.tolist(), strict=True):
                lists[place], margins[place] = row, m
            own = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array([base] * n, pa.float64()), pa.array(margins, pa.float64()), pa.array(lists, pa.list_(pa.float64()))], names=[*columns, "base", "margin", "contributions"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.select("*", F.col(array_col).cast("array<double>").alias("__x")).mapInArrow(run, f"{schema}, base double, margin double, contributions array<double>")


def mean_contributions(explained: DataFrame, names: list[str], top_n: int | None = None) -> DataFrame:
    """(rank, feature, index, mean_abs, mean): the features by the mean size of their contributions, over all rows; ties by index."""
    each = explained.select(F.posexplode("contributions").alias("index", "c")).groupBy("index").agg(F.avg(F.abs("c")).alias("mean_abs"), F.avg("c").alias("mean"))
    known = explained.sparkSession.createDataFrame(list(enumerate(names)), "index int, feature string")
    # a row a feature from here on
    top = each.join(F.broadcast(known), "index").orderBy(F.desc("mean_abs"), "index").limit(top_n or len(names)).collect()
    rows = [(i + 1, r["feature"], r["index"], r["mean_abs"], r["mean"]) for i, r in enumerate(top)]
    return explained.sparkSession.createDataFrame(rows, "rank int, feature string, index int, mean_abs double, mean double")
