"""Extra trees: forests with random cut points, grown level by level from sums over all rows; and easy ensembles: boosted stumps on balanced bags.

All trees of a forest grow together. For each open node some features are drawn, a first pass finds their ranges among the node's rows, a cut is drawn evenly from each range, and a
second pass sums the labels' weights on both sides of every cut; the cut with the largest fall in impurity splits the node. Tasks send one
row for each open node and feature, so what moves is the size of the level, whatever the rows. A grown forest is a list of node tables
(``tree_shap.Tree``): it scores, explains, saves and loads.

Defined cases: rows with a null label or vector teach nothing, null vectors get a null score; missing values (NaN) go right. Without rows, or with one label, a tree is one leaf.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import classification as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tree_shap import Node, Tree, contributions, rows_of
from tessera.sources.workdir import materialise

NODES = "tree int, id int, feature int, threshold double, left int, right int, value double, cover double, weight double"


def impurity(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Gini impurity times weight."""
    share = np.divide(p, n, out=np.zeros_like(p, dtype=float), where=n > 0)
    return n * 2 * share * (1 - share)


def summed(df: DataFrame, trees: list[dict[int, Node]], wanted: dict[tuple[int, int], np.ndarray], cuts: np.ndarray | None) -> dict[tuple[int, int], np.ndarray]:
    """For each open node (tree, id): smallest and largest values of its drawn features, or with ``cuts`` the weights (left, left of label 1, all, all of label 1)."""
    keys = list(wanted)
    drawn, width = np.array([wanted[k] for k in keys]), 2 if cuts is None else 4
    nodes = [Tree.__new__(Tree) for _ in trees]
    for tree, own in zip(nodes, trees, strict=True):
        tree.nodes = own

    def run(batches):
        total = np.zeros((len(keys), drawn.shape[1], width))
        total[:, :, 0], total[:, :, 1] = (np.inf, -np.inf) if cuts is None else (0, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, w = rows_of(batch.column("x")), batch.column("y").to_numpy(), batch.column("w").to_numpy()
            reached = [tree.reached(x) for tree in nodes]
            for at, (t, i) in enumerate(keys):
                here = reached[t][i]
                values = x[here][:, drawn[at]]
                if not len(values):
                    continue
                if cuts is None:
                    total[at, :, 0] = np.fmin(total[at, :, 0], np.fmin.reduce(values, 0))
                    total[at, :, 1] = np.fmax(total[at, :, 1], np.fmax.reduce(values, 0))
                else:
                    left, mine, one = values <= cuts[at], w[here], w[here] * (y[here] > 0)
                    total[at] += np.stack([mine @ left, one @ left, np.full(left.shape[1], mine.sum()), np.full(left.shape[1], one.sum())], axis=1)
        at, feature = np.indices(total.shape[:2]).reshape(2, -1)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "f": pa.array(feature, pa.int32())} | {f"s{k}": pa.array(total[:, :, k].ravel(), pa.float64()) for k in range(width)})

    schema = "at int, f int, " + ", ".join(f"s{k} double" for k in range(width))
    each = (F.min("s0").alias("s0"), F.max("s1").alias("s1")) if cuts is None else tuple(F.sum(f"s{k}").alias(f"s{k}") for k in range(width))
    out = np.zeros((len(keys), drawn.shape[1], width))
    for r in df.mapInArrow(run, schema).groupBy("at", "f").agg(*each).collect():  # a row for each drawn feature of an open node
        out[r["at"], r["f"]] = [r[f"s{k}"] for k in range(width)]
    return dict(zip(keys, out, strict=True))


def extra_trees(df: DataFrame, label: str, array_col: str, n_trees: int = 60, max_depth: int = 8, n_drawn: int | None = None, least: float = 2.0, weight_col: str | None = None, seed: int = 42) -> list[Tree]:
    """A forest on all rows, each row weighing its ``weight_col``; nodes of less than ``least`` weight stay leaves."""
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    rows = materialise(df.select(F.col(array_col).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), weight.alias("w")).filter("x IS NOT NULL AND y IS NOT NULL"), "tree-rows")
    whole = rows.agg(F.max(F.size("x")).alias("d"), F.sum("w").alias("n"), F.sum(F.when(F.col("y") > 0, F.col("w")).otherwise(0)).alias("p")).first()
    n, d = whole["n"] or 0.0, whole["d"] or 0
    trees = [{0: Node(value=whole["p"] / n if n else 0.0, cover=n)} for _ in range(n_trees)]
    rng, drawn = np.random.default_rng(seed), min(d, n_drawn or max(1, round(d**0.5)))
    open_ = [(t, 0) for t in range(n_trees)] if n else []
    for _ in range(max_depth):
        open_ = [(t, i) for t, i in open_ if trees[t][i].cover >= least and 0 < trees[t][i].value < 1]
        if not open_:
            break
        wanted = {k: rng.permutation(d)[:drawn] for k in open_}
        ranges = summed(rows, trees, wanted, None)
        low, high = (np.array([ranges[k][:, side] for k in open_]) for side in (0, 1))
        spread = np.isfinite(low) & np.isfinite(high) & (high > low)
        cuts = np.where(spread, low + np.where(spread, high - low, 0) * rng.random(low.shape), np.nan)
        sums = summed(rows, trees, wanted, cuts)
        grown = []
        for at, key in enumerate(open_):
            left, left_p, all_, all_p = sums[key].T
            gain = impurity(all_p, all_) - impurity(left_p, left) - impurity(all_p - left_p, all_ - left)
            gain = np.where((left > 0) & (left < all_), gain, -np.inf)
            best = int(gain.argmax())
            if not gain[best] > 0:
                continue
            t, i = key
            node, next_ = trees[t][i], max(trees[t]) + 1
            node.feature, node.threshold, node.left, node.right = int(wanted[key][best]), float(cuts[at, best]), next_, next_ + 1
            for child, weight_, ones in ((next_, left[best], left_p[best]), (next_ + 1, all_[best] - left[best], all_p[best] - left_p[best])):
                trees[t][child] = Node(value=float(ones / weight_), cover=float(weight_))
                grown.append((t, child))
        open_ = grown
    return [Tree(nodes, 1 / n_trees) for nodes in trees]


def score(df: DataFrame, trees: list[Tree], array_col: str, out: str = "p") -> DataFrame:
    """``df`` with the forest's probability of label 1."""
    columns = df.columns

    def run(batches):
        for batch in batches:
            given = batch.column("__x")
            known = np.flatnonzero(given.is_valid().to_numpy(zero_copy_only=False))
            values = [None] * batch.num_rows
            if len(known):
                x = rows_of(given.take(pa.array(known)))
                for place, p in zip(known.tolist(), sum(tree.margin(x) for tree in trees).tolist(), strict=True):
                    values[place] = p
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(values, pa.float64())], names=[*columns, "__p"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    scored = df.select("*", F.col(array_col).cast("array<double>").alias("__x")).mapInArrow(run, f"{schema}, __p double")
    return scored.drop(out).withColumnRenamed("__p", out) if out in columns else scored.withColumnRenamed("__p", out)


def save(spark: SparkSession, trees: list[Tree], path: str) -> None:
    """A row a node."""
    rows = [(t, i, n.feature, float(n.threshold), n.left, n.right, float(n.value), float(n.cover), tree.weight) for t, tree in enumerate(trees) for i, n in tree.nodes.items()]
    spark.createDataFrame(rows, NODES).coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> list[Tree]:
    found: dict[int, tuple[dict[int, Node], float]] = {}
    for r in spark.read.schema(NODES).parquet(path).collect():  # the model
        nodes, _ = found.setdefault(r["tree"], ({}, r["weight"]))
        nodes[r["id"]] = Node(feature=r["feature"], threshold=r["threshold"], left=r["left"], right=r["right"], value=r["value"], cover=r["cover"])
    return [Tree(nodes, weight) for _, (nodes, weight) in sorted(found.items())]


def explain(df: DataFrame, trees: list[Tree], array_col: str, n_features: int) -> DataFrame:
    return contributions(df, trees, array_col, n_features)


def boosted_round(rows: DataFrame, depth: int, seed: int, label: str = "label") -> tuple[object, float, DataFrame]:
    """One round of boosting: a tree on weighted rows, its say, and the rows with their new ``w`` (adding up to one)."""
    tree = C.DecisionTreeClassifier(maxDepth=depth, seed=seed, labelCol=label, featuresCol="features", weightCol="w").fit(rows)
    judged = tree.transform(rows).withColumn("__wrong", F.col("prediction") != F.col(label))
    row = judged.agg(F.sum("w").alias("all"), F.sum(F.when(F.col("__wrong"), F.col("w")).otherwise(0)).alias("wrong")).first()
    error = min(max(row["wrong"] / row["all"], 1e-10), 1 - 1e-10)
    say = float(np.log((1 - error) / error))
    # wrong ones weigh more; the new total is known before the rows are
    total = row["all"] - row["wrong"] + row["wrong"] * np.exp(say)
    moved = judged.withColumn("w", F.col("w") * F.when(F.col("__wrong"), float(np.exp(say))).otherwise(1.0) / float(total))
    return tree, say, moved.select(*rows.columns)


def easy_ensemble(df: DataFrame, label: str = "label", key: str = "vec_id", bags: int = 5, rounds: int = 10, depth: int = 1, seed: int = 42) -> list[list[tuple[object, float]]]:
    """For each bag, with as many rows of one label as of the other about, the trees of its rounds and their says; ``df`` has ``features``."""
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    least, out = min(sizes.values(), default=0), []
    for bag in range(bags):
        draw = F.pmod(F.xxhash64(F.lit(seed + bag), F.col(key)), F.lit(1 << 20)) / float(1 << 20)
        keep = F.lit(False)
        for value, n in sizes.items():
            keep = keep | ((F.col(label) == value) & (draw < least / n))
        rows = materialise(df.filter(keep).select(label, "features", F.lit(1.0).alias("w")), "bag")
        chain = []
        for k in range(rounds):
            tree, say, rows = boosted_round(rows, depth, seed + k, label)
            rows = materialise(rows, "bag")
            chain.append((tree, say))
            if say > 20 or say <= 0:
                break
        out.append(chain)
    return out


def easy_score(df: DataFrame, ensemble: list[list[tuple[object, float]]], out: str = "p") -> DataFrame:
    """``df`` with the mean over the bags of the share of their trees' says that are for label 1."""
    bags = []
    for b, chain in enumerate(ensemble):
        total = sum(max(say, 0.0) for _, say in chain) or 1.0
        votes = F.lit(0.0)
        for k, (tree, say) in enumerate(chain):
            own = tree.copy().setPredictionCol(f"__v{b}_{k}").setRawPredictionCol("").setProbabilityCol("")
            df = own.transform(df)
            votes = votes + F.col(f"__v{b}_{k}") * max(say, 0.0)
        df = df.withColumn(f"__b{b}", votes / total).drop(*(f"__v{b}_{k}" for k in range(len(chain))))
    return df.withColumn(out, sum((F.col(f"__b{b}") for b in range(len(ensemble))), F.lit(0.0)) / max(len(ensemble), 1)).drop(*(f"__b{b}" for b in range(len(ensemble))))
