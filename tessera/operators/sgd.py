"""Logistic regression by stochastic gradient descent: mini-batches within parts of the rows, weights averaged over the parts after each epoch.

Rows are dealt to parts by a hash of their key and written once, so the course depends on the seed and the rows alone, not on the cluster. A part's order
changes from epoch to epoch. After each epoch the parts' weights are averaged by their rows, and the loss on rows held out by hash decides whether to go on; the
weights of the best epoch are kept. What moves is one vector a part.

Defined cases: rows with a null label or vector teach nothing. Without rows, or without held-out rows, all epochs run. Features without spread have weight zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.workdir import materialise

#: Of 1,000 rows, those held out for the early stop.
HELD_OUT = 100
#: Rows of a part, from which on there are more parts.
PART_ROWS = 100_000


@dataclass
class Linear:
    """Weights and intercept on the features as they are, and the held-out loss of each epoch."""

    weights: list[float]
    intercept: float
    course: list[float]

    def margin(self, array_col: str) -> Column:
        pairs = F.zip_with(F.col(array_col).cast("array<double>"), F.array(*map(F.lit, self.weights)), lambda x, w: x * w)
        return F.aggregate(pairs, F.lit(float(self.intercept)), lambda a, x: a + x)

    def score(self, df: DataFrame, array_col: str, out: str = "p") -> DataFrame:
        return df.withColumn(out, 1 / (1 + F.exp(-self.margin(array_col))))


def log_loss(scored: DataFrame, label: str, p: str, weight: Column) -> float | None:
    c = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(F.col(label) * F.ln(c) + (1 - F.col(label)) * F.ln(1 - c))
    return scored.agg(F.try_divide(F.sum(weight * loss), F.sum(weight))).first()[0]


def fit(df: DataFrame, label: str, array_col: str, key: str, epochs: int = 40, batch_rows: int = 16, rate: float = 0.5, l2: float = 1e-4, balanced: bool = False, parts: int = 8, patience: int = 3, tolerance: float = 1e-5, seed: int = 42) -> Linear:
    """``balanced``: each label weighs the same in all. The step falls with the root of the epoch."""
    own = df.select(F.col(label).cast("double").alias("y"), F.col(array_col).cast("array<double>").alias("x"), F.xxhash64(F.lit(seed), F.col(key)).alias("h")).filter("y IS NOT NULL AND x IS NOT NULL")
    held = F.pmod(F.xxhash64("h"), F.lit(1000)) < HELD_OUT
    parts = max(parts, -(-own.count() // PART_ROWS))
    rows = materialise(own.withColumn("held", held).withColumn("part", F.pmod("h", F.lit(parts)).cast("int")), "sgd-rows")
    train, test = rows.filter("NOT held"), rows.filter("held")
    shape = train.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"), F.max(F.size("x")).alias("d")).first()
    if not shape["n"]:
        return Linear([], 0.0, [])
    d, share = shape["d"], shape["p"] / shape["n"]
    heavy = (0.5 / share if share > 0 else 1.0, 0.5 / (1 - share) if share < 1 else 1.0) if balanced else (1.0, 1.0)
    # one row a feature
    spread = {r["i"]: (r["m"], r["s"]) for r in train.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()}
    mean, scale = (np.array([spread[i][k] for i in range(d)]) for k in (0, 1))
    scale = np.where(scale > 0, scale, np.inf)
    weight = F.when(F.col("y") > 0, heavy[0]).otherwise(heavy[1])
    w, best, course, worse = np.zeros(d + 1), (None, np.zeros(d + 1)), [], 0

    def linear(w: np.ndarray) -> Linear:
        raw = w[:-1] / scale
        return Linear(raw.tolist(), float(w[-1] - raw @ mean), course)

    def learner(w: np.ndarray, step: float, order_seed: int):
        """A part's rows from first to last, in an order of their own each epoch."""
        mixer = np.random.default_rng(order_seed).integers(0, 1 << 62)

        def learn(table):
            y, h = table.column("y").to_numpy(), table.column("h").to_numpy()
            x = (np.array(table.column("x").to_pylist()) - mean) / scale
            v, order = w.copy(), np.argsort(h ^ mixer, kind="stable")
            for at in range(0, len(order), batch_rows):
                some = order[at : at + batch_rows]
                gap = (1 / (1 + np.exp(-np.clip(x[some] @ v[:-1] + v[-1], -30, 30))) - y[some]) * np.where(y[some] > 0, *heavy)
                v[:-1] -= step * (gap @ x[some] / len(some) + l2 * v[:-1])
                v[-1] -= step * gap.mean()
            return pa.table({"i": pa.array(np.arange(d + 1), pa.int32()), "w": v * len(order), "n": pa.array(np.full(d + 1, len(order)), pa.int64())})

        return learn

    for epoch in range(epochs):
        # a part is a block of about PART_ROWS rows at most
        learnt = train.groupBy("part").applyInArrow(learner(w, rate / np.sqrt(1 + epoch), seed + epoch), "i int, w double, n long").groupBy("i").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
        w = np.zeros(d + 1)
        for r in learnt.collect():  # a row a feature
            w[r["i"]] = r["w"] / r["n"]
        loss = log_loss(linear(w).score(test, "x"), "y", "p", weight)
        course.append(loss)
        if loss is None or best[0] is None or loss < best[0] - tolerance:
            best, worse = (loss, w), 0
        else:
            worse += 1
            if worse >= patience:
                break
    return linear(best[1])
