"""Weights of several scores: the best on a grid under several losses, in one pass over the rows."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.stats import ratio

LOSSES = ["log_loss", "brier", "neg_accuracy", "neg_f1"]


def simplex(n: int, steps: int) -> list[tuple[float, ...]]:
    """All weights of ``n`` scores in multiples of ``1 / steps`` that add up to one."""
    return [tuple(i / steps for i in (*c, steps - sum(c))) for c in product(range(steps + 1), repeat=n - 1) if sum(c) <= steps]


def losses(df: DataFrame, label: str, scores: list[str], steps: int = 10) -> DataFrame:
    """(weights, log_loss, brier, neg_accuracy, neg_f1) for each point of the grid. Sums are made before the shuffle; out-of-fold scores keep the choice honest."""
    grid = F.array(*(F.array(*map(F.lit, w)) for w in simplex(len(scores), steps)))
    p = sum((F.col("weights")[i] * F.col(s) for i, s in enumerate(scores)), F.lit(0.0))
    rows = df.select(F.col(label).alias("y"), *scores).dropna().withColumn("weights", F.explode(grid)).withColumn("p", F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15)))
    y, yes = F.col("y"), F.col("p") >= 0.5
    hits = {"tp": (y == 1) & yes, "fp": (y == 0) & yes, "fn": (y == 1) & ~yes, "tn": (y == 0) & ~yes}
    found = rows.groupBy("weights").agg(
        F.avg(-(y * F.ln("p") + (1 - y) * F.ln(1 - F.col("p")))).alias("log_loss"), F.avg(F.pow(F.col("p") - y, 2)).alias("brier"), *(F.count_if(c).alias(k) for k, c in hits.items()),
    )
    tp, fp, fn, tn = (F.col(k) for k in hits)
    return found.select("weights", "log_loss", "brier", (-ratio(tp + tn, tp + fp + fn + tn)).alias("neg_accuracy"), (-ratio(2 * tp, 2 * tp + fp + fn)).alias("neg_f1"))


def best(found: DataFrame, digits: int = 9) -> DataFrame:
    """(loss, value, weights): the best weights under each loss, ties to the first in order."""
    long = found.select("weights", F.inline(F.array(*(F.struct(F.lit(k).alias("loss"), F.round(k, digits).alias("value")) for k in LOSSES))))
    return long.groupBy("loss").agg(F.min(F.struct("value", "weights")).alias("m")).select("loss", "m.value", "m.weights")
