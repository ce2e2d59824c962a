"""Weights of several scores, fitted on the simplex without a grid.

Log loss and Brier score are smooth: each step takes value, gradient and curvature from one aggregate over the rows, minimises the quadratic they give over
the simplex, and a second aggregate tries shorter and shorter parts of that step. Accuracy and F1 are steps: along the exchange of weight between two
scores every row changes its decision at one point, so the counts after each of these break points, summed up in order over ranges of rows, give
the best exchange exactly. Exchanges are repeated for all pairs while one of them helps. All fits begin at the best point of a coarse
grid and never leave it for a worse one.

Defined cases: rows with a null label or score are left out; without rows weights are equal and the value is null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import ensembles
from tessera.operators.ranks import running_sums
from tessera.sources.workdir import materialise

SMOOTH = ("log_loss", "brier")
EDGE = 1e-15
#: Steps of a smooth fit, halvings of one step, and rounds of exchanges over all pairs.
STEPS, HALVINGS, ROUNDS = 30, 24, 10


def onto_simplex(v: np.ndarray) -> np.ndarray:
    """The nearest weights that are not negative and add up to one."""
    u = np.sort(v)[::-1]
    excess = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - excess[np.flatnonzero(u > excess)[-1]], 0)


def least_quadratic(w: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """Weights that minimise the quadratic about ``w``, by projected gradient steps on the driver (as many numbers as scores)."""
    rate, x = 1 / max(float(np.linalg.eigvalsh(curvature)[-1]), 1e-12), w.copy()
    for _ in range(5000):
        y = onto_simplex(x - rate * (gradient + curvature @ (x - w)))
        if np.abs(y - x).max() < 1e-14:
            break
        x = y
    return x


def blend(scores: list[str], w) -> Column:
    return sum((F.lit(float(a)) * F.col(s) for a, s in zip(w, scores, strict=True)), F.lit(0.0))


def loss_of(loss: str, y: Column, p: Column) -> Column:
    """Mean loss as an aggregate."""
    c = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    if loss == "log_loss":
        return F.avg(-(y * F.ln(c) + (1 - y) * F.ln(1 - c)))
    if loss == "brier":
        return F.avg(F.pow(c - y, 2))
    yes, n = c >= 0.5, F.count(F.lit(1))
    tp, fp, fn = (F.count_if(x) for x in ((y == 1) & yes, (y == 0) & yes, (y == 1) & ~yes))
    if loss == "neg_accuracy":
        return -(n - fp - fn) / n
    return -F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def values(rows: DataFrame, loss: str, scores: list[str], points: list[np.ndarray]) -> list[float]:
    """The loss at several weights, in one aggregate."""
    return list(rows.agg(*(loss_of(loss, F.col("y"), blend(scores, w)).alias(f"l{i}") for i, w in enumerate(points))).first())


def slope(rows: DataFrame, loss: str, scores: list[str], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of a smooth loss."""
    y, p = F.col("y"), F.least(F.greatest(blend(scores, w), F.lit(EDGE)), F.lit(1 - EDGE))
    if loss == "log_loss":
        first, second = (p - y) / (p * (1 - p)), y / (p * p) + (1 - y) / ((1 - p) * (1 - p))
    else:
        first, second = 2 * (p - y), F.lit(2.0)
    k, pairs = len(scores), [(i, j) for i in range(len(scores)) for j in range(i + 1)]
    row = rows.agg(*(F.avg(first * F.col(s)) for s in scores), *(F.avg(second * F.col(scores[i]) * F.col(scores[j])) for i, j in pairs)).first()
    curvature = np.zeros((k, k))
    for (i, j), h in zip(pairs, row[k:], strict=True):
        curvature[i, j] = curvature[j, i] = h
    return np.array(row[:k]), curvature


def smooth_fit(rows: DataFrame, loss: str, scores: list[str], w: np.ndarray, value: float, tolerance: float) -> tuple[np.ndarray, float]:
    for _ in range(STEPS):
        aim = least_quadratic(w, *slope(rows, loss, scores, w))
        points = [w + (aim - w) * 0.5**h for h in range(HALVINGS)]
        found = values(rows, loss, scores, points)
        best = int(np.argmin(found))
        if not found[best] < value - tolerance:
            break
        w, value = points[best], found[best]
    return w, value


def best_exchange(rows: DataFrame, loss: str, scores: list[str], w: np.ndarray, i: int, j: int) -> float | None:
    """How much weight to move from score j to score i; counts change only where a row's blend crosses one half."""
    low, high = -float(w[i]), float(w[j])
    if low >= high:
        return None
    p, gap, y = blend(scores, w), F.col(scores[i]) - F.col(scores[j]), F.col("y")
    at = F.when(gap != 0, (0.5 - p) / gap)
    own = rows.select("y", at.alias("t"), F.signum(gap).cast("long").alias("up"), (p >= 0.5).alias("now"))
    t, up = F.col("t"), F.col("up")
    begin = F.when(up > 0, t <= low).when(up < 0, t > low).otherwise(F.col("now"))
    row = own.agg(F.count_if(begin & (y == 1)).alias("tp"), F.count_if(begin & (y == 0)).alias("fp"), F.count_if(y == 1).alias("p"), F.count(F.lit(1)).alias("n")).first()
    events = own.filter((t > low) & (t < high)).groupBy("t").agg(F.sum(F.when(y == 1, up).otherwise(0)).alias("tp"), F.sum(F.when(y == 0, up).otherwise(0)).alias("fp"))
    after = running_sums(events, "t", {"tp": "tp", "fp": "fp"})
    tp, fp = F.col("tp") + F.lit(row["tp"]), F.col("fp") + F.lit(row["fp"])

    # accuracy or F1 as a fraction of counts
    part = lambda tp, fp: tp + (row["n"] - row["p"]) - fp if loss == "neg_accuracy" else 2 * tp
    whole = lambda tp, fp: F.lit(row["n"]) if loss == "neg_accuracy" else tp + fp + row["p"]
    gain = F.coalesce(F.try_divide(part(tp, fp), whole(tp, fp)), F.lit(0.0))
    first = events.agg(F.min("t").alias("t")).select("t", F.lit(row["tp"]).alias("tp"), F.lit(row["fp"]).alias("fp"))
    none_crossed = first.select(F.coalesce(F.try_divide(part(F.col("tp"), F.col("fp")), whole(F.col("tp"), F.col("fp"))), F.lit(0.0)).alias("gain"), "t").first()
    top = after.agg(F.max(F.struct(gain.alias("gain"), (-t).alias("minus"))).alias("m")).select("m.*").first()
    if top["gain"] is None or none_crossed["gain"] >= top["gain"]:
        start, bound = low, none_crossed["t"]
    else:
        start = -top["minus"]
        bound = events.filter(t > start).agg(F.min("t")).first()[0]
    return (start + (high if bound is None else bound)) / 2


def step_fit(rows: DataFrame, loss: str, scores: list[str], w: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    for _ in range(ROUNDS):
        before = value
        for i, j in combinations(range(len(scores)), 2):
            move = best_exchange(rows, loss, scores, w, i, j)
            if move is None:
                continue
            moved = w.copy()
            moved[i] += move
            moved[j] -= move
            found = values(rows, loss, scores, [moved])[0]
            if found < value:
                w, value = moved, found
        if not value < before:
            break
    return w, value


def fit(df: DataFrame, label: str, scores: list[str], losses: tuple[str, ...] = (*SMOOTH, "neg_accuracy", "neg_f1"), steps: int = 10, tolerance: float = 1e-10) -> DataFrame:
    """(loss, value, weights, grid_value): fitted weights under each loss, and the value of the best point of the grid it began at."""
    spark = df.sparkSession
    rows = materialise(df.select(F.col(label).cast("int").alias("y"), *(F.col(s).cast("double").alias(s) for s in scores)).dropna(), "weight-rows")
    grid = {r["loss"]: r for r in ensembles.best(ensembles.losses(rows, "y", scores, steps)).collect()}  # a row a loss
    out = []
    for loss in losses:
        if loss not in grid:
            out.append((loss, None, [1 / len(scores)] * len(scores), None))
            continue
        w = np.array(grid[loss]["weights"], np.float64)
        start = values(rows, loss, scores, [w])[0]
        w, value = smooth_fit(rows, loss, scores, w, start, tolerance) if loss in SMOOTH else step_fit(rows, loss, scores, w, start)
        out.append((loss, float(value), w.tolist(), float(start)))
    return spark.createDataFrame(out, "loss string, value double, weights array<double>, grid_value double")
