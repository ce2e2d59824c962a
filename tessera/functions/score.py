"""Scores, bands and decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted(parts: list[tuple[Column, float]], default: float = 0.5, renormalise: bool = True) -> Column:
    """Weighted mean over the parts that are not null; ``default`` where none has weight."""
    total = sum((F.coalesce(p * w, F.lit(0.0)) for p, w in parts), F.lit(0.0))
    weight = sum((F.when(p.isNull(), 0.0).otherwise(w) for p, w in parts), F.lit(0.0))
    if not renormalise:
        return F.when(weight == 0, default).otherwise(total)
    return F.when(F.abs(weight) < 1e-12, default).otherwise(total / weight)


def verdict(p: Column, threshold: float = 0.5, strict: bool = False) -> Column:
    return F.when(p > threshold if strict else p >= threshold, "phishing").otherwise("legit")


def user_verdict(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p >= threshold, "suspicious").otherwise("safe")


def confidence(p: Column) -> Column:
    """0 to 1 by the distance from one half."""
    return F.abs(p - 0.5) * 2


def confidence_band(p: Column) -> Column:
    away = F.abs(p - 0.5)
    return F.when(away > 0.3, "high").when(away > 0.15, "medium").otherwise("low")


def risk_level(p: Column) -> Column:
    return F.when(p >= 0.8, "critical").when(p >= 0.6, "high").when(p >= 0.4, "medium").when(p >= 0.2, "low").otherwise("minimal")


def composite(accuracy: Column, fpr: Column, p95_ms: Column, f1: Column) -> Column:
    """Ranking score of a model: accuracy, false positives, latency (300 ms counts as worst) and F1."""
    return 0.4 * accuracy + 0.3 * (1 - fpr) + 0.2 * (1 - F.least(p95_ms / 300.0, F.lit(1.0))) + 0.1 * f1


def tradeoff(roc: Column, ms: Column) -> Column:
    return roc - 0.3 * (ms / 1000.0)


def inverse_error_weights(errors: list[Column]) -> list[Column]:
    """Weights in proportion to 1 / (error + 0.001)."""
    inverse = [1.0 / (e + 0.001) for e in errors]
    return [i / sum(inverse[1:], inverse[0]) for i in inverse]


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").when(score >= 40, "D").otherwise("F")


def coverage(n: Column, target: int) -> Column:
    return F.least(n / float(target), F.lit(1.0)) * 100


def translate_value(name: str, value: Column) -> Column:
    """A phrase for a feature's value; the first rule whose word is in the name decides."""
    if "age" in name:
        return F.when(value < 30, "very new").when(value < 180, "recent").when(value < 365, "under a year old").otherwise("well established")
    if "ttl" in name:
        return F.when(value < 300, "changes very often").when(value < 3600, "changes often").otherwise("stable")
    if "length" in name:
        return F.when(value > 100, "unusually long").when(value > 50, "long").otherwise("normal length")
    if name.startswith("num_"):
        return F.when(value > 10, "many").when(value > 3, "several").when(value > 0, "few").otherwise("none")
    if name.startswith(("has_", "is_")):
        return F.when(value > 0, "present").otherwise("absent")
    return F.format_number(value.cast("double"), 2)


def retrain_due(new_rows: Column, hours_since: Column) -> Column:
    """True after a hundred new rows, a day, or where there was no run before."""
    return (new_rows >= 100) | hours_since.isNull() | F.coalesce(hours_since >= 24, F.lit(False))


def deploy_decision(accuracy: Column, fpr: Column, current_accuracy: Column) -> Column:
    good = (accuracy >= 0.85) & (fpr <= 0.05) & (current_accuracy.isNull() | F.coalesce(accuracy >= current_accuracy, F.lit(False)))
    return F.when(good, "deploy").otherwise("rollback")
