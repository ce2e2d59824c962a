"""Fitted models on disk with what is known of them, and A/B tests from routing to the decision."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import stats

#: What a model is taken to be where nothing was written beside it.
UNKNOWN = {"version": "unknown", "model_type": "unknown", "algorithm": "unknown", "trained_date": "unknown", "accuracy": 0.0, "precision": 0.0, "recall": 0.0, "f1_score": 0.0, "threshold": 0.5, "training_samples": 0, "cross_validation_folds": 0, "hyperparameters": {}, "notes": None}


def save_model(spark: SparkSession, model: PipelineModel, path: str, features: list[str], **known) -> None:
    """Writes ``{path}/model``, ``{path}/meta`` (one line of JSON) and ``{path}/features`` (a name a line, in order)."""
    model.write().overwrite().save(f"{path}/model")
    meta = UNKNOWN | {"algorithm": type(model.stages[-1]).__name__} | known
    if unknown := set(meta) - set(UNKNOWN):
        raise ValueError(f"no such metadata: {sorted(unknown)}")
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    spark.createDataFrame([(f,) for f in features], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/features")


def written(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small text beside a model; none where it is missing."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return []
    return [r.value for r in spark.read.text(path).collect()]  # a line, or one for each feature


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict, list[str]]:
    """The model, its metadata (defaults where there is none) and its features in order."""
    model, meta = PipelineModel.load(f"{path}/model"), written(spark, f"{path}/meta")
    known = json.loads(meta[0]) if meta else {"algorithm": type(model.stages[-1]).__name__}
    return model, UNKNOWN | known, written(spark, f"{path}/features")


def next_version(version: Column) -> Column:
    """The patch number one up; v1.0.0 where a text holds no version."""
    part = lambda i: F.regexp_extract(version, r"v(\d+)\.(\d+)\.(\d+)", i)
    return F.when(part(1) == "", "v1.0.0").otherwise(F.concat(F.lit("v"), part(1), F.lit("."), part(2), F.lit("."), (part(3).cast("long") + 1).cast("string")))


def variant_metrics(df: DataFrame, variant: str, ts: str, failed: Column, predicted: Column, actual: Column, latency: str) -> DataFrame:
    """One row per variant: requests, failures, hours from its first to its last request, 95th percentile of latency, and, over rows whose ``actual`` label is known, accuracy, precision, recall, F1 and false-positive rate."""
    rows = df.select(F.col(variant).alias("variant"), F.col(ts).cast("timestamp").alias("__ts"), failed.cast("int").alias("__failed"), predicted.cast("int").alias("__p"), actual.cast("int").alias("__a"), F.col(latency).alias("__ms"))
    seconds = F.unix_micros(F.max("__ts")) - F.unix_micros(F.min("__ts"))
    base = rows.groupBy("variant").agg(F.count(F.lit(1)).alias("requests"), F.avg("__failed").alias("error_rate"), (seconds / 3.6e9).alias("hours"), F.count("__a").alias("known"))
    base = stats.with_percentiles(base, rows, ["variant"], "__ms", {"p95": 0.95})
    return base.join(stats.classification(rows, "__a", "__p", ["variant"]), "variant", "left")


def decide(metrics: DataFrame, control: str, min_requests: int = 1000, min_hours: float = 24.0, least_gain: float = 0.01, most_fpr: float = 0.02, stop_fpr: float = 0.10, stop_errors: float = 0.05) -> DataFrame:
    """``metrics`` of the variants but the control, with ``decision``.

    rollback: too many failures or false positives; promote: enough requests, hours and known labels, an accuracy gain and no more
    false positives than allowed against the control; keep otherwise.
    """
    base = metrics.filter(F.col("variant") == control).select(F.col("accuracy").alias("__accuracy"), F.col("fpr").alias("__fpr"))
    joined = metrics.filter(F.col("variant") != control).join(F.broadcast(base), F.lit(True), "left")  # one row
    better = (F.col("accuracy") - F.col("__accuracy") >= least_gain) & (F.col("fpr") - F.col("__fpr") <= most_fpr)
    good = (F.col("requests") >= min_requests) & (F.col("hours") >= min_hours) & F.coalesce(better, F.lit(False))
    bad = (F.col("error_rate") > stop_errors) | F.coalesce(F.col("fpr") > stop_fpr, F.lit(False))
    return joined.withColumn("decision", F.when(bad, "rollback").when(good, "promote").otherwise("keep")).drop("__accuracy", "__fpr")
