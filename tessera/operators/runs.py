"""Training runs that go on where they broke: folds, scores of each model, report, choice, refit on all rows, save and gate, each a stage with a commit.

A stage's result is a table in the run's folder, and it counts only once Spark's committer has marked it whole. A run that is started again skips whole stages,
writes over what is left of a broken one, and so ends with the result of a run that never broke. A stage that is run twice gives the same rows, as folds and seeds are fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.score import deploy_decision
from tessera.operators import lifecycle, models, relational, stats


class Ledger:
    """The stages of one run below ``path``."""

    def __init__(self, spark: SparkSession, path: str, before: Callable[[str], None] | None = None):
        """``before`` is called with the name of each stage that is run."""
        self.spark, self.path, self.before = spark, path.rstrip("/"), before

    def whole(self, name: str) -> bool:
        mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table: read where it is whole, else made and committed."""
        if not self.whole(name):
            if self.before:
                self.before(name)
            make().write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def state(self, stages: list[str]) -> DataFrame:
        """(stage, whole) for each of the stages."""
        return self.spark.createDataFrame([(s, self.whole(s)) for s in stages], "stage string, whole boolean")


def stages_of(estimators: dict) -> list[str]:
    return ["folds", *(f"scores-{name}" for name in estimators), "report", "saved", "gate"]


def train(df: DataFrame, estimators: dict, ledger: Ledger, features: list[str], label: str = "label", key: str = "vec_id", folds: int = 3, metric: str = "auc", current_accuracy: float | None = None, version: str = "v1.0.0") -> DataFrame:
    """One row: the best model by the mean of ``metric`` over the folds (ties by name), its figures, where it is saved, and whether to deploy it. ``df`` has ``features`` as vectors."""
    spark = ledger.spark
    rows = ledger.table("folds", lambda: relational.folds(df.select(key, label, "features"), label, key, folds))
    parts = []
    for name, estimator in estimators.items():
        scored = ledger.table(f"scores-{name}", lambda e=estimator: models.cross_validate(rows, e, folds, label, keep=[key]))
        decided = scored.withColumn("yes", (F.col("p") >= 0.5).cast("int"))
        overall = stats.classification(decided, label, "yes").select(F.col("fpr"))
        parts.append(models.fold_report(scored, label).filter("fold IS NULL").drop("fold").crossJoin(F.broadcast(overall)).withColumn("model", F.lit(name)))

    def union() -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    report = ledger.table("report", union)
    best = report.orderBy(F.desc_nulls_last(metric), "model").first()  # a row a model

    def refit() -> DataFrame:
        estimator, scaler = estimators[best["model"]], models.scaler_for(estimators[best["model"]])
        fitted = Pipeline(stages=[scaler, estimator.copy({estimator.featuresCol: "scaled"})]).fit(rows)
        path = f"{ledger.path}/model"
        lifecycle.save_model(spark, fitted, path, features, version=version, accuracy=float(best["accuracy"]), precision=float(best["precision"]), recall=float(best["recall"]), f1_score=float(best["f1"]), training_samples=rows.count(), cross_validation_folds=folds)
        return spark.createDataFrame([(best["model"], path)], "model string, path string")

    saved = ledger.table("saved", refit)
    gate = deploy_decision(F.col("accuracy"), F.col("fpr"), F.lit(current_accuracy).cast("double"))
    return ledger.table("gate", lambda: report.join(saved, "model").select("model", "path", "accuracy", "precision", "recall", "f1", "auc", "fpr", gate.alias("decision")))
