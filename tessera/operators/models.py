"""Models of the zoo on Spark ML, cross-validation on given folds, blending and importances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import stats

#: Above this many rows the slow learners are left out.
HEAVY_ROWS = 120_000


def zoo(n_rows: int, label: str = "label", features: str = "features", n_features: int | None = None) -> dict[str, object]:
    """Estimators by name; the network needs ``n_features``. Gradient-boosted and extra trees of other libraries are stood in for by Spark's forests and boosted trees."""
    common = {"labelCol": label, "featuresCol": features, "weightCol": "weight"}
    models = {
        "logreg_elasticnet": C.LogisticRegression(elasticNetParam=0.5, regParam=0.01, **common),
        "logreg_l2": C.LogisticRegression(elasticNetParam=0.0, regParam=0.01, **common),
        "random_forest": C.RandomForestClassifier(numTrees=60, maxDepth=8, seed=42, **common),
        "naive_bayes": C.NaiveBayes(modelType="gaussian", **common),
        "complement_nb": C.NaiveBayes(modelType="complement", **common),
    }
    if n_features:
        models["mlp"] = C.MultilayerPerceptronClassifier(layers=[n_features, 100, 50, 2], maxIter=100, seed=42, labelCol=label, featuresCol=features)
    if n_rows <= HEAVY_ROWS:
        models |= {"gbt": C.GBTClassifier(maxIter=30, seed=42, **common), "linear_svc": C.LinearSVC(regParam=0.01, **common)}
    return models


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """Weights n / (2 n_c), from one row of counts."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col(label) == 1).alias("__p"))
    own = F.when(F.col(label) == 1, F.col("__p")).otherwise(F.col("__n") - F.col("__p"))
    return df.crossJoin(F.broadcast(counts)).withColumn("weight", F.col("__n") / (2 * own)).drop("__n", "__p")


def assemble(df: DataFrame, columns: list[str] | None = None, array_col: str | None = None) -> DataFrame:
    if array_col:
        return df.withColumn("features", array_to_vector(F.col(array_col).cast("array<double>")))
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df)


def positive(df: DataFrame) -> DataFrame:
    """Column ``p``: the probability of label 1, or the squashed margin of models without one."""
    if "probability" in df.columns:
        return df.withColumn("p", vector_to_array("probability")[1])
    return df.withColumn("p", 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))


def scaler_for(estimator):
    """Complement counts take no negative values; all else is standardised."""
    if isinstance(estimator, C.NaiveBayes) and estimator.getModelType() != "gaussian":
        return MinMaxScaler(inputCol="features", outputCol="scaled")
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=True)


def balanced_forest(df: DataFrame, label: str = "label", key: str = "vec_id", members: int = 3) -> list[object]:
    """Forests on samples with as many rows of one label as of the other, each sample by another hash; average their ``p``."""
    shares = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    least = min(shares.values(), default=0)
    models = []
    for seed in range(members):
        draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) / float(1 << 20)
        keep = F.lit(False)
        for value, n in shares.items():
            keep = keep | ((F.col(label) == value) & (draw < least / n))
        models.append(C.RandomForestClassifier(numTrees=20, maxDepth=8, seed=seed, labelCol=label, featuresCol="features").fit(df.filter(keep)))
    return models


def calibrated(df: DataFrame, estimator, target: DataFrame | None = None, label: str = "label", fold_col: str = "fold", folds: int = 3) -> DataFrame:
    """``target`` (or ``df``) with ``p`` of an estimator that gives margins only, by a logistic fit of the label on margins (sigmoid calibration).

    The margins of the fit are those of each fold's rows by a model of the other folds; the scores are of a model of all rows.
    """

    def margin(model, rows):
        return model.transform(rows).withColumn("__m", array_to_vector(F.array(vector_to_array("rawPrediction")[1]))).drop("prediction", "rawPrediction")

    parts = [margin(estimator.fit(df.filter(F.col(fold_col) != k)), df.filter(F.col(fold_col) == k)).select(label, "__m") for k in range(folds)]
    unseen = parts[0]
    for part in parts[1:]:
        unseen = unseen.unionByName(part)
    sigmoid = C.LogisticRegression(labelCol=label, featuresCol="__m").fit(unseen)
    scored = sigmoid.transform(margin(estimator.fit(df), df if target is None else target))
    return scored.withColumn("p", vector_to_array("probability")[1]).drop("__m", "rawPrediction", "probability", "prediction")


def cross_validate(df: DataFrame, estimator, folds: int, label: str = "label", fold_col: str = "fold", keep: list[str] | None = None) -> DataFrame:
    """Rows of all folds with the score ``p`` of the model that had not seen them, and the columns in ``keep``."""
    parts = []
    for k in range(folds):
        scaler = scaler_for(estimator)
        model = Pipeline(stages=[scaler, estimator.copy({estimator.featuresCol: "scaled"})]).fit(df.filter(F.col(fold_col) != k))
        parts.append(positive(model.transform(df.filter(F.col(fold_col) == k))).select(*(keep or []), label, fold_col, "p"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def report(scored: DataFrame, label: str = "label") -> DataFrame:
    """One row: confusion metrics at one half and the area under the curve."""
    decided = scored.withColumn("yes", (F.col("p") >= 0.5).cast("int"))
    return stats.classification(decided, label, "yes").crossJoin(stats.roc_auc(scored, label, "p"))


def fold_report(scored: DataFrame, label: str = "label", fold_col: str = "fold") -> DataFrame:
    """(fold, accuracy, precision, recall, f1, auc) of each fold, and their mean with fold null."""
    decided = scored.withColumn("yes", (F.col("p") >= 0.5).cast("int"))
    names = ["accuracy", "precision", "recall", "f1", "auc"]
    per = stats.classification(decided, label, "yes", [fold_col]).join(stats.roc_auc_by(scored, label, "p", fold_col), fold_col).select(F.col(fold_col).alias("fold"), *names)
    return per.unionByName(per.agg(F.lit(None).cast(per.schema["fold"].dataType).alias("fold"), *(F.avg(c).alias(c) for c in names)))


def packed(df: DataFrame, rows: int, columns: dict[str, Column], out: str) -> DataFrame:
    """(out, and each column as an array): rows in groups of about ``rows``, by a hash of all columns."""
    parts = max(1, -(-df.count() // rows))
    return df.groupBy(F.pmod(F.xxhash64(*columns.values()), F.lit(parts)).alias(out)).agg(F.collect_list(F.struct(*(c.alias(k) for k, c in columns.items()))).alias(f"{out}_rows"))


def neighbours(df: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", array_col: str = "embedding", label: str = "label", shard_rows: int = 8192, block_rows: int = 1024) -> DataFrame:
    """(query, p): share of label 1 among the ``k`` nearest by squared distance, ties to smaller ids.

    ``queries`` is a stated set: its rows meet all others in blocks, as arrays, and each block and shard give ``k`` rows a query.
    """
    rows = packed(df, shard_rows, {"id": F.col(id_col).cast("long"), "y": F.col(label).cast("double"), "v": F.col(array_col).cast("array<double>")}, "shard")
    asked = packed(queries, block_rows, {"id": F.col(id_col).cast("long"), "v": F.col(array_col).cast("array<double>")}, "block")
    shards = rows.select("shard")
    pairs = asked.join(F.broadcast(shards), F.lit(True)).join(rows, "shard")  # a number for each shard

    def run(batches):
        for batch in batches:
            for mine, them in zip(batch.column("block_rows"), batch.column("shard_rows"), strict=True):
                them = them.values
                ids, y = (them.field(c).to_numpy(zero_copy_only=False) for c in ("id", "y"))
                x = np.stack(them.field("v").to_numpy(zero_copy_only=False))
                for q in mine.as_py():
                    gap = x - np.array(q["v"])
                    far = (gap * gap).sum(axis=1)
                    far[ids == q["id"]] = np.inf
                    order = np.lexsort((ids, far))[:k]
                    order = order[np.isfinite(far[order])]
                    yield pa.RecordBatch.from_pydict({"query": np.full(len(order), q["id"]), "d": far[order], "i": ids[order], "y": y[order]})

    found = pairs.select("block_rows", "shard_rows").mapInArrow(run, "query long, d double, i long, y double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "i"))
    return found.withColumn("__r", rank).filter(F.col("__r") <= k).groupBy("query").agg(F.avg("y").alias("p"))


def meta_weights(scored: DataFrame, columns: list[str], label: str = "label") -> list[float]:
    """Weights of several models' scores: softmax of a plain logistic fit's coefficients."""
    from math import exp

    table = VectorAssembler(inputCols=columns, outputCol="features").transform(scored.select(label, *columns))
    fitted = C.LogisticRegression(labelCol=label, regParam=0.0).fit(table).coefficients.toArray().tolist()
    top = max(fitted)
    grown = [exp(x - top) for x in fitted]
    return [g / sum(grown) for g in grown]


def describe(model) -> dict[str, object]:
    """Name and size of a fitted model."""
    return {"algorithm": type(model).__name__, "n_features": int(getattr(model, "numFeatures", 0))}


def importances(model, names: list[str]) -> list[tuple[str, float]]:
    """Absolute coefficients or tree importances, largest first."""
    values = model.coefficients.toArray() if hasattr(model, "coefficients") else model.featureImportances.toArray()
    return sorted(zip(names, map(abs, values.tolist()), strict=True), key=lambda x: (-x[1], x[0]))


def linear_contributions(df: DataFrame, model, array_col: str, means: list[float]) -> DataFrame:
    """Exact additive contributions of a linear model: coefficient times the distance from the mean."""
    pairs = F.array(*(F.lit(float(c)) for c in model.coefficients)), F.array(*(F.lit(m) for m in means))
    centred = F.zip_with(F.col(array_col).cast("array<double>"), pairs[1], lambda x, m: x - m)
    return df.withColumn("contributions", F.zip_with(centred, pairs[0], lambda x, c: x * c))
