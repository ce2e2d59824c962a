"""Structured Streaming forms of the collection loop; the batch forms are in ``operators``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import relational
from tessera.sources import workdir


def files(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", max_files: int = 10, archive: str | None = None) -> DataFrame:
    """New files of a folder, each once; processed ones may be archived."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", str(max_files))
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(path)


def event_time(df: DataFrame, column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """A watermark on a zoned timestamp; times without a zone are taken in the session's."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def unseen(df: DataFrame, key: str) -> DataFrame:
    """First row of each key within the watermark; the state is dropped behind it."""
    return df.dropDuplicatesWithinWatermark([key])


def metrics(df: DataFrame, by: str, value: str) -> DataFrame:
    """Running count, errors and mean for each group."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg(value).alias("mean"))


def rolling_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], k: int = 4096) -> DataFrame:
    """(by..., n, mean, largest, and each percentile in ``shares``) so far, for a stream in complete or update mode, or a batch.

    The values of a group are held as a mergeable quantile sketch: partial in each task, merged in state, some tens of kilobytes whatever the rows. With ``k`` 4096 a
    percentile's rank is within 0.2 % of what was asked (and exact while a group has fewer rows than ``k``); ``operators.ranks.percentiles`` is exact at rest.
    """
    v = F.col(value).cast("double")
    held = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("largest"), F.kll_sketch_agg_double(v, k).alias("__sketch"))
    return held.select(*by, "n", "mean", "largest", *(F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("__sketch", F.lit(float(share)))).alias(name) for name, share in shares.items()))


def windowed_counts(df: DataFrame, ts: str, key: str, width: str) -> DataFrame:
    return df.groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))


def upsert_into(path: str, keys: list[str], order: list[str]):
    """A ``foreachBatch`` function that keeps the last row of each key under ``path``, one version folder for each batch.

    A batch that is run again after a failure writes the same version again, so the result is the same. The version before stays for
    that, and for readers; older ones are removed.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merged = relational.keep_last(batch, keys, order)
        if batch_id > 0:
            merged = relational.upsert(spark.read.parquet(f"{path}/v={batch_id - 1}"), merged, keys, order)
        merged.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        if batch_id > 1:
            workdir.remove(spark, f"{path}/v={batch_id - 2}")

    return apply


def counting_batches(path: str, threshold: int, on_due=None):
    """A ``foreachBatch`` function that counts rows and says when enough are new: one row of (batch, rows, processed, last, due) for each batch under ``path``.

    ``processed`` and ``last`` (rows at the last retraining) come from the row of the batch before, so a restart goes on where it was. ``on_due`` is called
    once a batch brings the rows since ``last`` to ``threshold``; a batch that is run again calls it again.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark, rows = batch.sparkSession, batch.count()
        processed = last = 0
        if batch_id > 0:
            before = spark.read.parquet(f"{path}/batch={batch_id - 1}").first()
            processed, last = before["processed"], before["last"]
        processed += rows
        due = processed - last >= threshold
        if due and on_due:
            on_due(processed)
        state = spark.createDataFrame([(rows, processed, processed if due else last, due)], "rows long, processed long, last long, due boolean")
        state.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return apply


def run_available(df: DataFrame, checkpoint: str, **sink) -> None:
    """Process what is there and stop."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    for name, value in sink.items():
        writer = getattr(writer, name)(value)
    query = writer.start()
    query.awaitTermination()


def retried(call, attempts: int = 3, wait: float = 1.0, sleep=None):
    """``call()``, tried again after ``wait``, twice that, and so on; None when all attempts failed. For lookups of one partition, not for Spark's own tasks, which Spark retries."""
    import time

    for k in range(attempts):
        try:
            return call()
        except Exception:  # noqa: BLE001
            if k + 1 < attempts:
                (sleep or time.sleep)(wait * 2**k)
    return None
