"""Running streams under control: models exchanged between batches, latencies recorded, an end after a whole batch."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tessera.operators import lifecycle


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the models below ``path`` that are whole (their features are written last), oldest first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(s.getPath().getName() for s in files.listStatus(folder) if files.exists(mark(f"{path}/{s.getPath().getName()}/features/_SUCCESS")))


def scoring_batches(models: str, out: str, score: Callable[[object, DataFrame], DataFrame]):
    """A ``foreachBatch`` function that scores with the newest whole model below ``models`` as it is when a batch begins.

    A batch has one model from first to last row, named in ``version``. It is written as ``{out}/batch=n``, over what a broken attempt left; the model
    of an attempt that is run again is the newest by then. Batches that come before any model have null scores.
    """
    held: dict[str, object] = {}

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = versions(spark, models)
        newest = known[-1] if known else None
        if newest and newest not in held:
            held.clear()
            held[newest] = lifecycle.load_model(spark, f"{models}/{newest}")[0]
        scored = score(held[newest], batch) if newest else batch.withColumn("p", F.lit(None).cast("double"))
        scored.withColumn("version", F.lit(newest).cast("string")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return apply


class Latencies(StreamingQueryListener):
    """Rows (query, batch, rows, milliseconds) of every batch that ends; ``table`` gives them as a DataFrame, ``flush`` appends them to a folder."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((p.name or str(p.id), int(p.batchId), int(p.numInputRows), int(p.batchDuration)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), "query string, batch long, rows long, ms long")

    def flush(self, spark: SparkSession, path: str) -> None:
        rows, self.rows = self.rows, []
        spark.createDataFrame(rows, "query string, batch long, rows long, ms long").coalesce(1).write.mode("append").parquet(path)


def stop_after_batch(query: StreamingQuery, timeout: float = 60.0) -> bool:
    """Stops a query between two batches; false if it was still at work when the time was over, and it runs on."""
    end = time.monotonic() + timeout
    while query.isActive and time.monotonic() < end:
        if not query.status["isTriggerActive"]:
            query.stop()
            return True
        time.sleep(0.05)
    return not query.isActive
