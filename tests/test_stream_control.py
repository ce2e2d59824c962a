"""A model exchanged while a stream runs, and no batch cut."""

import time

from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.sql import functions as F

from tessera.operators import lifecycle, models
from tessera.streaming import control, streams


def labelled(spark, flip):
    rows = [(i, [float(i % 10), 1.0], int((i % 10 > 4) != flip)) for i in range(100)]
    return models.assemble(spark.createDataFrame(rows, "id long, x array<double>, label int"), array_col="x")


def score(model, batch):
    return models.positive(model.transform(models.assemble(batch, array_col="x"))).select("id", "p")


def wait_for(what, seconds=60):
    end = time.monotonic() + seconds
    while not what():
        assert time.monotonic() < end
        time.sleep(0.2)


def test_scores_follow_the_newest_model(spark, tmp_path):
    def save(version, flip):
        lifecycle.save_model(spark, Pipeline(stages=[C.LogisticRegression(labelCol="label")]).fit(labelled(spark, flip)), f"{tmp_path}/models/{version}", ["a", "b"], version=version)

    def send(k):
        spark.createDataFrame([(k * 10 + i, [float(i), 1.0]) for i in range(10)], "id long, x array<double>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def batches():
        return sorted(p.name for p in (tmp_path / "out").glob("batch=*") if (p / "_SUCCESS").exists()) if (tmp_path / "out").exists() else []

    seen = control.Latencies()
    spark.streams.addListener(seen)
    send(0)
    source = streams.files(spark, f"{tmp_path}/in", "id long, x array<double>", max_files=1)
    query = source.writeStream.queryName("scores").foreachBatch(control.scoring_batches(f"{tmp_path}/models", f"{tmp_path}/out", score)).option("checkpointLocation", f"{tmp_path}/log").trigger(processingTime="200 milliseconds").start()
    try:
        wait_for(lambda: len(batches()) == 1)
        save("v1", False)
        send(1)
        wait_for(lambda: len(batches()) == 2)
        save("v2", True)
        send(2)
        wait_for(lambda: len(batches()) == 3)
        assert control.stop_after_batch(query) and not query.isActive
    finally:
        query.stop()
        wait_for(lambda: len([r for r in seen.rows if r[2] == 10]) == 3)
        spark.streams.removeListener(seen)
    rows = {r.id: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert sorted(rows) == list(range(30))
    assert [rows[i].version for i in (3, 13, 23)] == [None, "v1", "v2"] and rows[3].p is None
    assert rows[19].p > 0.5 > rows[12].p and rows[22].p > 0.5 > rows[29].p
    table = seen.table(spark)
    assert table.filter("rows = 10").count() == 3 and table.filter(F.col("ms") < 0).count() == 0
    seen.flush(spark, f"{tmp_path}/latencies")
    assert spark.read.parquet(f"{tmp_path}/latencies").count() >= 3 and seen.rows == []
