"""Runs that break at each stage end as one that never broke; batches lose no row."""

import pytest
from pyspark.ml import classification as C

from tessera.operators import enrichment, lifecycle, models, runs


def rows(spark):
    data = [(i, [float(i % 7), float(i % 5), float((i * 13) % 11)], int(i % 7 + (i * 13) % 11 > 8)) for i in range(240)]
    return models.assemble(spark.createDataFrame(data, "vec_id long, x array<double>, label int"), array_col="x")


def test_a_run_that_breaks_at_every_stage(spark, tmp_path):
    zoo = {"a": C.LogisticRegression(regParam=0.01, labelCol="label"), "b": C.NaiveBayes(modelType="gaussian", labelCol="label")}
    whole = runs.train(rows(spark), zoo, runs.Ledger(spark, f"{tmp_path}/whole"), ["p", "q", "r"], current_accuracy=0.5).first()
    broken, ran = set(), []

    def before(stage):
        ran.append(stage)
        if stage not in broken:
            broken.add(stage)
            raise OSError(f"lost in {stage}")

    ledger = runs.Ledger(spark, f"{tmp_path}/broken", before)
    for _ in range(20):
        try:
            found = runs.train(rows(spark), zoo, ledger, ["p", "q", "r"], current_accuracy=0.5).first()
            break
        except OSError:
            continue
    stages = runs.stages_of(zoo)
    # each stage twice: once broken, once whole, in order
    assert ran == [s for stage in stages for s in (stage, stage)]
    assert {k: v for k, v in found.asDict().items() if k != "path"} == pytest.approx({k: v for k, v in whole.asDict().items() if k != "path"})
    assert all(r.whole for r in ledger.state(stages).collect())
    model, meta, names = lifecycle.load_model(spark, found["path"])
    other, *_ = lifecycle.load_model(spark, whole["path"])
    scores = lambda m: {r.vec_id: r.p for r in models.positive(m.transform(rows(spark))).select("vec_id", "p").collect()}
    assert scores(model) == pytest.approx(scores(other)) and names == ["p", "q", "r"] and meta["training_samples"] == 240


def test_half_written_stages_are_written_again(spark, tmp_path):
    ledger = runs.Ledger(spark, f"{tmp_path}/run")
    spark.range(3).write.parquet(f"{tmp_path}/run/one")
    (tmp_path / "run/one/_SUCCESS").unlink()
    assert not ledger.whole("one")
    assert ledger.table("one", lambda: spark.range(5)).count() == 5 and ledger.whole("one")
    assert ledger.table("one", lambda: 1 / 0).count() == 5


def test_enrichment_loses_no_row(spark, tmp_path):
    urls = spark.createDataFrame([(1, "http://a.example/x"), (2, "http://a.example/y"), (3, "http://b.example"), (4, "http://c.example"), (5, None), (6, "no host at all"), (7, "http://a.example/x")], "id long, url string")
    records = spark.createDataFrame([("a.example", 3, None), ("b.example", 9, "timed out"), ("d.example", 1, None)], "host string, num_A int, error string")
    counts = enrichment.enrich(urls, records, f"{tmp_path}/out", "20240101")
    assert counts == {"rows": 7, "well": 3, "no url": 1, "no host": 1, "no record": 1, "lookup failed": 1}
    out = spark.read.parquet(f"{tmp_path}/out/batch=20240101")
    assert {r.id: (r.num_A, r.error) for r in out.collect()} == {1: (3, None), 2: (3, None), 7: (3, None), 3: (None, "lookup failed"), 4: (None, "no record"), 5: (None, "no url"), 6: (None, "no host")}
    assert {r.failed: r["count"] for r in out.groupBy("failed").count().collect()} == {"true": 4, "false": 3}
