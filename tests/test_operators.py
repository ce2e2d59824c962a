from pyspark.sql import functions as F

from tessera.operators import models, relational, stats
from tessera.sources import readers, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_is_idempotent(spark):
    a = spark.createDataFrame([("x", 1, "old"), ("y", 1, "old")], "url string, seq int, v string")
    b = spark.createDataFrame([("x", 2, "new"), ("z", 1, "new"), ("z", 2, "newer")], "url string, seq int, v string")
    once = relational.upsert(a, b, ["url"], ["seq"])
    assert rows(once) == [("x", 2, "new"), ("y", 1, "old"), ("z", 2, "newer")]
    assert rows(relational.upsert(once, b, ["url"], ["seq"])) == rows(once)
    assert relational.merge_counts(a, b, ["url"]).first().asDict() == {"existing": 2, "incoming": 3, "added": 1, "duplicates": 2}
    assert relational.merge_counts(a.limit(0), b.limit(0), ["url"]).first()["added"] == 0


def test_quality_and_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 1, 0.8), (None, 1, 0.1)], "y int, p int, s double")
    m = stats.classification(df, "y", "p").first()
    assert (m.tp, m.fp, m.fn, m.tn, m.accuracy) == (1, 1, 1, 1, 0.5)
    assert stats.roc_auc(df, "y", "s").first().auc == (1 + 1 + 0.5) / 4
    issues = stats.quality_issues(df, [("s", "low", "error", F.col("s") < 0.2), ("y", "never", "error", F.col("y") > 5)])
    assert rows(issues) == [("s", "low", "error", 1)]
    assert stats.passes(issues).first().passed is False


def test_sampling_is_deterministic(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 2)
    a, b = (rows(relational.sample_exact(df.repartition(n), 10, "id")) for n in (1, 7))
    assert a == b and len(a) == 10
    assert relational.folds(df, "g", "id").groupBy("g", "fold").count().filter("count <> 10").count() == 0


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("http://a", "NA", "s\nx"), ("http://b", "phishing", None)], "url string, label string, source string")
    path = str(tmp_path / "out")
    sinks.write_csv(sinks.sanitized(df), path)
    assert rows(readers.nulls(readers.csv(spark, path, readers.URL_BATCH)).na.fill("-")) == [("http://a", "-", "s x"), ("http://b", "phishing", "-")]
    assert readers.optional_csv(spark, str(tmp_path / "none"), readers.URL_BATCH).count() == 0
    batch = readers.batches(spark, path, readers.URL_BATCH)
    assert batch.count() == 2 and readers.latest(batch).count() >= 1


def test_feeds(spark):
    raw = spark.createDataFrame([('1,"http://a/x",y',), ("#c,http://b",), ("2,ftp://c",), ("3",)], "line string")
    assert rows(readers.parse_feed(raw, "indexed_1", "f")) == [("http://a/x", "phishing", "f")]
    assert rows(readers.parse_feed(spark.createDataFrame([("e.com",)], "line string"), "domains", "g")) == [("https://e.com", "legitimate", "g")]
    pulses = spark.createDataFrame([('{"results":[{"name":"n","indicators":[{"type":"URL","indicator":"http://u"},{"type":"IP","indicator":"1"}]}]}',)], "value string")
    assert rows(readers.parse_pulses(pulses)) == [("http://u", "phishing")]


def test_token_bucket_stream(spark, tmp_path):
    from tessera.streaming import keyed, streams

    data = spark.createDataFrame([("k", 1000 + i // 4) for i in range(8)], "k string, s int").select("k", F.timestamp_seconds("s").alias("ts"))
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    # a request of another key much later moves the watermark past all of them
    spark.createDataFrame([("z", 9999)], "k string, s int").select("k", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = streams.event_time(streams.files(spark, str(tmp_path / "in"), "k string, ts timestamp"), delay="1 second")
    with keyed.store(spark):
        query = keyed.token_bucket(source, "k", "ts", rate=1.0, capacity=2.0).writeStream.format("memory").queryName("bucket").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    # two at once, then one more for the second that passed
    assert spark.table("bucket").filter("allowed AND k = 'k'").count() == 3


def test_retries_wait_longer_each_time():
    from tessera.streaming import streams

    waits, calls = [], []

    def fails(n):
        calls.append(n)
        if len(calls) <= n:
            raise OSError("not yet")
        return "done"

    assert streams.retried(lambda: fails(2), sleep=waits.append) == "done" and waits == [1.0, 2.0]
    calls.clear()
    assert streams.retried(lambda: fails(9), sleep=waits.append) is None and len(calls) == 3


def test_models_and_metadata(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml import classification as C

    from tessera.operators import lifecycle
    from tessera.sources import workdir

    df = models.assemble(spark.createDataFrame([([float(i), float(i % 3)], int(i > 5)) for i in range(12)], "x array<double>, label int"), array_col="x")
    path = f"file://{tmp_path}/m"
    model = Pipeline(stages=[C.LogisticRegression(maxIter=3)]).fit(df)
    lifecycle.save_model(spark, model, path, ["b", "a"], version="v2.0.1", hyperparameters={"maxIter": 3}, notes="é")
    loaded, meta, features = lifecycle.load_model(spark, path)
    assert features == ["b", "a"] and meta["version"] == "v2.0.1" and meta["hyperparameters"] == {"maxIter": 3} and meta["notes"] == "é" and meta["threshold"] == 0.5
    assert [r.prediction for r in loaded.transform(df).collect()] == [r.prediction for r in model.transform(df).collect()]
    workdir.remove(spark, f"{path}/meta")
    workdir.remove(spark, f"{path}/features")
    _, meta, features = lifecycle.load_model(spark, path)
    assert meta["version"] == "unknown" and meta["algorithm"] == "LogisticRegressionModel" and features == []


def test_rules_from_a_file(spark, tmp_path):
    from tessera.functions import suffixes

    (tmp_path / "rules.dat").write_text("// a comment\n\ncom\n*.ck  // wild\n!www.ck\nco.uk\nuk\n")
    rules = suffixes.read_rules(spark, f"file://{tmp_path}/rules.dat")
    hosts = spark.createDataFrame([(h,) for h in ("a.b.com", "WWW.ck", "x.y.ck", "ck", "com", "unknown", "a.co.uk.", None)], "host string")
    got = {r.host: (r.suffix, r.domain, r.subdomain) for r in suffixes.split_hosts(hosts, rules).collect()}
    assert got == {"a.b.com": ("com", "b", "a"), "WWW.ck": ("ck", "www", ""), "x.y.ck": ("y.ck", "x", ""), "ck": ("", "ck", ""), "com": ("com", "", ""), "unknown": ("", "unknown", ""), "a.co.uk.": ("co.uk", "a", ""), None: (None, None, None)}


def test_intermediate_folders(spark):
    from tessera.sources import workdir

    path = workdir.shared(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and path.startswith(workdir.application(spark))
    workdir.remove(spark, path)
    assert readers.optional_csv(spark, path, readers.URL_BATCH).count() == 0


def test_files_are_archived(spark, tmp_path):
    from tessera.streaming import streams

    for k in range(3):
        spark.range(k, k + 1).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    s = streams.files(spark, f"file://{tmp_path}/in", "id long", max_files=1, archive=f"file://{tmp_path}/done")
    streams.run_available(s, f"file://{tmp_path}/log", foreachBatch=lambda batch, _: batch.write.mode("append").parquet(f"file://{tmp_path}/out"))
    assert sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [0, 1, 2]
    assert list((tmp_path / "done").rglob("*.parquet"))


def test_collection_is_the_same_each_time(spark):
    from tessera.operators import samplers

    a, b = (rows(samplers.collect(spark, 2000).repartition(n)) for n in (1, 5))
    assert a == b and len({r[0] for r in a}) == len(a)
    made = sum(samplers.sample(spark, d, n).count() for d, n in (("protocol", 200), ("category", 800), ("tld", 200), ("region", 200), ("structure", 200), ("attack_type", 1200)))
    assert 0.8 * made < len(a) <= made
    assert {r[1] for r in a} == {"legitimate", "phishing"}
    assert rows(samplers.sample(spark, "tld", 300, seed=1)) != rows(samplers.sample(spark, "tld", 300, seed=2))


def test_sinks_and_small_readers(spark, tmp_path):
    base = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, g string")
    sinks.write_table(df, f"{base}/t", partition_by=["g"])
    sinks.write_table(df, f"{base}/t", append=True, partition_by=["g"])
    assert spark.read.parquet(f"{base}/t").count() == 4
    sinks.write_report(df, f"{base}/r")
    assert rows(readers.state(spark, f"{base}/r", "id int, g string").filter("id IS NOT NULL"))[0] == (1, "a")
    out = sinks.write_version(df, f"{base}/m", "v1.0.0")
    assert rows(spark.read.parquet(out)) == [(1, "a"), (2, "b")]
    try:
        sinks.write_version(df, f"{base}/m", "v1.0.0")
        raise AssertionError("a version was overwritten")
    except Exception as e:
        assert "already exists" in str(e)
    (tmp_path / "ranked.csv").write_text("1,a.example\n2,b.example\n")
    assert rows(readers.ranked_domains(spark, f"{base}/ranked.csv")) == [(1, "https://a.example"), (2, "https://b.example")]
    (tmp_path / "feed.txt").write_text("  http://a  \n\n# note\nhttp://b\n")
    assert rows(readers.parse_feed(readers.lines(spark, f"{base}/feed.txt"), "plain", "f")) == [("http://a", "phishing", "f"), ("http://b", "phishing", "f")]
    (tmp_path / "bad.csv").write_text("url,label,source\nhttp://a,phishing,f\nhttp://b\n")
    assert readers.csv(spark, f"{base}/bad.csv", readers.URL_BATCH, skip_bad_lines=True).collect()[0].url == "http://a"


def test_relational_table_in_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(20).selectExpr("CAST(id AS INT) AS ID", "CAST(id * 2 AS INT) AS V").write.format("jdbc").options(url=url, dbtable="T", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    got = readers.jdbc(spark, url, "T", "ID", 0, 20, 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert got.rdd.getNumPartitions() == 4 and rows(got) == [(i, 2 * i) for i in range(20)]


def test_small_rules(spark):
    from tessera.functions import columns, labels, score
    from tessera.operators import generate

    df = spark.createDataFrame([(1, -2.0, "['a', 'b']", "x"), (2, 3.0, "[]", None)], "id int, v double, l string, t string")
    assert rows(relational.align(df, ["v", "missing", "id"], -1.0)) == [(-2.0, -1.0, 1), (3.0, -1.0, 2)]
    assert rows(df.select(columns.clipped(F.col("v")))) == [(0.0,), (3.0,)]
    assert rows(labels.list_columns_to_counts(df.select("id", "l", "t"), ["l", "t"]).select("id", "l")) == [(1, 2), (2, 0)]
    a, b = df.select(*(w.alias(n) for w, n in zip(score.inverse_error_weights([F.lit(0.099), F.lit(0.299)]), "ab", strict=True))).first()
    assert abs(a - 0.75) < 1e-9 and abs(b - 0.25) < 1e-9
    urls = generate.sample_expanded(spark, ["a.example", "b.example"], ["https://{d}", "https://{d}/x"], 3, "legitimate")
    assert urls.count() == 3 and urls.select("url").distinct().count() == 3
    assert rows(relational.left_with_suffix(df.select("id", "v"), df.select("id", "v"), "id")) == [(1, -2.0, -2.0), (2, 3.0, 3.0)]


def test_ranks_equal_one_window(spark):
    from pyspark.sql import Window

    from tessera.operators import ranks

    # one group holds most rows, one is null, some order values are null or repeat
    df = spark.range(500).select(F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "cold").alias("g"), F.when(F.col("id") != 3, F.col("id") * 7 % 501).alias("o"))
    got = ranks.numbered(df, "g", "o", "n", ranges=8)
    expected = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))
    one = df.filter("o IS NOT NULL").select("o", F.lit(2).alias("v"))
    sums = {r.o: r.s for r in ranks.running_sum(one, "o", "v", "s", ranges=8).collect()}
    assert sums == {o: 2 * (i + 1) for i, o in enumerate(sorted(sums))}
    assert ranks.numbered(df.limit(0), "g", "o", "n").count() == 0


def test_ranges_of_like_texts_and_equal_values(spark):
    from tessera.operators import ranks

    # texts that begin alike, and one value that most rows have, are dealt to several ranges
    df = spark.range(2000).select(F.format_string("Customer#%09d", F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id"))).alias("v"))
    staged = ranks.ranged(df, ["v"], 8)
    assert staged.groupBy("__range").count().agg(F.max("count")).first()[0] < 600
    assert [r.n for r in ranks.numbered(df, None, "v", "n", ranges=8).orderBy("v", "n").collect()] == list(range(1, 2001))


def test_percentiles_are_exact(spark):
    import numpy as np

    from tessera.operators import ranks

    df = spark.range(997).select(F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 < 9, "cold").alias("g"), F.when(F.col("id") % 11 > 0, F.col("id") * 37 % 101 / 3.0).alias("v"))
    values = {}
    for r in df.collect():
        if r.v is not None:
            values.setdefault(r.g, []).append(r.v)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in ranks.percentiles(df, ["g"], "v", shares).collect()}
    assert got.keys() == values.keys()
    for g, v in values.items():
        assert all(abs(got[g][name] - np.percentile(v, 100 * share)) < 1e-9 for name, share in shares.items())
    assert ranks.percentiles(df.limit(0), ["g"], "v", shares).count() == 0


def test_neighbours_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 4, (300, 3)).astype(float), rng.integers(0, 2, 300)
    v = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r.query: r.p for r in models.neighbours(v, v.filter("vec_id % 10 = 0"), 7, shard_rows=40, block_rows=8).collect()}
    for q in range(0, 300, 10):
        far = ((x - x[q]) ** 2).sum(1)
        near = sorted((d, i) for i, d in enumerate(far) if i != q)[:7]
        assert abs(got[q] - np.mean([y[i] for _, i in near])) < 1e-12
    assert len(got) == 30 and models.neighbours(v.limit(0), v.limit(0), 3).count() == 0


def test_entropy_of_long_texts(spark):
    import math
    from collections import Counter

    from tessera.functions import url

    texts = [None, "", "aaaa", "ab", "é日😀a" * 3, "the quick brown fox " * 20_000]
    got = [r.e for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(url.long_text_entropy("t").alias("e")).collect()]
    assert got[:2] == [None, 0.0]
    for t, e in zip(texts[2:], got[2:], strict=True):
        assert abs(e + sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values())) < 1e-9


def test_columns(spark):
    from pyspark.sql import types as T

    from tessera.functions import columns

    df = spark.createDataFrame([(1, float("nan"), "a"), (2, 3.0, None)], "has_x int, num_y double, z string")
    assert columns.by_name(df, "has_|num_") == ["has_x", "num_y"] and columns.by_type(df, T.StringType) == ["z"]
    fitted = columns.fit_schema(df, T.StructType([T.StructField("w", T.LongType()), T.StructField("has_x", T.LongType())]), {"w": -1})
    assert fitted.columns == ["w", "has_x", "num_y", "z"] and fitted.first().w == -1
    assert columns.nan_to_null(df).filter("num_y IS NULL").count() == 1
    assert [round(r.s, 6) for r in columns.squashed(df, "has_x", "s").collect()] == [0.0, 1.0]
    assert columns.as_json(df.filter("has_x = 2"), ["z"]).first().features == '{"has_x":2,"num_y":3.0}'
    assert columns.same_columns(df, df.select("z", "num_y", "has_x"))


def test_meta_weights_prefer_the_better_score(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("int").alias("label"), ((F.col("id") % 2) * 0.6 + (F.col("id") % 7) / 14.0).alias("good"), ((F.col("id") * 13 % 17) / 17.0).alias("noise"))
    weights = models.meta_weights(df, ["good", "noise"])
    assert abs(sum(weights) - 1) < 1e-9 and weights[0] > weights[1]


def test_ranks_of_texts_and_positions(spark):
    from tessera.operators import ranks, relational

    names = ["", "a", "aa", "ab", "b", "zz", "é", "aaaaaaaaaab", "aaaaaaaaaaa", None]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "v string, i int")
    got = [r["v"] for r in ranks.numbered(df, None, "v", "n", ranges=4).orderBy("n").collect()]
    assert got == [None, *sorted(n for n in names if n is not None)]
    pairs = relational.by_position(df.select("v"), df.select("i"), "v", "i").collect()
    assert {(r["i"], r["v"]) for r in pairs} == set(enumerate(got))
    empty = df.filter("i < 0")
    assert relational.by_position(empty.select("v"), empty.select("i"), "v", "i").count() == 0


def test_class_balance_takes_the_smallest(spark):
    from tessera.operators import relational

    df = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(10)], "k int, g string")
    assert sorted((r["k"], r["g"]) for r in relational.class_balance(df, "g", "k").collect()) == [(0, "a"), (1, "a"), (2, "a"), (7, "b"), (8, "b"), (9, "b")]


def test_more_models(spark):
    from tessera.operators import models

    df = spark.createDataFrame([(i, [float(i % 10), float((i * 7) % 5)], int(i % 10 > 6)) for i in range(80)], "vec_id int, x array<double>, label int")
    v = models.balanced(models.assemble(df.coalesce(1), array_col="x")).cache()
    zoo = models.zoo(80, n_features=2)
    assert len(models.balanced_forest(v, members=1)) == 1
    p = models.calibrated(v.withColumn("fold", v["vec_id"] % 3), zoo["linear_svc"].setMaxIter(10))
    row = models.report(p).first()
    assert row["auc"] > 0.9
    for name in ("complement_nb", "mlp"):
        folded = v.withColumn("fold", v["vec_id"] % 2)
        if name == "mlp":
            zoo[name].setMaxIter(5)
        assert models.cross_validate(folded, zoo[name], 2).count() == 80
    v.unpersist()


def test_decision_rules(spark):
    from pyspark.sql import functions as F

    from tessera.functions import score

    df = spark.createDataFrame([(10, None, 0.9, 0.01, None), (100, 1.0, 0.9, 0.2, 0.5), (10, 1.0, 0.86, 0.05, 0.9), (10, 24.0, 0.86, 0.05, 0.86)], "n int, h double, acc double, fpr double, cur double")
    got = df.select(score.retrain_due(F.col("n"), F.col("h")).alias("d"), score.deploy_decision(F.col("acc"), F.col("fpr"), F.col("cur")).alias("x")).collect()
    assert [tuple(r) for r in got] == [(True, "deploy"), (True, "rollback"), (False, "rollback"), (True, "deploy")]
