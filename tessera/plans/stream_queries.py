"""Streaming forms run to the end over what is there, models, record features and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import records
from tessera.functions import url as U
from tessera.operators import generate, models
from tessera.sources import workdir
from tessera.streaming import keyed, streams

EVENTS = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def events_stream(spark, sf_dir):
    return streams.files(spark, f"{sf_dir}/events*.parquet", EVENTS)


def in_files(spark, sf_dir, n, ordered=False):
    """A stream of the events in ``n`` files, one a batch: dealt by id, or one stretch of time after the other."""
    path, events = workdir.shared(spark, "event-files"), spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id", "event_type", "value")
    first, last = events.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    part = F.least(F.floor((F.col("ts").cast("double") - (first or 0.0)) / max((last or 0.0) - (first or 0.0), 1.0) * n), F.lit(n - 1)) if ordered else F.col("event_id") % n
    for k in range(n):  # one after the other, as the stream takes files in the order of their times
        events.filter(part == k).coalesce(1).write.mode("append").parquet(path)
    return streams.files(spark, path, events.schema, max_files=1)


def finished(spark, df, name, mode="append"):
    out = workdir.shared(spark, name)
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", workdir.shared(spark, f"{name}-log")).trigger(availableNow=True).start()
        query.awaitTermination()
    else:
        streams.run_available(df, workdir.shared(spark, f"{name}-log"), outputMode=mode, foreachBatch=lambda batch, _: batch.write.mode("overwrite").parquet(out))
    return spark.read.schema(df.schema).parquet(out)


def stream_dedupe(spark, sf_dir):
    """Distinct event ids of a stream that brings the events once more.

    The table is finite, so the state is every id and no event is too late.
    """
    s = events_stream(spark, sf_dir).select("event_id", "event_type")
    twice = s.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"), "event_id", "event_type").drop("copy")
    return finished(spark, twice.dropDuplicates(["event_id"]), "dedupe")


def stream_metrics(spark, sf_dir):
    s = streams.metrics(events_stream(spark, sf_dir), "event_type", "value")
    return finished(spark, s, "metrics", "complete").withColumn("mean", F.round("mean", 6))


def stream_upsert(spark, sf_dir):
    """The last row of each user, merged into the master over four batches."""
    out = workdir.shared(spark, "master")
    s = in_files(spark, sf_dir, 4, ordered=True).select("user_id", "ts", "event_id", "value")
    streams.run_available(s, workdir.shared(spark, "master-log"), foreachBatch=streams.upsert_into(out, ["user_id"], ["ts", "event_id"]))
    versions = spark.read.parquet(out)
    newest = versions.agg(F.max("v").alias("__v"))
    return versions.join(F.broadcast(newest), F.col("v") == F.col("__v")).select("user_id", "event_id", "value")


def stream_retrain(spark, sf_dir):
    """Ten batches of equal size, retraining due once a quarter of all rows is new: (batch, rows, processed, due)."""
    out, n = workdir.shared(spark, "batches"), spark.read.parquet(f"{sf_dir}/events.parquet").count()
    streams.run_available(in_files(spark, sf_dir, 10), workdir.shared(spark, "batches-log"), foreachBatch=streams.counting_batches(out, n // 4))
    return spark.read.parquet(out).select(F.col("batch").cast("int").alias("batch"), "rows", "processed", "due")


def passed_by(spark, sf_dir, n, name, make):
    """What ``make`` tells of the users and times of the events, which come as ``n`` batches, one stretch of time after the other.

    Each stretch is written by as many tasks as read it and taken as one batch; the state goes on in the checkpoint. A row of no user long after the last moves the watermark past all.
    """
    path, out, log = (workdir.shared(spark, f) for f in ("event-times", name, f"{name}-log"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "CAST(ts AS TIMESTAMP) AS ts")
    first, last = events.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    part = F.least(F.floor((F.col("ts").cast("double") - (first or 0.0)) / max((last or 0.0) - (first or 0.0), 1.0) * n), F.lit(n - 1))
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    with keyed.store(spark):
        try:
            for k in range(n):
                events.filter(part == k).write.mode("append").parquet(path)
                if k == n - 1:
                    spark.range(1).select(F.lit(None).cast("long").alias("user_id"), F.timestamp_seconds(F.lit((last or 0.0) + 10 * 86_400)).alias("ts")).write.mode("append").parquet(path)
                # what waits after a stretch is settled with the next one; only the last has a batch without rows behind it
                spark.conf.set(idle, "true" if k == n - 1 else "false")
                told = make(streams.event_time(streams.files(spark, path, events.schema, max_files=1 << 30), delay="1 hour"))
                told.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.set(idle, before)
    return spark.read.schema(told.schema).parquet(out)


def stream_ttl_cache(spark, sf_dir):
    """Requests of users through a cache of 24 hours, over batches in time order: hits and misses of each user."""
    hits = passed_by(spark, sf_dir, 3, "ttl", lambda s: keyed.ttl_cache(s, "user_id", "ts", slot_ms=600_000))
    return hits.filter("user_id IS NOT NULL").groupBy("user_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def stream_token_bucket(spark, sf_dir):
    """Requests that each user is allowed with three tokens that come back one in a quarter of a day."""
    told = passed_by(spark, sf_dir, 3, "bucket", lambda s: keyed.token_bucket(s, "user_id", "ts", rate=1 / 21_600, capacity=3.0, slot_ms=600_000))
    return told.filter("user_id IS NOT NULL").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("allowed").alias("allowed"))


def stream_percentiles(spark, sf_dir):
    """Percentiles of a value for each kind of event after four batches, and whether their ranks are as near as promised."""
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    rolling = streams.rolling_percentiles(in_files(spark, sf_dir, 4), ["event_type"], "value", shares)
    got = finished(spark, rolling, "percentiles", "complete")
    long = got.select("event_type", "n", F.round("mean", 6).alias("mean"), "largest", F.inline(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(s).alias("share"), F.col(k).alias("at")) for k, s in shares.items()))))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("__e"), F.col("value").alias("__v"))
    ranks = long.join(events, F.col("event_type").eqNullSafe(F.col("__e"))).groupBy("event_type", "n", "mean", "largest", "name", "share").agg(F.count_if(F.col("__v") < F.col("at")).alias("below"), F.count_if(F.col("__v") <= F.col("at")).alias("upto"))
    near = (F.col("below") <= (F.col("share") + 0.002) * F.col("n") + 1) & (F.col("upto") >= (F.col("share") - 0.002) * F.col("n") - 1)
    return ranks.select("event_type", "n", "mean", "largest", "name", near.alias("near"))


def stream_windows(spark, sf_dir):
    s = streams.event_time(events_stream(spark, sf_dir).select("ts", "event_type"), delay="1 hour")
    counts = finished(spark, streams.windowed_counts(s, "ts", "event_type", "1 day"), "windows", "complete")
    return counts.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n")


def dns_record_features(spark, sf_dir):
    """Features of recorded responses, made up from the suppliers."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey").cast("int")
    made = s.select(
        F.concat(F.lit("d"), k.cast("string"), F.lit(".example.com")).alias("domain"), "s_suppkey",
        F.transform(F.sequence(F.lit(1), k % 3 + 1), lambda i: F.concat(F.lit("192.0.2."), i.cast("string"))).alias("A"),
        *(F.lit(None).cast("array<string>").alias(t) for t in ("AAAA", "CNAME", "SOA", "NS")),
        F.when(k % 2 == 0, F.array(F.lit("mx"))).alias("MX"), F.when(k % 4 == 0, F.array(F.lit("v=spf1 -all"))).alias("TXT"),
        F.transform(F.sequence(F.lit(1), k % 3 + 1), lambda i: i * 300.0).alias("ttls"), F.when(k % 2 == 0, F.array(F.lit(10.0))).alias("mx_priorities"),
    )
    f = records.dns_features(made)
    return f.select("domain", "has_A", "num_A", "has_MX", "has_TXT", "ttl_min", "ttl_max", F.round("ttl_mean", 6).alias("ttl_mean"), F.round("ttl_var", 6).alias("ttl_var"), "mx_priority_min", "num_distinct_ips", "has_SPF")


def registration_ages(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    made = o.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("created"), (F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")).cast("timestamp").alias("expires"), F.col("o_orderpriority").alias("name"), F.lit("Privacy Ltd").alias("org"), F.lit("").alias("email"))
    out = records.registration_features(made.withColumn("org", F.when(F.col("o_orderkey") % 2 == 0, F.col("org"))), F.lit("2005-01-01 00:00:00").cast("timestamp"))
    return out.select("o_orderkey", "domain_age_days", "registration_length_days", "has_privacy_protection")


def generated_urls(spark, sf_dir):
    """URLs from templates and the hosts of the pages, three quarters as many as there are pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", U.host(F.col("url")).alias("host")).filter("host IS NOT NULL")
    hosts = lambda rest: pages.filter(F.col("page_id") % 2 == rest).select("host").distinct()
    groups = {"common": (0.5, hosts(0), ["https://{d}", "https://{d}/login"]), "rare": (0.25, hosts(1), ["http://{d}", "http://{d}:8080"])}
    return generate.by_quota(spark, groups, pages.count()).groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls"))


def vectors(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", "embedding", (F.col("label") % 2).cast("int").alias("label"))


def knn_share(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("embedding", F.col("embedding").cast("array<double>"))
    out = models.neighbours(v, v.filter("vec_id % 100 = 0"), 5)
    return out.withColumn("p", F.round("p", 6))


def train_cv(spark, sf_dir):
    """Cross-validated metrics of two models of the zoo."""
    v = models.balanced(models.assemble(vectors(spark, sf_dir), array_col="embedding").withColumn("fold", (F.col("vec_id") % 3).cast("int")))
    chosen = models.zoo(1000)
    out = None
    for name in ("logreg_l2", "naive_bayes"):
        row = models.report(models.cross_validate(v, chosen[name], 3)).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


SQL = {
    "stream_dedupe": "SELECT event_id, event_type FROM events",
    "stream_metrics": "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "stream_upsert": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "stream_retrain": "WITH n AS (SELECT count(*) AS n FROM events), b AS (SELECT CAST(range AS INTEGER) AS batch, CAST(n // 10 AS BIGINT) AS rows FROM range(10), n) SELECT batch, rows, CAST(rows * (batch + 1) AS BIGINT) AS processed, batch % 3 = 2 AS due FROM b",
    "stream_ttl_cache": "WITH RECURSIVE o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events), c AS (SELECT user_id, k, ts AS entry, false AS hit FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, CASE WHEN o.ts < c.entry + INTERVAL 24 HOUR THEN c.entry ELSE o.ts END, o.ts < c.entry + INTERVAL 24 HOUR FROM c JOIN o ON o.user_id = c.user_id AND o.k = c.k + 1) SELECT user_id, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM c GROUP BY user_id",
    "stream_token_bucket": "WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), c AS (SELECT user_id, k, us, 2.0::DOUBLE AS tokens, 1 AS allowed FROM o WHERE k = 1 UNION ALL SELECT user_id, k, us, CASE WHEN x >= 1 THEN x - 1 ELSE x END, CAST(x >= 1 AS INTEGER) FROM (SELECT o.user_id, o.k, o.us, least(3.0::DOUBLE, c.tokens + (o.us - c.us) / 1e6::DOUBLE * (1.0::DOUBLE / 21600)) AS x FROM c JOIN o ON o.user_id = c.user_id AND o.k = c.k + 1)) SELECT user_id, count(*) AS n, CAST(sum(allowed) AS BIGINT) AS allowed FROM c GROUP BY user_id",
    "stream_percentiles": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, max(value) AS largest, name, true AS near FROM events, (VALUES ('p50'), ('p95'), ('p99')) AS v(name) GROUP BY event_type, name",
    "stream_windows": "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "dns_record_features": "SELECT 'd' || s_suppkey || '.example.com' AS domain, 1 AS has_A, CAST(s_suppkey % 3 + 1 AS INTEGER) AS num_A, CAST(s_suppkey % 2 = 0 AS INTEGER) AS has_MX, CAST(s_suppkey % 4 = 0 AS INTEGER) AS has_TXT, 300.0::DOUBLE AS ttl_min, (s_suppkey % 3 + 1) * 300.0::DOUBLE AS ttl_max, CASE s_suppkey % 3 WHEN 0 THEN 300.0::DOUBLE WHEN 1 THEN 450.0 ELSE 600.0 END AS ttl_mean, CASE s_suppkey % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 22500.0 ELSE 60000.0 END AS ttl_var, CASE WHEN s_suppkey % 2 = 0 THEN 10.0::DOUBLE ELSE -1.0 END AS mx_priority_min, CAST(s_suppkey % 3 + 1 AS INTEGER) AS num_distinct_ips, CAST(s_suppkey % 4 = 0 AS INTEGER) AS has_SPF FROM supplier",
    "registration_ages": "SELECT o_orderkey, CAST(floor((epoch(TIMESTAMP '2005-01-01 00:00:00') - epoch(o_orderdate)) / 86400) AS INTEGER) AS domain_age_days, 400 AS registration_length_days, CAST(o_orderkey % 2 = 0 AS INTEGER) AS has_privacy_protection FROM orders",
    "generated_urls": "SELECT g AS \"group\", CAST(floor(count(*) * share) AS BIGINT) AS n, CAST(floor(count(*) * share) AS BIGINT) AS urls FROM pages, (VALUES ('common', 0.5), ('rare', 0.25)) AS v(g, share) WHERE url IS NOT NULL GROUP BY g, share",
    "knn_share": "WITH d AS (SELECT q.vec_id AS query, v.vec_id, v.label % 2 AS y, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) AS dist FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, vec_id) AS rn FROM d) SELECT query, round(avg(y), 6) AS p FROM r WHERE rn <= 5 GROUP BY query",
}
QUERIES = {name: globals()[name] for name in [*SQL, "train_cv"]}
