"""Queries over the state of collection: sizes, growth, queues, issues, decisions, blends."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import score as S
from tessera.functions import url as U
from tessera.operators import composites, models, relational, stats
from tessera.plans import stream_queries
from tessera.plans.table_queries import scored, t


def url_normalize(spark, sf_dir):
    """Default scheme, host and domain of addresses that may come without a scheme."""
    bare = t(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url")).alias("url"))
    full = U.default_scheme(F.col("url"))
    return bare.select("page_id", full.alias("full_url"), U.normal_host(F.col("url")).alias("host"), U.domain_name(full).alias("domain"))


def domain_extract_stats(spark, sf_dir):
    """Addresses and forms of each domain, in one pass."""
    p = t(spark, sf_dir, "pages").select("url", U.domain_name(F.col("url")).alias("domain"))
    c = F.col("url")
    return p.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_if(c.rlike(r":\d+(/|$)")).alias("with_port"), F.count_if(c.contains("?")).alias("with_query"), F.count_if(c.contains("#")).alias("with_fragment"), F.countDistinct(U.protocol(c)).alias("protocols"))


def cache_keys(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    version = F.concat(F.lit("model_v"), F.col("o_orderkey") % 7, F.lit("."), F.col("o_orderkey") % 5, F.lit(".0.pkl"))
    named = F.when(F.col("o_orderkey") % 2 == 0, version).otherwise("model.pkl")
    return o.select("o_orderkey", U.cache_key("scan", F.col("o_orderstatus")).alias("cache_key"), U.semantic_version(named).alias("version"))


def dns_issues(spark, sf_dir):
    """Broken rules of resolver features, with out-of-range values put in."""
    k = F.col("s_suppkey")
    made = t(spark, sf_dir, "supplier").select(
        (k % 9 - 1).cast("int").alias("num_A"), (k % 3).cast("int").alias("num_MX"), (k * 40).alias("num_TXT"), ((k % 4) * 300.0 - 300.0).alias("ttl_min"), F.when(k % 10 == 0, 1e10).otherwise(600.0).alias("ttl_max"),
        (k % 2).cast("int").alias("has_A"), F.when(k % 6 == 0, 2).otherwise(1).alias("has_MX"), F.lit(0).alias("has_TXT"),
    )
    return stats.quality_issues(made, composites.dns_rules())


def family_agreement(spark, sf_dir):
    return stats.agreement({n: t(spark, sf_dir, n) for n in ("documents", "labels", "pages")})


def growth_report(spark, sf_dir):
    """Rows of the tables against the counts of an earlier run (here: orders of the first years)."""
    o = t(spark, sf_dir, "orders")
    before = stats.table_sizes({"orders": o.filter(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp"))})
    return stats.growth(stats.table_sizes({"orders": o, "lineitem": t(spark, sf_dir, "lineitem")}), before)


def queue_state(spark, sf_dir):
    out = stats.queue_state(t(spark, sf_dir, "events"), "ts", ["event_type"])
    return out.select("event_type", "n", "earliest", "latest", F.round("per_hour", 6).alias("per_hour"))


def speed_up(spark, sf_dir):
    out = stats.speed_up(t(spark, sf_dir, "events"), "value", "event_type", "error")
    return out.select("event_type", F.round("p95", 6).alias("p95"), F.round("speed_up", 6).alias("speed_up"))


def class_balance(spark, sf_dir):
    return relational.class_balance(t(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", "doc_id")


def sample_exact(spark, sf_dir):
    """A sampling operator: five hundred rows in a fixed pseudo-random order (all, where there are fewer)."""
    return relational.sample_exact(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 500, "o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("orders"))


def positional_join(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    s = t(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return relational.by_position(c, s, "c_name", "s_suppkey").select("c_custkey", "s_suppkey")


def retrain_and_deploy(spark, sf_dir):
    """Decision rules over a table of runs: one run for each user."""
    runs = t(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("new_rows"), F.avg((F.col("event_type") != "error").cast("double")).alias("accuracy"), (F.avg((F.col("event_type") == "error").cast("double")) / 4).alias("fpr"), F.min("value").alias("hours"),
    )
    return runs.select("user_id", "new_rows", S.retrain_due(F.col("new_rows"), F.col("hours")).alias("due"), S.deploy_decision(F.col("accuracy"), F.col("fpr"), F.lit(0.8)).alias("decision"))


def meta_blend(spark, sf_dir):
    """Learned weights of three scores (rows only: an iterative fit)."""
    rows = scored(spark, sf_dir).select(F.col("toxic").alias("label"), F.col("p").alias("a"), (F.col("doc_id") * 13 % 17 / 17.0).alias("b"), (F.col("doc_id") * 7 % 11 / 11.0).alias("c"))
    found = models.meta_weights(rows, ["a", "b", "c"])
    return spark.createDataFrame(list(zip(["a", "b", "c"], found, strict=True)), "model string, weight double")


def feature_importance(spark, sf_dir):
    """Largest coefficients of a linear model and what each adds to a row on average (rows only: an iterative fit)."""
    v = models.balanced(models.assemble(stream_queries.vectors(spark, sf_dir), array_col="embedding"))
    model = models.zoo(1000)["logreg_l2"].fit(v)
    names = [f"e{i}" for i in range(model.numFeatures)]
    means = v.select(F.posexplode(F.col("embedding").cast("array<double>"))).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()  # a row per component
    added = models.linear_contributions(v, model, "embedding", [r["m"] for r in means])
    mean_abs = added.select(F.posexplode("contributions")).groupBy("pos").agg(F.avg(F.abs("col")).alias("mean_abs"))
    ranked = spark.createDataFrame(models.importances(model, names), "feature string, importance double")
    return ranked.join(mean_abs.select(F.concat(F.lit("e"), "pos").alias("feature"), "mean_abs"), "feature")


SQL = {
    "url_normalize": "WITH b AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END AS url FROM pages), f AS (SELECT page_id, url, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN url ELSE 'https://' || url END AS full_url FROM b) SELECT page_id, full_url, lower(split_part(split_part(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '/', 1), ':', 1)) AS host, regexp_extract(full_url, '://(?:www[.])?([^/:]+)', 1) AS domain FROM f",
    "domain_extract_stats": "SELECT regexp_extract(url, '://(?:www[.])?([^/:]+)', 1) AS domain, count(*) AS n, count(*) FILTER (WHERE regexp_matches(url, ':[0-9]+(/|$)')) AS with_port, count(*) FILTER (WHERE contains(url, '?')) AS with_query, count(*) FILTER (WHERE contains(url, '#')) AS with_fragment, count(DISTINCT CASE WHEN regexp_extract(url, '^([a-z-]+)://', 1) = '' THEN 'http' ELSE regexp_extract(url, '^([a-z-]+)://', 1) END) AS protocols FROM pages GROUP BY 1",
    "cache_keys": "SELECT o_orderkey, 'scan:' || md5(o_orderstatus) AS cache_key, CASE WHEN o_orderkey % 2 = 0 THEN 'v' || (o_orderkey % 7) || '.' || (o_orderkey % 5) || '.0' ELSE 'v1.0.0' END AS version FROM orders",
    "dns_issues": "WITH s AS (SELECT s_suppkey % 9 - 1 AS a, s_suppkey * 40 AS x, (s_suppkey % 4) * 300 - 300 AS lo, s_suppkey % 10 = 0 AS hi, s_suppkey % 6 = 0 AS two FROM supplier) SELECT * FROM (SELECT 'num_A' AS column_name, 'negative' AS rule, 'error' AS severity, count(*) FILTER (WHERE a < 0) AS n FROM s UNION ALL SELECT 'num_TXT', 'over 1000', 'warning', count(*) FILTER (WHERE x > 1000) FROM s UNION ALL SELECT 'ttl_min', 'out of range', 'warning', count(*) FILTER (WHERE lo < 0) FROM s UNION ALL SELECT 'ttl_max', 'out of range', 'warning', count(*) FILTER (WHERE hi) FROM s UNION ALL SELECT 'has_MX', 'not 0 or 1', 'error', count(*) FILTER (WHERE two) FROM s) WHERE n > 0",
    "family_agreement": "WITH c AS (SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'pages', count(*) FROM pages) SELECT name, n, (SELECT min(n) = max(n) FROM c) AS agree FROM c",
    "growth_report": "SELECT 'orders' AS name, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1995-01-01') AS previous, count(*) AS current, count(*) - count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1995-01-01') AS added FROM orders UNION ALL SELECT 'lineitem', 0, count(*), count(*) FROM lineitem",
    "queue_state": "SELECT event_type, count(*) AS n, min(ts) AS earliest, max(ts) AS latest, round(CASE WHEN max(ts) > min(ts) THEN count(*) / ((epoch(max(ts)) - epoch(min(ts))) / 3600) END, 6) AS per_hour FROM events GROUP BY 1",
    "speed_up": "WITH p AS (SELECT event_type, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1) SELECT event_type, round(p95, 6) AS p95, round((SELECT p95 FROM p WHERE event_type = 'error') / p95, 6) AS speed_up FROM p WHERE EXISTS (SELECT 1 FROM p WHERE event_type = 'error')",
    "class_balance": "WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS k FROM labels) SELECT doc_id, toxic FROM r WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))",
    "sample_exact": "SELECT least(count(*), 500) AS n, least(count(DISTINCT o_orderkey), 500) AS orders FROM orders",
    "positional_join": "SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_name) AS k FROM customer) JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) USING (k)",
    "retrain_and_deploy": "WITH r AS (SELECT user_id, count(*) AS new_rows, avg((event_type <> 'error')::INT) AS acc, avg((event_type = 'error')::INT) / 4 AS fpr, min(value) AS h FROM events GROUP BY 1) SELECT user_id, new_rows, new_rows >= 100 OR h IS NULL OR h >= 24 AS due, CASE WHEN acc >= 0.85 AND fpr <= 0.05 AND acc >= 0.8 THEN 'deploy' ELSE 'rollback' END AS decision FROM r",
}
QUERIES = {name: globals()[name] for name in [*SQL, "meta_blend", "feature_importance"]}
