"""Queries over the compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import labels as L
from tessera.functions import rows
from tessera.functions import score as S
from tessera.functions import url as U
from tessera.operators import composites, models, stats
from tessera.sources import sinks


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_ready_sentinel(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    urls = docs.select("doc_id", F.element_at(F.array(*map(F.lit, ["phish", "legit", "other"])), (F.col("doc_id") % 3 + 1).cast("int")).alias("label"))
    return composites.model_ready(urls, t(spark, sf_dir, "labels"), "doc_id", order=["quality", "toxic"])


def cache_through(spark, sf_dir):
    c = t(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.lit("cached").alias("origin"))
    asked = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    answers, _ = composites.cache_through(asked, c, "k", lambda misses: misses.withColumn("origin", F.lit("looked up")))
    return answers.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


def diversity_report(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select(U.protocol(F.col("url")).alias("protocol"), U.tld(F.col("url")).alias("tld"), U.attack_type(F.col("url")).alias("attack"), U.length_bucket(F.length("url")).alias("structural"))
    out = composites.diversity_report(p, {k: v for k, v in composites.DIMENSIONS.items() if k != "category"})
    return out.select("dimension", "n_values", "n", *(F.round(c, 6).alias(c) for c in ("entropy", "coverage", "weighted")))


def harvest_links(spark, sf_dir):
    return composites.harvest(t(spark, sf_dir, "pages"))


def explanation_text(spark, sf_dir):
    p = (F.col("page_id") * 7 % 10) / 10.0
    return t(spark, sf_dir, "pages").select("page_id", composites.explain(F.col("url"), p).alias("text"))


def ab_routing(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("variant", composites.route(F.col("event_id") % 100, {"control": 70, "candidate": 20, "canary": 10}))
    return e.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def row_validity(spark, sf_dir):
    joined = t(spark, sf_dir, "documents").select("doc_id").join(t(spark, sf_dir, "labels"), "doc_id", "left").withColumn("x", F.when(F.col("doc_id") % 5 == 0, F.lit(float("inf"))).when(F.col("doc_id") % 5 == 1, 1.0))
    fields = [f for f in joined.schema.fields if f.name != "doc_id"]
    return joined.select("doc_id", rows.validity(fields, 3).alias("v"), rows.rich_enough(fields, 0.3).alias("rich")).select("doc_id", "v.is_valid", "v.reason", "rich")


def sanitized_text(spark, sf_dir):
    return sinks.sanitized(t(spark, sf_dir, "documents").select("doc_id", "text"), 500)


def class_weights(spark, sf_dir):
    w = models.balanced(t(spark, sf_dir, "labels").select(F.col("toxic").alias("label")))
    return w.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("weight"))


def value_phrases(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.select("event_id", *(S.translate_value(n, F.col("value")).alias(n) for n in ("domain_age_days", "url_length", "num_dots", "has_mx")), S.translate_value("ttl_min", F.col("value") * 100).alias("ttl_min"))


def binary_label_collapse(spark, sf_dir):
    """Labels of both maps side by side with how often they disagree."""
    docs = t(spark, sf_dir, "documents").select(F.element_at(F.array(*map(F.lit, ["malicious", "legit", "phish", "phishing", "1"])), (F.col("doc_id") % 5 + 1).cast("int")).alias("raw"))
    return docs.groupBy("raw", L.strict_label(F.col("raw")).alias("strict"), L.loose_label(F.col("raw")).alias("loose")).agg(F.count(F.lit(1)).alias("n"))


def registration_issues(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select((F.datediff(F.lit("1996-01-01"), "o_orderdate")).alias("domain_age_days"), (F.col("o_orderkey") % 5000).cast("int").alias("registration_length_days"), F.col("o_orderdate").alias("created"), F.lit("1996-06-01").cast("timestamp_ntz").alias("expires"), (F.col("o_orderkey") % 3).cast("int").alias("has_privacy_protection"))
    return stats.quality_issues(o, composites.registration_rules())


_W = {"protocol": (0.15, 11), "tld": (0.10, 50), "attack": (0.15, 10), "structural": (0.10, 4)}
_DIM = " UNION ALL ".join(f"SELECT '{d}' AS dimension, count(DISTINCT {d}) AS n_values, count({d}) AS n, round(coalesce(entropy({d}), 0), 6) AS entropy, round(least(count(DISTINCT {d}) / {float(t_)}, 1.0) * 100, 6) AS coverage, round(least(count(DISTINCT {d}) / {float(t_)}, 1.0) * 100 * {w}, 6) AS weighted FROM p" for d, (w, t_) in _W.items())
_TYPE = "CASE WHEN regexp_matches(lower(url), 'paypal|amazon|apple|google|microsoft|facebook|netflix|ebay') THEN 'brand_impersonation' WHEN regexp_matches(lower(url), 'bank|login|account|secure|verify|update') THEN 'financial' ELSE 'other' END"
_LEN = "CASE WHEN length(url) <= 20 THEN 'very_short' WHEN length(url) <= 50 THEN 'short' WHEN length(url) <= 100 THEN 'medium' WHEN length(url) <= 200 THEN 'long' END"
_FLAGS = "concat_ws(', ', CASE WHEN length(host) > 30 THEN 'long host' END, CASE WHEN len(string_split(host, '-')) > 2 THEN 'several hyphens' END, CASE WHEN url NOT LIKE 'https:%' THEN 'no https' END, CASE WHEN regexp_matches(lower(url), 'bank|login|account|secure|verify|update') THEN 'account wording' END)"
SQL = {
    "model_ready_sentinel": "SELECT d.doc_id, CAST(CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS label, coalesce(quality, -999) AS quality, coalesce(toxic, -999) AS toxic FROM documents d LEFT JOIN labels USING (doc_id) WHERE d.doc_id % 3 < 2",
    "cache_through": "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT CASE WHEN k IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'cached' ELSE 'looked up' END AS origin, count(*) AS n FROM a GROUP BY 1",
    "diversity_report": f"WITH p AS (SELECT regexp_extract(url, '^([a-z-]+)://', 1) AS protocol, regexp_extract(url, '[.]([a-z]{{2,}})(?:/|:|$)', 1) AS tld, {_TYPE} AS attack, {_LEN} AS structural FROM pages) {_DIM}",
    "harvest_links": "SELECT link, count(*) AS n FROM (SELECT DISTINCT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"#?]+)', 1)) AS link FROM pages)) GROUP BY link",
    "explanation_text": f"WITH p AS (SELECT page_id, url, regexp_extract(url, '//([^/?#]*)', 1) AS host, (page_id * 7 % 10) / 10 AS p FROM pages), f AS (SELECT *, {_FLAGS} AS flags FROM p) SELECT page_id, 'This address looks ' || CASE WHEN p >= 0.5 THEN 'suspicious' ELSE 'safe' END || ' (' || CAST(CAST(round(p * 100) AS INTEGER) AS VARCHAR) || ' % risk, ' || CASE WHEN abs(p - 0.5::DOUBLE) > 0.3::DOUBLE THEN 'high' WHEN abs(p - 0.5::DOUBLE) > 0.15::DOUBLE THEN 'medium' ELSE 'low' END || ' confidence).' || CASE WHEN flags <> '' THEN ' Warnings: ' || flags || '.' ELSE ' No warning signs in the address.' END AS text FROM f",
    "ab_routing": "SELECT CASE WHEN event_id % 100 < 70 THEN 'control' WHEN event_id % 100 < 90 THEN 'candidate' ELSE 'canary' END AS variant, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1",
    "row_validity": "WITH j AS (SELECT d.doc_id, quality, toxic, d.doc_id % 5 AS m FROM documents d LEFT JOIN labels USING (doc_id)), r AS (SELECT doc_id, CASE WHEN quality IS NULL AND m > 1 THEN 'all values are null' WHEN m = 0 THEN 'infinite value' WHEN quality IS NULL OR m > 1 THEN 'fewer than 3 values' END AS reason, (coalesce(quality, 0) <> 0)::INT + (coalesce(toxic, 0) <> 0)::INT + (m < 2)::INT AS k FROM j) SELECT doc_id, reason IS NULL AS is_valid, reason, k / 3 >= 0.3 AS rich FROM r",
    "sanitized_text": "SELECT doc_id, substr(regexp_replace(text, '[\\r\\n]', ' ', 'g'), 1, 500) AS text FROM documents",
    "class_weights": "SELECT toxic AS label, count(*) AS n, round((SELECT count(*) FROM labels) / (2 * count(*)), 6) AS weight FROM labels GROUP BY 1",
    "value_phrases": "SELECT event_id, CASE WHEN value < 30 THEN 'very new' WHEN value < 180 THEN 'recent' WHEN value < 365 THEN 'under a year old' ELSE 'well established' END AS domain_age_days, CASE WHEN value > 100 THEN 'unusually long' WHEN value > 50 THEN 'long' ELSE 'normal length' END AS url_length, CASE WHEN value > 10 THEN 'many' WHEN value > 3 THEN 'several' WHEN value > 0 THEN 'few' ELSE 'none' END AS num_dots, CASE WHEN value > 0 THEN 'present' ELSE 'absent' END AS has_mx, CASE WHEN value * 100 < 300 THEN 'changes very often' WHEN value * 100 < 3600 THEN 'changes often' ELSE 'stable' END AS ttl_min FROM events",
    "binary_label_collapse": "SELECT raw, CASE WHEN raw = 'legit' THEN 0 ELSE 1 END AS strict, CASE WHEN raw IN ('phishing', '1') THEN 1 ELSE 0 END AS loose, count(*) AS n FROM (SELECT CASE CAST(doc_id % 5 AS INTEGER) WHEN 0 THEN 'malicious' WHEN 1 THEN 'legit' WHEN 2 THEN 'phish' WHEN 3 THEN 'phishing' ELSE '1' END AS raw FROM documents) GROUP BY 1, 2, 3",
    "registration_issues": "WITH o AS (SELECT date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-01-01') AS age, o_orderkey % 5000 AS len, o_orderdate AS c, o_orderkey % 3 AS f FROM orders) SELECT * FROM (SELECT 'domain_age_days' AS column_name, 'negative' AS rule, 'error' AS severity, count(*) FILTER (WHERE age < 0) AS n FROM o UNION ALL SELECT 'domain_age_days', 'over 10000', 'warning', count(*) FILTER (WHERE age > 10000) FROM o UNION ALL SELECT 'registration_length_days', 'over 3650', 'warning', count(*) FILTER (WHERE len > 3650) FROM o UNION ALL SELECT 'created', 'after expiry', 'error', count(*) FILTER (WHERE c > TIMESTAMP '1996-06-01') FROM o UNION ALL SELECT 'has_privacy_protection', 'not 0 or 1', 'error', count(*) FILTER (WHERE f = 2) FROM o) WHERE n > 0",
}
QUERIES = {name: globals()[name] for name in SQL}
