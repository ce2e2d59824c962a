"""Queries over models on disk, fold metrics, A/B decisions, ensemble losses, suffix rules, errors and the whole diversity score."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import suffixes
from tessera.functions import url as U
from tessera.operators import composites, ensembles, lifecycle, models, relational, samplers
from tessera.plans.stream_queries import vectors
from tessera.plans.table_queries import scored, t, variants
from tessera.sources import workdir


def model_save_load(spark, sf_dir):
    """A model is fitted, saved with its metadata, loaded, and gives the same scores; one row."""
    v = models.assemble(vectors(spark, sf_dir), array_col="embedding")
    fitted = Pipeline(stages=[C.LogisticRegression(regParam=0.01, maxIter=5, labelCol="label", featuresCol="features")]).fit(v)
    path, names = workdir.shared(spark, "model"), [f"e{i}" for i in range(fitted.stages[0].numFeatures)]
    lifecycle.save_model(spark, fitted, path, names, version="v1.2.3", model_type="url", accuracy=0.5)
    loaded, meta, features = lifecycle.load_model(spark, path)
    both = models.positive(fitted.transform(v)).select("vec_id", F.col("p").alias("a")).join(models.positive(loaded.transform(v)).select("vec_id", F.col("p").alias("b")), "vec_id")
    known = {k: F.lit(meta[k]).alias(k) for k in ("version", "model_type", "algorithm", "threshold")}
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("differ")).select("n", "differ", F.lit(features == names).alias("same_features"), *known.values())


def fold_metrics(spark, sf_dir):
    """Metrics of each of three folds and their mean."""
    rows = scored(spark, sf_dir).select(F.col("toxic").alias("label"), "p", (F.col("doc_id") % 3).cast("int").alias("fold"))
    out = models.fold_report(rows)
    return out.select("fold", *(F.round(c, 6).alias(c) for c in out.columns if c != "fold"))


def broken_urls(spark, sf_dir):
    k = F.col("page_id") % 6
    broken = F.when(k == 0, F.replace("url", F.lit("://"), F.lit(":"))).when(k == 1, F.concat(F.regexp_extract("url", "^([a-z]+://[^/]+)", 1), F.lit(":99999/x"))).when(k == 2, F.lit(None)).otherwise(F.col("url"))
    return t(spark, sf_dir, "pages").select("page_id", broken.alias("url"))


def url_errors(spark, sf_dir):
    """Pages whose URL gives no features, and why; the others have features."""
    good, bad = U.with_errors(broken_urls(spark, sf_dir))
    return bad.select("page_id", "error").unionByName(good.select("page_id", F.lit("none").alias("error")))


#: A few rules of each kind.
RULES = ["com", "org", "net", "example", "co.uk", "uk", "*.ck", "!www.ck", "test"]


def suffix_rules(spark, sf_dir):
    """Hosts made of page numbers under plain rules, a wild rule and its exception."""
    k = (F.col("page_id") % 7 + 1).cast("int")
    ends = F.element_at(F.array(*map(F.lit, ["shop.com", "a.b.co.uk", "www.ck", "x.y.ck", "site.nowhere", "co.uk", "z.example"])), k)
    hosts = t(spark, sf_dir, "pages").select("page_id", F.when(k == 6, ends).otherwise(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("."), ends)).alias("host"))
    return suffixes.split_hosts(hosts, spark.createDataFrame([(r,) for r in RULES], "rule string"))


def ab_lifecycle(spark, sf_dir):
    """Variants with the labels that came in later, and what is decided for each against the control."""
    truth = t(spark, sf_dir, "events").filter("event_id % 4 = 0").select("event_id", (F.col("user_id") % 2).cast("int").alias("actual"))
    e = variants(spark, sf_dir).join(truth, "event_id", "left")
    good = (F.col("actual") == 1) | ((F.col("variant") == "control") & (F.col("event_id") % 12 == 0)) | F.col("actual").isNull()
    rows = e.withColumn("predicted", F.when(good, 1).otherwise(0))
    m = lifecycle.variant_metrics(rows, "variant", "ts", (F.col("variant") == "canary") & (F.col("event_type") == "error"), F.col("predicted"), F.col("actual"), "value")
    out = lifecycle.decide(m, "control", min_requests=100)
    return out.select("variant", "requests", "known", *(F.round(c, 6).alias(c) for c in ("error_rate", "hours", "p95", "accuracy", "fpr")), "decision")


def update_present(spark, sf_dir):
    """Feedback rows updated by later ones whose nulls change nothing."""
    old = t(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("seq"), F.when(F.col("doc_id") % 3 > 0, F.col("quality")).alias("quality"), F.col("toxic"))
    new = t(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("seq"), F.when(F.col("doc_id") % 4 == 0, F.lit(9)).alias("quality"), F.lit(None).cast("int").alias("toxic"), "lang")
    return relational.update_present(old, new, ["doc_id"], ["seq"])


def weight_losses(spark, sf_dir):
    """Best weights in tenths of three scores under each of four losses."""
    rows = scored(spark, sf_dir).select("toxic", F.col("p").alias("a"), (1 - F.col("p")).alias("b"), (F.col("doc_id") * 13 % 17 / 17.0).alias("c"))
    out = ensembles.best(ensembles.losses(rows, "toxic", ["a", "b", "c"]), 6)
    return out.select("loss", "value", *(F.col("weights")[i].alias(f"w{n}") for i, n in enumerate("abc")))


def diversity_overall(spark, sf_dir):
    """The eight dimensions of the pages, as a batch collected over sixty days, and the overall score."""
    p = t(spark, sf_dir, "pages").select(
        "url", F.when(F.col("page_id") % 3 == 0, "phishing").otherwise("legitimate").alias("label"), U.protocol(F.col("url")).alias("protocol"), F.concat(F.lit("c"), F.col("page_id") % 17).alias("category"),
        F.concat(F.lit("r"), F.col("page_id") % 4).alias("region"), F.concat(F.lit("a"), F.col("page_id") % 7).alias("attack_type"), F.timestamp_seconds(F.lit(1_700_000_000) - F.col("page_id") % 60 * 86_400).alias("collected"),
    )
    out = composites.overall_diversity(p, "collected", F.timestamp_seconds(F.lit(1_700_000_000)))
    return out.select("dimension", F.round("score", 6).alias("score"), F.round("weighted", 6).alias("weighted"), "grade")


def version_bump(spark, sf_dir):
    name = F.when(F.col("o_orderkey") % 5 == 0, "model.bin").otherwise(F.concat(F.lit("model_v1."), (F.col("o_orderkey") % 3).cast("string"), F.lit("."), (F.col("o_orderkey") % 11).cast("string"), F.lit(".bin")))
    return t(spark, sf_dir, "orders").select("o_orderkey", lifecycle.next_version(name).alias("version"))


def dimension_samples(spark, sf_dir):
    """Rows of each group of the six dimensions, each dimension with as many rows as there are pages to stand beside, and whether all look as they should."""
    n = t(spark, sf_dir, "pages").count()
    parts = [samplers.sample(spark, d, n) for d in DIMENSIONS]
    rows = reduce(DataFrame.unionByName, parts)
    good = F.col("url").rlike("^[a-z0-9-]+:") & ~F.col("url").rlike("[{}]")
    return rows.groupBy("dimension", "group").agg(F.count(F.lit(1)).alias("n"), F.bool_and(good).alias("good"), F.max("label").alias("label"))


DIMENSIONS = ["protocol", "category", "tld", "region", "structure", "attack_type"]
#: (dimension, group, rows of a thousand, label), worked out by hand from the shares.
_GROUPS = """
protocol chrome-extension 100, protocol moz-extension 50, protocol edge-extension 30, protocol chrome 30, protocol about 20, protocol file 30, protocol custom 50, protocol mobile 50, protocol http 400, protocol https 300, protocol other 20,
category top_sites 150, category government 50, category education 50, category healthcare 30, category news_media 80, category ecommerce 120, category finance 50, category cloud_saas 80, category developer 50, category social_media 80, category entertainment 50, category travel 30, category local_business 80, category international 100,
tld generic_top 500, tld country_codes 250, tld modern_gtlds 150, tld free_abuse 50, tld industry 30, tld branded 20,
region north_america 250, region western_europe 150, region eastern_europe 100, region east_asia 150, region south_asia 100, region southeast_asia 80, region middle_east 50, region africa 50, region latin_america 50, region oceania 20,
structure short 200, structure long 200, structure complex_query 200, structure port 100,
attack_type banking_credential 250, attack_type social_media 150, attack_type cloud_storage 150, attack_type ecommerce 100, attack_type crypto 100, attack_type shipping 80, attack_type government 70, attack_type tech_support 50, attack_type invoice_fraud 30, attack_type generic 20
"""
_VALUES = ", ".join("('{}', '{}', CAST({} AS BIGINT))".format(*g.split()) for g in _GROUPS.replace("\n", " ").split(","))

_HOSTS = "SELECT page_id, CAST(page_id % 7 AS INTEGER) AS k FROM pages"
_DIV = (
    "WITH p AS (SELECT url, page_id, CASE WHEN regexp_extract(url, '^([a-z-]+)://', 1) = '' THEN 'http' ELSE regexp_extract(url, '^([a-z-]+)://', 1) END AS protocol, nullif(regexp_extract(url, '[.]([a-z]{2,})(?:/|:|$)', 1), '') AS tld, nullif(regexp_extract(url, '://(?:www[.])?([^/:]+)', 1), '') AS domain FROM pages), "
    "g AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM (SELECT count(*) AS n FROM p WHERE domain IS NOT NULL GROUP BY domain)), "
    "s AS (SELECT 'protocol' AS dimension, least(count(DISTINCT protocol) / 30.0, 1.0) * 100 AS score, 0.15 AS w FROM p UNION ALL SELECT 'category', least(count(DISTINCT page_id % 17) / 50.0, 1.0) * 100, 0.20 FROM p UNION ALL SELECT 'tld', least(count(DISTINCT tld) / 200.0, 1.0) * 100, 0.10 FROM p UNION ALL "
    "SELECT 'region', least(count(DISTINCT page_id % 4) / 10.0, 1.0) * 100, 0.0 FROM p UNION ALL SELECT 'attack', least(count(DISTINCT page_id % 7) / 10.0, 1.0) * 100, 0.15 FROM p WHERE page_id % 3 = 0 UNION ALL SELECT 'structural', least(stddev_samp(length(url)) / 50.0, 1.0) * 100, 0.10 FROM p UNION ALL "
    "SELECT 'temporal', least(100.0 * count(*) FILTER (WHERE page_id % 60 < 30) / count(*) / 30.0, 1.0) * 100, 0.10 FROM p UNION ALL SELECT 'traffic', (1 - least((2.0 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*)) / 0.5, 1.0)) * 100, 0.10 FROM g), "
    "a AS (SELECT dimension, score::DOUBLE AS score, (score * w)::DOUBLE AS weighted FROM s), b AS (SELECT * FROM a UNION ALL SELECT 'overall', sum(weighted), sum(weighted) FROM a) "
    "SELECT dimension, round(score, 6) AS score, round(weighted, 6) AS weighted, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM b"
)
_SCORED = "SELECT *, (doc_id * 37 % 101) / 101.0 * 0.5 + toxic * 0.3 + 0.05 AS p FROM labels"
SQL = {
    "model_save_load": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS differ, true AS same_features, 'v1.2.3' AS version, 'url' AS model_type, 'LogisticRegressionModel' AS algorithm, 0.5::DOUBLE AS threshold FROM embeddings",
    "fold_metrics": f"WITH s AS ({_SCORED}), f AS (SELECT toxic, p, CAST(doc_id % 3 AS INTEGER) AS fold, CAST(p >= 0.5 AS INTEGER) AS yes FROM s), c AS (SELECT fold, count(*) FILTER (WHERE toxic = 1 AND yes = 1) AS tp, count(*) FILTER (WHERE toxic = 0 AND yes = 1) AS fp, count(*) FILTER (WHERE toxic = 1 AND yes = 0) AS fn, count(*) FILTER (WHERE toxic = 0 AND yes = 0) AS tn FROM f GROUP BY fold), "
    "u AS (SELECT x.fold, sum(CASE WHEN x.p > y.p THEN 1.0 WHEN x.p = y.p THEN 0.5 ELSE 0 END) / count(*) AS auc FROM f x JOIN f y ON x.fold = y.fold WHERE x.toxic = 1 AND y.toxic = 0 GROUP BY x.fold), m AS (SELECT fold, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re, auc FROM c JOIN u USING (fold)), "
    "r AS (SELECT fold, accuracy, pr, re, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1, auc FROM m) SELECT fold, round(accuracy, 6) AS accuracy, round(pr, 6) AS \"precision\", round(re, 6) AS recall, round(f1, 6) AS f1, round(auc, 6) AS auc FROM r UNION ALL SELECT NULL, round(avg(accuracy), 6), round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), round(avg(auc), 6) FROM r",
    "url_errors": "SELECT page_id, CASE CAST(page_id % 6 AS INTEGER) WHEN 0 THEN 'no host' WHEN 1 THEN 'bad port' WHEN 2 THEN 'no url' ELSE 'none' END AS error FROM pages",
    "suffix_rules": f"WITH h AS ({_HOSTS}) SELECT page_id, CASE k WHEN 0 THEN 'p' || page_id || '.shop.com' WHEN 1 THEN 'p' || page_id || '.a.b.co.uk' WHEN 2 THEN 'p' || page_id || '.www.ck' WHEN 3 THEN 'p' || page_id || '.x.y.ck' WHEN 4 THEN 'p' || page_id || '.site.nowhere' WHEN 5 THEN 'co.uk' ELSE 'p' || page_id || '.z.example' END AS host, "
    "['com', 'co.uk', 'ck', 'y.ck', '', 'co.uk', 'example'][k + 1] AS suffix, ['shop', 'b', 'www', 'x', 'nowhere', '', 'z'][k + 1] AS domain, CASE k WHEN 1 THEN 'p' || page_id || '.a' WHEN 4 THEN 'p' || page_id || '.site' WHEN 5 THEN '' ELSE 'p' || page_id END AS subdomain FROM h",
    "ab_lifecycle": "WITH e AS (SELECT *, CASE WHEN event_id % 100 < 50 THEN 'control' WHEN event_id % 100 < 80 THEN 'candidate' ELSE 'canary' END AS variant, CASE WHEN event_id % 4 = 0 THEN user_id % 2 END AS a FROM events), q AS (SELECT *, CASE WHEN a = 1 OR (variant = 'control' AND event_id % 12 = 0) OR a IS NULL THEN 1 ELSE 0 END AS p FROM e), "
    "m AS (SELECT variant, count(*) AS requests, count(a) AS known, avg(CAST(variant = 'canary' AND event_type = 'error' AS INTEGER)) AS error_rate, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS hours, quantile_cont(value, 0.95) AS p95, count(*) FILTER (WHERE p = a) / nullif(count(a), 0) AS accuracy, coalesce(count(*) FILTER (WHERE a = 0 AND p = 1) / nullif(count(*) FILTER (WHERE a = 0), 0), 0) AS fpr FROM q GROUP BY 1) "
    "SELECT m.variant, m.requests, m.known, round(m.error_rate, 6) AS error_rate, round(m.hours, 6) AS hours, round(m.p95, 6) AS p95, round(m.accuracy, 6) AS accuracy, round(m.fpr, 6) AS fpr, CASE WHEN m.error_rate > 0.05 OR m.fpr > 0.10 THEN 'rollback' WHEN m.requests >= 100 AND m.hours >= 24 AND m.accuracy - c.accuracy >= 0.01 AND m.fpr - c.fpr <= 0.02 THEN 'promote' ELSE 'keep' END AS decision FROM m, m c WHERE c.variant = 'control' AND m.variant <> 'control'",
    "update_present": "WITH o AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN max(quality) END AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id), n AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 9 END AS quality, lang FROM documents WHERE doc_id % 2 = 0) SELECT doc_id, CAST(CASE WHEN n.doc_id IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS seq, CAST(coalesce(n.quality, o.quality) AS INTEGER) AS quality, toxic, lang FROM o FULL JOIN n USING (doc_id)",
    "weight_losses": f"WITH s AS ({_SCORED}), g AS (SELECT i.range / 10 AS wa, j.range / 10 AS wb, (10 - i.range - j.range) / 10 AS wc FROM range(11) i, range(11) j WHERE i.range + j.range <= 10), q AS (SELECT wa, wb, wc, toxic, least(greatest(p * wa + (1 - p) * wb + (doc_id * 13 % 17 / 17.0) * wc, 1e-15), 1 - 1e-15) AS r FROM s, g), "
    "l AS (SELECT wa, wb, wc, avg(-(toxic * ln(r) + (1 - toxic) * ln(1 - r))) AS log_loss, avg((r - toxic) ** 2) AS brier, -avg(CAST((r >= 0.5) = (toxic = 1) AS INTEGER)) AS neg_accuracy, -coalesce(2.0 * count(*) FILTER (WHERE toxic = 1 AND r >= 0.5) / nullif(2 * count(*) FILTER (WHERE toxic = 1 AND r >= 0.5) + count(*) FILTER (WHERE toxic = 0 AND r >= 0.5) + count(*) FILTER (WHERE toxic = 1 AND r < 0.5), 0), 0) AS neg_f1 FROM q GROUP BY wa, wb, wc), "
    "u AS (UNPIVOT l ON log_loss, brier, neg_accuracy, neg_f1 INTO NAME loss VALUE value), k AS (SELECT loss, round(value, 6) AS value, wa, wb, wc, row_number() OVER (PARTITION BY loss ORDER BY round(value, 6), wa, wb, wc) AS rn FROM u) SELECT loss, value, wa, wb, wc FROM k WHERE rn = 1",
    "diversity_overall": _DIV,
    "dimension_samples": f"SELECT dimension, \"group\", (SELECT count(*) FROM pages) * n // 1000 AS n, true AS good, CASE WHEN dimension = 'attack_type' OR \"group\" = 'free_abuse' THEN 'phishing' ELSE 'legitimate' END AS label FROM (VALUES {_VALUES}) AS v(dimension, \"group\", n) WHERE (SELECT count(*) FROM pages) * n // 1000 > 0",
    "version_bump": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'v1.0.0' ELSE 'v1.' || o_orderkey % 3 || '.' || (o_orderkey % 11 + 1) END AS version FROM orders",
}
QUERIES = {name: globals()[name] for name in SQL}
