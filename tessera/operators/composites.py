"""Compositions: model-ready tables, cache-through lookups, diversity report, explanations, routing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import labels, score
from tessera.functions import url as U
from tessera.operators import relational, stats


def model_ready(urls: DataFrame, features: DataFrame, key: str, label: str = "label", order: list[str] | None = None, imputation: str = "sentinel") -> DataFrame:
    """Labelled rows joined with their features, labels made 0 or 1 (others dropped), the last row of each key, nulls filled."""
    own = urls.withColumn(label, labels.strict_label(F.col(label))).filter(F.col(label).isNotNull())
    joined = relational.left_with_suffix(own, features.drop(*(c for c in features.columns if c in own.columns and c != key)), key)
    joined = relational.keep_last(joined, [key], [label])
    columns = [f for f in joined.schema.fields if f.name not in (key, label)]
    if imputation == "sentinel":
        joined = labels.impute_sentinel(joined, skip=(key, label))
    else:
        joined = labels.impute_fitted(joined, [f.name for f in columns if labels.is_numeric(f.dataType)], [f.name for f in columns if f.dataType.simpleString() == "string"])
    return joined.select(key, label, *(order or [f.name for f in columns]))


def cache_through(requested: DataFrame, cache: DataFrame, key: str, lookup: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers for ``requested``, cache with the new answers): only keys that the cache lacks are looked up, each once."""
    wanted = requested.select(key).filter(F.col(key).isNotNull()).distinct()
    fresh = lookup(wanted.join(cache.select(key), key, "left_anti"))
    full = cache.unionByName(fresh, allowMissingColumns=True)
    return wanted.join(full, key), full


#: Weight of each dimension in the overall score, and the number of values that counts as full coverage.
DIMENSIONS = {"protocol": (0.15, 11), "category": (0.20, 14), "tld": (0.10, 50), "structural": (0.10, 4), "attack": (0.15, 10)}


def diversity_report(df: DataFrame, dimensions: dict[str, tuple[float, int]] | None = None) -> DataFrame:
    """(dimension, n_values, n, entropy, coverage, weighted), one job: all dimensions are unpivoted and counted together."""
    dimensions = dimensions or DIMENSIONS
    long = df.select(F.inline(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions)))).filter(F.col("value").isNotNull())
    counts = long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("k"))
    n = F.sum("k")
    per = counts.groupBy("dimension").agg(F.count(F.lit(1)).alias("n_values"), n.alias("n"), (F.log2(n) - F.sum(F.col("k") * F.log2("k")) / n).alias("entropy"))
    target, weight = F.lit(1.0), F.lit(0.0)
    for d, (w, t) in dimensions.items():
        target = F.when(F.col("dimension") == d, float(t)).otherwise(target)
        weight = F.when(F.col("dimension") == d, w).otherwise(weight)
    return per.withColumn("coverage", F.least(F.col("n_values") / target, F.lit(1.0)) * 100).withColumn("weighted", F.col("coverage") * weight)


#: Fixed weights of the overall score, by dimension, and the number of values that counts as full coverage. The region is reported only.
OVERALL = {"protocol": (0.15, 30), "category": (0.20, 50), "tld": (0.10, 200), "region": (0.0, 10), "attack": (0.15, 10)}


def overall_diversity(df: DataFrame, collected: str, now: Column) -> DataFrame:
    """(dimension, score, weighted, grade) of the eight dimensions and ``overall``.

    ``df`` has url, label, protocol, category, region, attack_type and a time of collection. Values are counted per dimension (attacks among phishing
    rows only); the others are the spread of lengths against 50, rows of the last 30 days against 30 %, and how evenly rows are dealt to
    domains (Gini against one half). Rows are read twice: the even part needs the counts per domain.
    """
    of = df.select("protocol", "category", U.tld(F.col("url")).alias("tld"), "region", F.when(F.col("label") == "phishing", F.col("attack_type")).alias("attack"), F.length("url").alias("__length"), (F.col(collected) > now - F.expr("INTERVAL 30 DAYS")).alias("__fresh"), U.domain_name(F.col("url")).alias("__domain"))
    of = of.withColumn("tld", F.when(F.col("tld") != "", F.col("tld")))
    values = diversity_report(of, OVERALL).select("dimension", F.col("coverage").alias("score"))
    rows = of.agg(F.stddev_samp("__length").alias("spread"), (F.avg(F.coalesce("__fresh", F.lit(False)).cast("double")) * 100).alias("fresh"))
    shape = rows.select(F.inline(F.array(F.struct(F.lit("structural").alias("dimension"), (F.least(F.col("spread") / 50.0, F.lit(1.0)) * 100).alias("score")), F.struct(F.lit("temporal").alias("dimension"), (F.least(F.col("fresh") / 30.0, F.lit(1.0)) * 100).alias("score")))))
    even = stats.gini(of.filter("__domain <> ''"), "__domain").select(F.lit("traffic").alias("dimension"), ((1 - F.least(F.col("gini") / 0.5, F.lit(1.0))) * 100).alias("score"))
    weight = F.lit(0.10)
    for d, (w, _) in OVERALL.items():
        weight = F.when(F.col("dimension") == d, w).otherwise(weight)
    scored = values.unionByName(shape).unionByName(even).withColumn("weighted", F.coalesce(F.col("score") * weight, F.lit(0.0)))
    total = scored.agg(F.lit("overall").alias("dimension"), F.sum("weighted").alias("score"), F.sum("weighted").alias("weighted"))
    return scored.unionByName(total).withColumn("grade", score.grade(F.col("score")))


def route(key: Column, shares: dict[str, int]) -> Column:
    """Variant by cumulative percentages of a bucket from 0 to 99."""
    if sum(shares.values()) != 100:
        raise ValueError("the shares must add up to 100")
    out, total = None, 0
    for name, share in shares.items():
        total += share
        out = F.when(key < total, name) if out is None else out.when(key < total, name)
    return out


def explain(url: Column, p: Column) -> Column:
    """One paragraph: the verdict with its confidence, then the warnings that the URL gives, or that there are none."""
    flags = U.red_flags(url)
    percent = F.format_string("%.0f", F.round(p * 100, 0))
    head = F.concat(F.lit("This address looks "), score.user_verdict(p), F.lit(" ("), percent, F.lit(" % risk, "), score.confidence_band(p), F.lit(" confidence)."))
    return F.concat(head, F.when(F.size(flags) > 0, F.concat(F.lit(" Warnings: "), F.array_join(flags, ", "), F.lit("."))).otherwise(" No warning signs in the address."))


def harvest(pages: DataFrame, html: str = "html", pattern: str = r'href="([^"#?]+)') -> DataFrame:
    """(link, n): links of all pages and the pages that hold them; a page counts once for each link."""
    links = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(1)))).alias("link"))
    return links.groupBy("link").agg(F.count(F.lit(1)).alias("n"))


def registration_rules() -> list[tuple[str, str, str, Column]]:
    c = F.col
    return [
        ("domain_age_days", "negative", "error", c("domain_age_days") < 0), ("domain_age_days", "over 10000", "warning", c("domain_age_days") > 10000),
        ("registration_length_days", "negative", "error", c("registration_length_days") < 0), ("registration_length_days", "over 3650", "warning", c("registration_length_days") > 3650),
        ("created", "after expiry", "error", c("created") > c("expires")), ("has_privacy_protection", "not 0 or 1", "error", ~c("has_privacy_protection").isin(0, 1)),
    ]


def dns_rules() -> list[tuple[str, str, str, Column]]:
    c = F.col
    counts = [r for n in ("num_A", "num_MX", "num_TXT") for r in ((n, "negative", "error", c(n) < 0), (n, "over 1000", "warning", c(n) > 1000))]
    ttls = [(n, "out of range", "warning", (c(n) < 0) | (c(n) > 2**32)) for n in ("ttl_min", "ttl_max")]
    return counts + ttls + [(n, "not 0 or 1", "error", ~c(n).isin(0, 1)) for n in ("has_A", "has_MX", "has_TXT")]
