"""Queries over URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import url as U
from tessera.operators import stats


def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")


def features(spark, sf_dir):
    return U.lexical_features(pages(spark, sf_dir))


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def url_lexical_features(spark, sf_dir):
    columns = ["page_id", "url_length", "hostname_length", "path_length", "num_dots", "num_special_chars", "num_digits", "num_uppercase_chars", "has_at_symbol", "has_encoded_chars", "has_non_ascii_chars", "num_fragments", "num_directories", "digit_to_letter_ratio"]
    return rounded(features(spark, sf_dir).select(*columns), ["digit_to_letter_ratio"])


def url_entropy(spark, sf_dir):
    return rounded(features(spark, sf_dir).select("page_id", "url_entropy", "hostname_entropy", "subdomain_entropy"), ["url_entropy", "hostname_entropy", "subdomain_entropy"])


def url_public_suffix(spark, sf_dir):
    return features(spark, sf_dir).select("page_id", "tld_length", "num_subdomains", "subdomain_length", "has_dash_in_domain", "domain_quality")


def url_structure_flags(spark, sf_dir):
    return features(spark, sf_dir).select("page_id", "has_double_slash_redirect", "is_ip_address", "ip_category", "is_shortened", "contains_hex_encoding", "starts_with_https_but_contains_http", "missing_hostname_flag")


def url_query_params(spark, sf_dir):
    return features(spark, sf_dir).select("page_id", "num_query_params")


def url_port_rules(spark, sf_dir):
    # the table's URLs have no ports: one is put after the host for every fifth page
    base = pages(spark, sf_dir).withColumn("url", F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", r"^(https?)://([^/]+)", F.concat(F.lit("$1://$2:"), (F.col("page_id") % 9000).cast("string")))).otherwise(F.col("url")))
    return U.lexical_features(base).select("page_id", "port", "is_risky_port", "protocol_mismatch", "is_unknown_port")


def url_file_type(spark, sf_dir):
    base = pages(spark, sf_dir).withColumn("url", F.concat("url", F.element_at(F.array(*map(F.lit, ["", "/a.zip", "/b.js", "?f=X.EXE", "/c.php"])), (F.col("page_id") % 5 + 1).cast("int"))))
    return U.lexical_features(base).select("page_id", "file_type", "is_file_download", "is_script_file")


def url_keywords(spark, sf_dir):
    base = pages(spark, sf_dir).withColumn("url", F.concat("url", F.element_at(F.array(*map(F.lit, ["", "/Login", "/free", "/paypal", "/verify-bank"])), (F.col("page_id") % 5 + 1).cast("int"))))
    return U.lexical_features(base).select("page_id", "has_login_keyword", "has_suspicious_words", "has_brand_mismatch")


def url_host_profile(spark, sf_dir):
    """Hosts with most pages first; the flagship query."""
    f = U.lexical_features(pages(spark, sf_dir).withColumn("host", U.host(F.col("url"))))
    out = f.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("url_length"), 6).alias("avg_length"), F.max("num_special_chars").alias("max_special"), F.round(F.avg("digit_to_letter_ratio"), 6).alias("avg_digit_ratio"), F.round(F.avg("url_entropy"), 6).alias("avg_entropy"))
    return out.orderBy(F.desc("n"), "host")


SAMPLES = ["http://a", "http", "javascript:alert(1)", "data:text/html,x", "gopher://example.com/x", "https://ok.example.com/p?q=1", "HTTP://UP.example.com", "ftp://f.example.com", "x<script>y", "plain/path"]


def url_validate(spark, sf_dir):
    table = pages(spark, sf_dir).unionByName(spark.range(len(SAMPLES)).select((-F.col("id") - 1).alias("page_id"), F.element_at(F.array(*map(F.lit, SAMPLES)), (F.col("id") + 1).cast("int")).alias("url")))
    return table.select("page_id", U.validate(F.col("url")).alias("v")).select("page_id", "v.is_valid", "v.reason")


def url_sanitize(spark, sf_dir):
    messy = F.concat(F.lit("  "), F.col("url"), F.lit(" \t x\n"))
    return pages(spark, sf_dir).select("page_id", U.sanitize(messy).alias("clean"), U.default_scheme(U.normal_host(F.col("url"))).alias("with_scheme"), U.normal_host(F.col("url")).alias("host"))


def phishing_type_case(spark, sf_dir):
    extra = F.element_at(F.array(*map(F.lit, ["", "/10.20.30.40", "/apple-id", "/secure", "/g00gle", "/signin-password"])), (F.col("page_id") % 6 + 1).cast("int"))
    return pages(spark, sf_dir).select("page_id", U.attack_type(F.concat("url", extra)).alias("attack_type"))


def red_flags_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.array_join(U.red_flags(F.col("url")), "; ").alias("flags"))


def protocol_tld_counts(spark, sf_dir):
    named = pages(spark, sf_dir).select(U.protocol(F.col("url")).alias("protocol"), U.tld(F.col("url")).alias("tld"), U.domain_name(F.col("url")).alias("domain"), "url")
    return named.groupBy("protocol", "tld").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("domain").alias("domains"), F.count_if(F.col("url").contains("?")).alias("with_query"), F.count_if(F.col("url").contains("#")).alias("with_fragment"))


def length_buckets(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(U.length_bucket(F.length("url")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def text_entropy_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", F.round(U.long_text_entropy(F.col("text")), 6).alias("entropy"))


def url_quality_issues(spark, sf_dir):
    return stats.quality_issues(features(spark, sf_dir), [*stats.url_rules(), ("url_length", "over 40", "warning", F.col("url_length") > 40), ("num_query_params", "any", "warning", F.col("num_query_params") > 0)])


PART = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_P = f"SELECT *, lower(regexp_extract(url, '{PART}', 1)) AS sch, lower(regexp_extract(url, '{PART}', 2)) AS host, regexp_extract(url, '{PART}', 3) AS path, regexp_extract(url, '{PART}', 4) AS query FROM pages"


def _count(text, pattern):
    return f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS INTEGER)"


_ENT = "round(coalesce(list_entropy(string_split({0}, '')), 0), 6)"
_SUBS = "list_filter(string_split(CASE WHEN len(string_split(host, '.')) > 2 THEN array_to_string(list_slice(string_split(host, '.'), 1, len(string_split(host, '.')) - 2), '.') ELSE '' END, '.'), lambda s: s <> '' AND s NOT IN ('www', 'm', 'mobile', 'en'))"
_S = "(CASE CAST(page_id % {n} AS INTEGER) {cases} END)"


def _pick(values):
    return _S.format(n=len(values), cases=" ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)))


SQL = {
    "url_lexical_features": f"WITH p AS ({_P}) SELECT page_id, CAST(length(url) AS INTEGER) AS url_length, CAST(length(host) AS INTEGER) AS hostname_length, CAST(length(path) AS INTEGER) AS path_length, {_count('host', '[.]')} AS num_dots, {_count('url', '[?#&%=+@/$!*]')} AS num_special_chars, {_count('url', '[0-9]')} AS num_digits, {_count('url', '[A-Z]')} AS num_uppercase_chars, contains(url, '@') AS has_at_symbol, contains(url, '%') AS has_encoded_chars, regexp_matches(url, '[^\\x00-\\x7F]') AS has_non_ascii_chars, {_count('url', '#')} AS num_fragments, {_count('path', '/')} AS num_directories, round({_count('url', '[0-9]')} / ({_count('url', '[A-Za-z]')} + 1e-6), 6) AS digit_to_letter_ratio FROM p",
    "url_entropy": f"WITH p AS ({_P}) SELECT page_id, {_ENT.format('url')} AS url_entropy, {_ENT.format('host')} AS hostname_entropy, CASE WHEN len({_SUBS}) = 0 THEN 0.0 ELSE round(list_entropy(string_split(array_to_string({_SUBS}, ''), '')), 6) END AS subdomain_entropy FROM p",
    "url_public_suffix": f"WITH p AS ({_P}) SELECT page_id, CAST(length(list_extract(string_split(host, '.'), -1)) AS INTEGER) AS tld_length, CAST(len({_SUBS}) AS INTEGER) AS num_subdomains, CAST(length(array_to_string({_SUBS}, '')) AS INTEGER) AS subdomain_length, contains(list_extract(string_split(host, '.'), -2), '-') AS has_dash_in_domain, 'normal' AS domain_quality FROM p",
    "url_structure_flags": f"WITH p AS ({_P}) SELECT page_id, CAST(contains(trim(substr(url, strpos(url, host) + length(host)), '/'), '//') AS INTEGER) AS has_double_slash_redirect, CAST(regexp_matches(host, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') AS INTEGER) AS is_ip_address, 'none' AS ip_category, CAST(replace(host, 'www.', '') IN ('bit.ly', 'tinyurl.com', 'is.gd', 't.co', 'goo.gl', 'ow.ly', 'buff.ly') AS INTEGER) AS is_shortened, CAST(contains(url, '%') AS INTEGER) AS contains_hex_encoding, CAST(starts_with(url, 'https') AND contains(substr(url, 9), 'http://') AS INTEGER) AS starts_with_https_but_contains_http, CAST(length(host) = 0 AS INTEGER) AS missing_hostname_flag FROM p",
    "url_query_params": f"WITH p AS ({_P}) SELECT page_id, CAST(len(list_distinct(list_transform(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '^[^=]*=.')), lambda x: string_split(x, '=')[1]))) AS INTEGER) AS num_query_params FROM p",
    "url_port_rules": "WITH p AS (SELECT page_id, CAST(CASE WHEN page_id % 5 = 0 THEN page_id % 9000 ELSE -1 END AS INTEGER) AS port, regexp_extract(url, '^([a-z]+):', 1) AS sch FROM pages), r AS (SELECT *, port IN (21, 22, 23, 25, 80, 8080, 8443, 3389, 5900, 53, 445) AS risky FROM p) SELECT page_id, port, CAST(risky AS INTEGER) AS is_risky_port, CAST((sch = 'http' AND port = 443) OR (sch = 'https' AND port = 80) AS INTEGER) AS protocol_mismatch, CAST(port NOT IN (-1, 80, 443) AND NOT risky AS INTEGER) AS is_unknown_port FROM r",
    "url_file_type": f"WITH q AS (SELECT page_id, url || {_pick(['', '/a.zip', '/b.js', '?f=X.EXE', '/c.php'])} AS url FROM pages), p AS ({_P.replace('FROM pages', 'FROM q')}), t AS (SELECT page_id, CASE WHEN regexp_matches(lower(query), '[.](zip|rar|exe|tar|gz|iso|apk|sh|bat)') OR regexp_matches(path, '[.](zip|rar|exe|tar|gz|iso|apk|sh|bat)$') THEN 'download' WHEN regexp_matches(path, '[.](js|php|py|asp|jsp)$') THEN 'script' ELSE 'none' END AS file_type FROM p) SELECT page_id, file_type, CAST(file_type = 'download' AS INTEGER) AS is_file_download, CAST(file_type = 'script' AS INTEGER) AS is_script_file FROM t",
    "url_keywords": f"WITH q AS (SELECT page_id, lower(url || {_pick(['', '/Login', '/free', '/paypal', '/verify-bank'])}) AS u FROM pages) SELECT page_id, CAST(regexp_matches(u, 'login|secure|account|verify') AS INTEGER) AS has_login_keyword, CAST(regexp_matches(u, 'update|password|bank|client|mail|outlook|inbox|admin|billing|free|click|bonus|office|paypal|ebay') AS INTEGER) AS has_suspicious_words, 0 AS has_brand_mismatch FROM q",
    "url_host_profile": f"WITH p AS ({_P}) SELECT host, count(*) AS n, round(avg(length(url)), 6) AS avg_length, max({_count('url', '[?#&%=+@/$!*]')}) AS max_special, round(avg({_count('url', '[0-9]')} / ({_count('url', '[A-Za-z]')} + 1e-6)), 6) AS avg_digit_ratio, round(avg(list_entropy(string_split(url, ''))), 6) AS avg_entropy FROM p GROUP BY host ORDER BY n DESC, host",
    "url_validate": "SELECT page_id, true AS is_valid, CAST(NULL AS VARCHAR) AS reason FROM pages UNION ALL SELECT * FROM (VALUES (-1, true, NULL), (-2, false, 'too short'), (-3, false, 'blocked pattern javascript:'), (-4, false, 'blocked pattern data:'), (-5, false, 'scheme not allowed'), (-6, true, NULL), (-7, true, NULL), (-8, true, NULL), (-9, false, 'blocked pattern <script'), (-10, true, NULL))",
    "url_sanitize": "SELECT page_id, url || ' x' AS clean, 'https://' || regexp_extract(url, '//([^/]*)', 1) AS with_scheme, regexp_extract(url, '//([^/]*)', 1) AS host FROM pages",
    "phishing_type_case": f"WITH q AS (SELECT page_id, lower(url || {_pick(['', '/10.20.30.40', '/apple-id', '/secure', '/g00gle', '/signin-password'])}) AS u FROM pages) SELECT page_id, CASE WHEN regexp_matches(u, '[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}') THEN 'ip_based' WHEN regexp_matches(u, 'paypal|amazon|apple|google|microsoft|facebook|netflix|ebay') THEN 'brand_impersonation' WHEN regexp_matches(u, 'bank|login|account|secure|verify|update') THEN 'financial' WHEN regexp_matches(u, 'faceb00k|g00gle|amaz0n|app1e|micr0soft') THEN 'typosquatting' WHEN regexp_matches(u, '[.](tk|ml|ga|cf|gq|xyz)$') THEN 'suspicious_tld' WHEN CAST(contains(u, 'signin') AS INTEGER) + CAST(contains(u, 'password') AS INTEGER) + CAST(contains(u, 'credential') AS INTEGER) + CAST(contains(u, 'auth') AS INTEGER) + CAST(contains(u, 'validate') AS INTEGER) >= 2 THEN 'credential_harvesting' ELSE 'other' END AS attack_type FROM q",
    "red_flags_text": f"WITH p AS ({_P}) SELECT page_id, concat_ws('; ', CASE WHEN length(host) > 30 THEN 'long host' END, CASE WHEN {_count('host', '-')} >= 2 THEN 'several hyphens' END, CASE WHEN sch <> 'https' THEN 'no https' END, CASE WHEN regexp_matches(lower(url), 'bank|login|account|secure|verify|update') THEN 'account wording' END) AS flags FROM p",
    "protocol_tld_counts": "SELECT regexp_extract(url, '^([a-z-]+)://', 1) AS protocol, regexp_extract(url, '[.]([a-z]{2,})(?:/|:|$)', 1) AS tld, count(*) AS n, count(DISTINCT regexp_extract(url, '://(?:www[.])?([^/:]+)', 1)) AS domains, count(*) FILTER (WHERE contains(url, '?')) AS with_query, count(*) FILTER (WHERE contains(url, '#')) AS with_fragment FROM pages GROUP BY 1, 2",
    "length_buckets": "SELECT CASE WHEN length(url) <= 20 THEN 'very_short' WHEN length(url) <= 50 THEN 'short' WHEN length(url) <= 100 THEN 'medium' WHEN length(url) <= 200 THEN 'long' WHEN length(url) <= 1000 THEN 'very_long' END AS bucket, count(*) AS n FROM pages GROUP BY 1",
    "text_entropy_documents": "SELECT doc_id, round(list_entropy(string_split(text, '')), 6) AS entropy FROM documents",
    "url_quality_issues": f"WITH p AS ({_P}) SELECT * FROM (SELECT 'url_length' AS column_name, 'over 40' AS rule, 'warning' AS severity, count(*) FILTER (WHERE length(url) > 40) AS n FROM p UNION ALL SELECT 'num_query_params', 'any', 'warning', count(*) FILTER (WHERE regexp_matches(query, '(^|&)[^=&]*=[^&]')) FROM p UNION ALL SELECT 'port', 'negative', 'warning', count(*) FROM p) WHERE n > 0",
}
QUERIES = {name: globals()[name] for name in SQL}
