"""Lexical URL features as column expressions: no Python runs per row (long texts' entropy is an Arrow batch function).

Every function takes a column and returns a column. A null URL gives null (counts, lengths, parts) unless
stated. Parsing follows RFC 3986, appendix B, by regular expression; the scheme and host are lower-cased, the host is
without user, port and brackets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import networks

# Fixed values of the feature definitions.
SUSPICIOUS_KEYWORDS = ["login", "secure", "account", "verify", "update", "password", "bank", "client", "mail", "outlook", "inbox", "admin", "billing", "free", "click", "bonus", "office", "paypal", "ebay"]
LOGIN_KEYWORDS = SUSPICIOUS_KEYWORDS[:4]
BRANDS = ["paypal", "ebay", "amazon"]
DOWNLOAD_SUFFIXES = [".zip", ".rar", ".exe", ".tar", ".gz", ".iso", ".apk", ".sh", ".bat"]
SCRIPT_SUFFIXES = [".js", ".php", ".py", ".asp", ".jsp"]
SHORTENERS = ["bit.ly", "tinyurl.com", "is.gd", "t.co", "goo.gl", "ow.ly", "buff.ly"]
BENIGN_SUBDOMAINS = ["www", "m", "mobile", "en"]
RISKY_PORTS = [21, 22, 23, 25, 80, 8080, 8443, 3389, 5900, 53, 445]

#: Suffixes known to the domain split: generic and country endings, and two-label endings of registries.
SUFFIXES = (
    "com org net edu gov mil int info biz name pro io ai app dev xyz top site online club shop store tech cloud space live work "
    "link click icu vip win loan men bid date party review stream download tk ml ga cf gq me tv cc ws co us uk ca au de fr es it nl be ch "
    "at se no dk fi pl cz sk hu ro bg gr pt ie ru ua by kz tr il ae sa in pk bd lk cn hk tw jp kr sg my th vn id ph nz za ng ke eg ma br ar mx cl pe ve eu asia example test"
).split()
SECOND_LEVEL = "co.uk org.uk ac.uk gov.uk com.au net.au org.au gov.au co.nz co.jp or.jp ne.jp co.kr co.in com.br com.ar com.mx com.cn com.hk com.tw com.sg com.my com.tr com.ua co.za co.il".split()

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, "(?s)" + PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column) -> Column:
    return F.regexp_replace(part(url, 2), "^.*@", "")


def host(url: Column) -> Column:
    """Host without port and brackets, lower-cased; empty if there is none."""
    found = authority(url)
    return F.lower(F.when(found.startswith("["), F.regexp_extract(found, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(found, ":", 1)))


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def port(url: Column) -> Column:
    """The explicit port, -1 if there is none; null if it is no number up to 65535."""
    text = F.regexp_extract(authority(url), r":([0-9]*)$", 1)
    number = text.try_cast("int")
    return F.when(text == "", F.lit(-1)).when(number <= 65535, number)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for empty text. One replacement pass over the text for each distinct character: for short texts."""
    n = F.length(text).cast("double")
    kinds = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    counts = F.transform(kinds, lambda c: (F.octet_length(text) - F.octet_length(F.replace(text, c, F.lit("")))) / F.octet_length(c))
    return F.when(text.isNotNull(), F.aggregate(counts, F.lit(0.0), lambda a, k: a - k / n * F.log2(k / n)))


@F.pandas_udf(T.DoubleType())
def long_text_entropy(texts: pd.Series) -> pd.Series:
    """``entropy`` for texts of any length: one pass over the code points of each text, in Arrow batches."""

    def one(text):
        if text is None:
            return None
        n = np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        n = n[n > 0]
        return float(np.log2(n.sum()) - (n * np.log2(n)).sum() / n.sum()) if len(n) else 0.0

    return texts.map(one)


def suffix(host_: Column) -> Column:
    """Public suffix: a known two-label ending, else a known last label, else empty (also for addresses)."""
    two, last = F.substring_index(host_, ".", -2), F.substring_index(host_, ".", -1)
    deep = (F.length(host_) - F.length(F.replace(host_, F.lit("."), F.lit("")))) >= 2
    return F.when(two.isin(SECOND_LEVEL) & (deep | (two == host_)), two).when(last.isin(SUFFIXES), last).otherwise("")


def _before(text: Column, ending: Column) -> Column:
    """``text`` without ``.ending``."""
    return F.when(ending == "", text).otherwise(F.substr(text, F.lit(1), F.greatest(F.length(text) - F.length(ending) - 1, F.lit(0))))


def domain(host_: Column) -> Column:
    """The label before the suffix; an address whole."""
    return F.when(is_ip(host_), host_).otherwise(F.substring_index(_before(host_, suffix(host_)), ".", -1))


def subdomain(host_: Column) -> Column:
    """What stands before domain and suffix."""
    rest = _before(host_, suffix(host_))
    return F.when(is_ip(host_), F.lit("")).otherwise(_before(rest, F.substring_index(rest, ".", -1)))


def is_ip(host_: Column) -> Column:
    """Four groups of one to three digits, without a test of their range."""
    return host_.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")


def ip_category(host_: Column) -> Column:
    """private, reserved, public, or none where the host is no address; loopback counts as private."""
    return networks.category(host_)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def any_of(text: Column, words: list[str]) -> Column:
    """Whether one of the words is in the text."""
    return text.rlike("|".join(w.replace(".", r"\.") for w in words))


def file_type(path_: Column, query_: Column) -> Column:
    """download if the query holds a download ending anywhere or the path ends with one, else script by the path's ending, else none."""
    ends = lambda suffixes: path_.rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    return F.when(any_of(F.lower(query_), DOWNLOAD_SUFFIXES) | ends(DOWNLOAD_SUFFIXES), "download").when(ends(SCRIPT_SUFFIXES), "script").otherwise("none")


def query_keys(query_: Column) -> Column:
    """Number of distinct keys with a value that is not blank."""
    pairs = F.filter(F.split(query_, "&"), lambda p: p.rlike("^[^=]*=."))
    return F.size(F.array_distinct(F.transform(pairs, lambda p: F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1)))))


def flag(condition: Column) -> Column:
    return condition.cast("int")


def lexical_features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``df`` with the lexical features. Rows without a host, with a null URL or a bad port are invalid and left out.

    ``[.]`` is read as a dot, except for the three flags that look at the URL as given.
    """
    raw = F.col(url_col)
    staged = df.withColumn("__url", F.replace(raw, F.lit("[.]"), F.lit(".")))
    url = F.col("__url")
    staged = staged.withColumns({"__host": host(url), "__path": path(url), "__query": query(url), "__port": port(url), "__scheme": scheme(url), "__lower": F.lower(url)})
    staged = staged.filter((F.col("__host") != "") & F.col("__port").isNotNull())
    h, p, q, n = (F.col(f"__{c}") for c in ("host", "path", "query", "port"))
    staged = staged.withColumns({"__suffix": suffix(h), "__domain": domain(h), "__subs": F.filter(F.split(subdomain(h), r"\."), lambda s: (s != "") & ~s.isin(BENIGN_SUBDOMAINS))})
    subs, lower = F.col("__subs"), F.col("__lower")
    at = F.position(h, url)
    after = F.when(at > 0, F.substr(url, at + F.length(h))).otherwise(url)
    digits, kind = count(url, r"\p{Nd}"), file_type(p, q)
    features = {
        "url_length": F.length(url),
        "hostname_length": F.length(h),
        "path_length": F.length(p),
        "num_subdomains": F.size(subs),
        "num_dots": count(h, r"\."),
        "num_special_chars": count(url, r"[?#&%=+@/$!*]"),
        "num_digits": digits,
        "num_uppercase_chars": count(url, r"\p{Lu}"),
        "has_at_symbol": url.contains("@"),
        "has_double_slash_redirect": flag(F.regexp_replace(after, "^/+|/+$", "").contains("//")),
        "has_dash_in_domain": F.col("__domain").contains("-"),
        "is_ip_address": flag(is_ip(h)),
        "ip_category": ip_category(h),
        "has_encoded_chars": url.contains("%"),
        "has_non_ascii_chars": url.rlike(r"[^\x00-\x7F]"),
        "url_entropy": entropy(url),
        "hostname_entropy": entropy(h),
        "digit_to_letter_ratio": digits / (count(url, r"\p{L}") + F.lit(1e-6)),
        "domain_quality": F.when(F.col("__domain") == "", "empty").when(F.col("__domain").rlike(r"^\p{N}+$"), "numeric_only").when(F.col("__suffix") == "", "no_tld").otherwise("normal"),
        "tld_length": F.length("__suffix"),
        "subdomain_entropy": entropy(F.array_join(subs, "")),
        "subdomain_length": F.length(F.array_join(subs, "")),
        "has_login_keyword": flag(any_of(lower, LOGIN_KEYWORDS)),
        "has_suspicious_words": flag(any_of(lower, SUSPICIOUS_KEYWORDS[4:])),
        "has_brand_mismatch": flag(~lower.contains(F.col("__domain")) & any_of(lower, BRANDS)),
        "file_type": kind,
        "is_file_download": flag(kind == "download"),
        "is_script_file": flag(kind == "script"),
        "is_shortened": flag(F.replace(h, F.lit("www."), F.lit("")).isin(SHORTENERS)),
        "num_fragments": count(url, "#"),
        "num_query_params": query_keys(q),
        "num_directories": count(p, "/"),
        "port": n,
        "is_risky_port": flag(n.isin(RISKY_PORTS)),
        "protocol_mismatch": flag(((F.col("__scheme") == "http") & (n == 443)) | ((F.col("__scheme") == "https") & (n == 80))),
        "is_unknown_port": flag(~n.isin(-1, 80, 443, *RISKY_PORTS)),
        "contains_hex_encoding": flag(raw.contains("%")),
        "starts_with_https_but_contains_http": flag(raw.startswith("https") & F.substr(raw, F.lit(9)).contains("http://")),
        "missing_hostname_flag": flag(F.length(h) == 0),
    }
    return staged.select(*df.columns, *(v.alias(k) for k, v in features.items()))


def feature_error(url: Column) -> Column:
    """Why a URL has no lexical features; null where it has."""
    given = F.replace(url, F.lit("[.]"), F.lit("."))
    return F.when(url.isNull(), "no url").when(host(given) == "", "no host").when(port(given).isNull(), "bad port")


def with_errors(df: DataFrame, url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """(rows with their features, rows without any and why, as ``error``): together they are all rows."""
    error = feature_error(F.col(url_col))
    return lexical_features(df, url_col), df.withColumn("error", error).filter(F.col("error").isNotNull())


# Fixed values of the validation rules.
MAX_URL, MIN_URL = 2048, 7
SCHEMES = ["http", "https", "ftp"]
BLOCKED = ["<script", "javascript:", "data:", "vbscript:", "file://"]


def validate(url: Column) -> Column:
    """Struct (is_valid, reason): the first rule that a URL breaks, in this order; the reason is null for a valid one."""
    reason = F.when(url.isNull(), "not a string").when(F.length(url) > MAX_URL, "too long").when(F.length(url) < MIN_URL, "too short")
    for pattern in BLOCKED:
        reason = reason.when(F.lower(url).contains(pattern), f"blocked pattern {pattern}")
    reason = reason.when((scheme(url) != "") & ~scheme(url).isin(SCHEMES), "scheme not allowed").when((part(url, 2) == "") & (path(url) == ""), "no domain or path")
    return F.struct(reason.isNull().alias("is_valid"), reason.alias("reason"))


def sanitize(url: Column) -> Column:
    """Trimmed, without NUL characters, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(url, r"\x00", ""), r"\s+", " "))


def default_scheme(url: Column) -> Column:
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), url).otherwise(F.concat(F.lit("https://"), url))


def normal_host(url: Column) -> Column:
    """Scheme, path and port stripped, lower case."""
    return F.lower(F.substring_index(F.substring_index(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), "/", 1), ":", 1))


def protocol(url: Column) -> Column:
    found = F.regexp_extract(url, "^([a-z-]+)://", 1)
    return F.when(found == "", "http").otherwise(found)


def tld(url: Column) -> Column:
    return F.regexp_extract(url, r"\.([a-z]{2,})(?:/|:|$)", 1)


def domain_name(url: Column) -> Column:
    return F.regexp_extract(url, r"://(?:www\.)?([^/:]+)", 1)


def length_bucket(length: Column) -> Column:
    """Right-closed length classes; null outside."""
    out = F.when((length > 0) & (length <= 20), "very_short")
    for low, high, name in ((20, 50, "short"), (50, 100, "medium"), (100, 200, "long"), (200, 1000, "very_long")):
        out = out.when((length > low) & (length <= high), name)
    return out


def semantic_version(name: Column) -> Column:
    found = F.regexp_extract(name, r"(v\d+\.\d+\.\d+)", 1)
    return F.when(found == "", "v1.0.0").otherwise(found)


def cache_key(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.md5(value.cast("binary")))


# Fixed values of the type rules.
TYPE_BRANDS = ["paypal", "amazon", "apple", "google", "microsoft", "facebook", "netflix", "ebay"]
FINANCIAL = ["bank", "login", "account", "secure", "verify", "update"]
TYPOS = ["faceb00k", "g00gle", "amaz0n", "app1e", "micr0soft"]
TYPE_TLDS = [".tk", ".ml", ".ga", ".cf", ".gq", ".xyz"]
CREDENTIALS = ["signin", "password", "credential", "auth", "validate"]


def attack_type(url: Column) -> Column:
    """First of seven rules that holds; the last is 'other'."""
    u = F.lower(url)
    brand = F.lit(False)
    for b in TYPE_BRANDS:
        brand = brand | (u.contains(b) & ~u.startswith(f"https://{b}.") & ~u.startswith(f"https://www.{b}."))
    credentials = sum((u.contains(w).cast("int") for w in CREDENTIALS), F.lit(0))
    ends = F.lit(False)
    for t in TYPE_TLDS:
        ends = ends | u.endswith(t)
    return (
        F.when(u.rlike(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"), "ip_based")
        .when(brand, "brand_impersonation")
        .when(any_of(u, FINANCIAL), "financial")
        .when(any_of(u, TYPOS), "typosquatting")
        .when(ends, "suspicious_tld")
        .when(credentials >= 2, "credential_harvesting")
        .otherwise("other")
    )


def red_flags(url: Column) -> Column:
    """Array of the warnings that the host and path give, in a fixed order."""
    h, u = host(url), F.lower(url)
    rules = [
        (any_of(subdomain(h), TYPE_BRANDS) & (subdomain(h) != ""), "brand in subdomain"),
        (F.concat(F.lit("."), suffix(h)).isin(TYPE_TLDS), "unusual ending"),
        (F.length(h) > 30, "long host"),
        (count(h, "-") >= 2, "several hyphens"),
        (is_ip(h), "numeric host"),
        (scheme(url) != "https", "no https"),
        (any_of(u, FINANCIAL), "account wording"),
    ]
    return F.filter(F.array(*(F.when(c, t) for c, t in rules)), lambda x: x.isNotNull())
