"""DNS and registration features from recorded responses, as column expressions. Clocks are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.url import entropy, is_ip

TYPES = ["A", "AAAA", "MX", "NS", "TXT", "CNAME", "SOA"]
PRIVACY = "privacy|whoisguard|redacted|proxy|protected"


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def variance_of(values: Column) -> Column:
    """Population variance; 0 for one value, -1 for none."""
    mean = mean_of(values)
    spread = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(values)
    return F.when(F.size(values) <= 0, -1.0).when(F.size(values) == 1, 0.0).otherwise(spread)


def dns_features(df: DataFrame, domain: str = "domain") -> DataFrame:
    """From array columns named by record type and ``ttls``, ``mx_priorities``: counts, flags, TTL and MX figures, text flags. An address as domain has A only."""
    have = lambda t: F.coalesce(F.col(t), F.array().cast("array<string>"))
    out = {}
    for t in TYPES:
        n = F.size(have(t))
        n = F.when(is_ip(F.col(domain)), F.lit(1 if t == "A" else 0)).otherwise(n)
        out |= {f"has_{t}": (n > 0).cast("int"), f"num_{t}": n}
    ttls, mx = (F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>")) for c in ("ttls", "mx_priorities"))
    some = lambda values, f: F.when(F.size(values) > 0, f(values)).otherwise(-1.0)
    text = F.lower(F.array_join(have("TXT"), " "))
    out |= {
        "ttl_min": some(ttls, F.array_min), "ttl_max": some(ttls, F.array_max), "ttl_mean": some(ttls, mean_of), "ttl_var": variance_of(ttls),
        "mx_priority_min": some(mx, F.array_min), "mx_priority_max": some(mx, F.array_max),
        "num_distinct_ips": F.size(F.array_distinct(F.concat(have("A"), have("AAAA")))),
        "txt_entropy": F.when(F.size(have("TXT")) > 0, mean_of(F.transform(have("TXT"), entropy))).otherwise(0.0),
        "has_SPF": text.contains("v=spf").cast("int"), "has_DKIM": text.contains("dkim").cast("int"), "has_DMARC": text.contains("dmarc").cast("int"),
    }
    return df.select(domain, *(v.alias(k) for k, v in out.items()))


def parse_date(texts: Column) -> Column:
    """First of a list of date texts, without its zone; null if it can't be read."""
    text = F.regexp_replace(F.get(texts, F.lit(0)), r"(Z|[+-]\d\d:?\d\d)$", "")
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def days(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400).cast("int")


def registration_features(df: DataFrame, now: Column) -> DataFrame:
    """Age and length of a registration in whole days, and whether a privacy service is named."""
    owner = F.lower(F.concat_ws(" ", "name", "org", "email"))
    return df.withColumns({"domain_age_days": days(now, F.col("created")), "registration_length_days": days(F.col("expires"), F.col("created")), "has_privacy_protection": owner.rlike(PRIVACY).cast("int")})
