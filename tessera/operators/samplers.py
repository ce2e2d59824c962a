"""URL samples with quotas along six dimensions, made from templates in a fixed pseudo-random way: the same rows on every run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relational import keep_first

# The groups of each dimension and their shares.
PROTOCOLS = {"chrome-extension": 0.1, "moz-extension": 0.05, "edge-extension": 0.03, "chrome": 0.03, "about": 0.02, "file": 0.03, "custom": 0.05, "mobile": 0.05, "http": 0.4, "https": 0.3, "other": 0.02}
CATEGORIES = {"top_sites": 600, "government": 200, "education": 200, "healthcare": 120, "news_media": 320, "ecommerce": 480, "finance": 200, "cloud_saas": 320, "developer": 200, "social_media": 320, "entertainment": 200, "travel": 120, "local_business": 320, "international": 400}
TLD_GROUPS = {"generic_top": 0.50, "country_codes": 0.25, "modern_gtlds": 0.15, "free_abuse": 0.05, "industry": 0.03, "branded": 0.02}
REGIONS = {"north_america": 0.25, "western_europe": 0.15, "eastern_europe": 0.10, "east_asia": 0.15, "south_asia": 0.10, "southeast_asia": 0.08, "middle_east": 0.05, "africa": 0.05, "latin_america": 0.05, "oceania": 0.02}
STRUCTURES = {"short": 0.2, "long": 0.2, "complex_query": 0.2, "port": 0.1}
ATTACKS = {"banking_credential": 0.25, "social_media": 0.15, "cloud_storage": 0.15, "ecommerce": 0.10, "crypto": 0.10, "shipping": 0.08, "government": 0.07, "tech_support": 0.05, "invoice_fraud": 0.03, "generic": 0.02}
TLDS = {
    "generic_top": ["com", "net", "org"], "country_codes": ["uk", "de", "jp", "cn", "br", "in", "ru", "fr", "it", "es"], "modern_gtlds": ["app", "dev", "io", "ai", "tech", "online", "site", "cloud"],
    "free_abuse": ["tk", "ml", "ga", "cf", "gq"], "industry": ["bank", "insurance", "law"], "branded": ["google", "amazon", "apple"],
}

#: ``{n}`` is a number of four digits, ``{code}`` six letters and digits, ``{long}`` a hundred, ``{c}`` one of the group's choices.
PROTOCOL_TEMPLATES = {
    "chrome-extension": ["chrome-extension://{long}/popup.html"], "moz-extension": ["moz-extension://{n}-{n}/popup.html"], "edge-extension": ["edge-extension://{code}{code}/popup.html"], "chrome": ["chrome://settings/{code}"], "about": ["about:{code}"],
    "file": ["file:///home/user/{code}.pdf"], "custom": ["app{n}://open/{code}"], "mobile": ["intent://scan/{code}#Intent;end"], "http": ["http://site-{n}.example/{code}"], "https": ["https://site-{n}.example/{code}"], "other": ["ftp://files-{n}.example", "mailto:user{n}@example.com"],
}
PATHS = ["", "/about", "/products", "/contact", "/blog", "/search?q={code}", "/docs/{n}"]
STRUCTURE_TEMPLATES = {
    "short": ["https://s.example/{code}"],
    "long": ["https://bucket-{n}.storage.example/path/{n}.pdf?Expires=1234567890&Signature={long}{long}"],
    "complex_query": ["https://www.example.com/search?" + "&".join(f"filter{i}={{code}}" for i in range(12))],
    "port": [f"http://localhost:{p}/app/{{code}}" for p in (3000, 5000, 8000, 8080)],
}
ATTACK_TEMPLATES = ["https://{c}-verify.site-{n}.test/login", "https://secure-{c}.host-{n}.test/update", "https://login-{c}.page-{n}.test/account"]


def shares(dimension: str) -> dict[str, tuple[float, str, list[str], list[str]]]:
    """Group by group: share, label, templates and choices of a dimension."""
    if dimension == "protocol":
        return {g: (s, "legitimate", PROTOCOL_TEMPLATES[g], [""]) for g, s in PROTOCOLS.items()}
    if dimension == "category":
        return {g: (s / 4000, "legitimate", [f"https://www.{g.replace('_', '-')}-{{n}}.example{p}" for p in PATHS], [""]) for g, s in CATEGORIES.items()}
    if dimension == "tld":
        return {g: (s, "phishing" if g == "free_abuse" else "legitimate", ["https://www.example-site-{n}.{c}"], TLDS[g]) for g, s in TLD_GROUPS.items()}
    if dimension == "region":
        return {g: (s, "legitimate", [f"https://news-{{n}}.{g.replace('_', '-')}.example"], [""]) for g, s in REGIONS.items()}
    if dimension == "structure":
        return {g: (s, "legitimate", STRUCTURE_TEMPLATES[g], [""]) for g, s in STRUCTURES.items()}
    if dimension == "attack_type":
        return {g: (s, "phishing", ATTACK_TEMPLATES, [f"{g.replace('_', '-')}-{k}" for k in range(5)]) for g, s in ATTACKS.items()}
    raise ValueError(f"no dimension {dimension}")


def sample(spark: SparkSession, dimension: str, n: int, seed: int = 42) -> DataFrame:
    """(url, label, source, dimension, group): ``floor(n * share)`` rows of each group, made where they are needed from a row per group."""
    specs = [(g, int(n * share + 1e-9), label, templates, choices) for g, (share, label, templates, choices) in shares(dimension).items()]
    table = spark.createDataFrame(specs, "group string, want int, label string, templates array<string>, choices array<string>").filter("want > 0")
    rows = table.select("*", F.explode(F.sequence(F.lit(1), F.col("want"))).alias("i"))
    draw = lambda k: F.xxhash64(F.lit(seed), F.lit(dimension), "group", "i", F.lit(k))

    def pick(values: Column, k: int) -> Column:
        return F.get(values, F.pmod(draw(k), F.size(values)).cast("int"))

    letters = F.sha2(draw(3).cast("string"), 512)
    url = pick(F.col("templates"), 0)
    for name, value in {"{n}": (F.pmod(draw(1), F.lit(9000)) + 1000).cast("string"), "{code}": F.substring(letters, 1, 6), "{long}": F.substring(letters, 1, 100), "{c}": pick(F.col("choices"), 2)}.items():
        url = F.replace(url, F.lit(name), value)
    return rows.select(url.alias("url"), "label", F.concat(F.lit(f"{dimension}_"), F.col("group")).alias("source"), F.lit(dimension).alias("dimension"), "group")


def collect(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """All dimensions together, four tenths of ``n`` as the measure of the legitimate ones and six of the attacks; the first row of each URL stays."""
    legitimate, attacks = int(n * 0.4), int(n * 0.6)
    wants = {"protocol": 0.25 * legitimate, "category": legitimate, "tld": 0.25 * legitimate, "region": 0.25 * legitimate, "structure": 0.25 * legitimate, "attack_type": attacks}
    parts = [sample(spark, d, int(want), seed).withColumn("__place", F.lit(k)) for k, (d, want) in enumerate(wants.items())]
    return keep_first(reduce(DataFrame.unionByName, parts), ["url"], ["__place", "group"]).drop("__place")
