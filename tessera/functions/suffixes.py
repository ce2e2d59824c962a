"""Domains by public-suffix rules given as a table: plain rules, ``*.`` rules and ``!`` exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules are broadcast up to this number (the public list has some ten thousand); more are joined by shuffle.
MAX_BROADCAST_RULES = 500_000


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule) from a list in the usual format: one a line up to the first white space, ``//`` starts a comment."""
    line = F.lower(F.regexp_extract(F.trim("value"), r"^(\S*)", 1))
    return spark.read.text(path).select(line.alias("rule")).filter((F.col("rule") != "") & ~F.col("rule").startswith("//")).distinct()


def split_hosts(df: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """``df`` with ``suffix``, ``domain`` and ``subdomain`` of each host; where no rule holds the suffix is empty and the last label the domain.

    Distinct hosts are split once: all endings of a host meet the rules, an exception beats all, else the longest rule holds.
    """
    hosts = df.select(F.col(host).alias("__host")).filter("__host IS NOT NULL").distinct().withColumn("__labels", F.split(F.lower(F.regexp_replace("__host", r"\.$", "")), r"\."))
    if rules.count() <= MAX_BROADCAST_RULES:
        rules = F.broadcast(rules)
    n = F.size("__labels")
    ends = hosts.select("__host", F.explode(F.sequence(F.lit(1), n)).alias("__k"), "__labels")
    own = F.array_join(F.slice("__labels", n - F.col("__k") + 1, F.col("__k")), ".")
    wild = F.when(F.col("__k") > 1, F.concat(F.lit("*."), F.array_join(F.slice("__labels", n - F.col("__k") + 2, F.col("__k") - 1), ".")))
    kinds = F.array(F.struct(own.alias("rule"), F.col("__k").alias("length"), F.lit(0).alias("exception")), F.struct(wild.alias("rule"), F.col("__k").alias("length"), F.lit(0).alias("exception")), F.struct(F.concat(F.lit("!"), own).alias("rule"), (F.col("__k") - 1).alias("length"), F.lit(1).alias("exception")))
    met = ends.select("__host", F.inline(kinds)).join(rules, "rule")
    longest = met.groupBy("__host").agg(F.max(F.struct("exception", "length"))["length"].alias("__n")).withColumnRenamed("__host", "__met")
    found = hosts.join(longest, F.col("__host") == F.col("__met"), "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    labels = F.col("__labels")
    parts = found.select(
        "__host",
        F.array_join(F.slice(labels, n - F.col("__n") + 1, F.col("__n")), ".").alias("suffix"),
        F.coalesce(F.get(labels, n - F.col("__n") - 1), F.lit("")).alias("domain"),
        F.array_join(F.slice(labels, F.lit(1), F.greatest(n - F.col("__n") - 1, F.lit(0))), ".").alias("subdomain"),
    )
    return df.drop("suffix", "domain", "subdomain").join(parts, F.col(host) == F.col("__host"), "left").drop("__host")
