"""Row generators: URL samples from templates, in a fixed pseudo-random order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relational import by_hash


def expand(spark: SparkSession, domains: list[str] | DataFrame, templates: list[str]) -> DataFrame:
    """(url) for each domain (a list, or the first column of a table) and template; ``{d}`` stands for the domain."""
    names = domains.toDF("d") if isinstance(domains, DataFrame) else spark.createDataFrame([(d,) for d in domains], "d string")
    made = names.select(F.explode(F.array(*(F.replace(F.lit(t), F.lit("{d}"), F.col("d")) for t in templates))).alias("url"))
    return made.distinct()


def sample_expanded(spark: SparkSession, domains: list[str], templates: list[str], n: int, label: str, seed: int = 42) -> DataFrame:
    return expand(spark, domains, templates).withColumn("label", F.lit(label)).orderBy(by_hash("url", seed), "url").limit(n)


def by_quota(spark: SparkSession, groups: dict[str, tuple[float, list[str] | DataFrame, list[str]]], n: int) -> DataFrame:
    """(url, group): ``floor(n * share)`` rows of each group (share, domains, templates), repeated with numbered paths where a group has too few."""
    parts = []
    for name, (share, domains, templates) in groups.items():
        want = int(n * share)
        base = expand(spark, domains, templates)
        rounds = -(-want // max(base.count(), 1))
        numbered = base.crossJoin(spark.range(max(rounds, 1)).withColumnRenamed("id", "k")).select(F.when(F.col("k") == 0, F.col("url")).otherwise(F.concat("url", F.lit("/"), F.col("k").cast("string"))).alias("url"), "k")
        parts.append(numbered.orderBy("k", by_hash("url"), "url").limit(want).select("url", F.lit(name).alias("group")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
