"""Addresses joined with the networks that hold them, by the longest prefix, and what a host's addresses say of it.

An address is masked to every prefix length that the network table has, and (family, length, masked halves) is an equality join; of the matches the longest stays. Addresses
are made distinct before they are multiplied by the lengths, which are 162 at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import networks as N

#: Networks up to this number (about 100 bytes each with what is wanted of them) are broadcast; more are joined by shuffle.
MAX_BROADCAST = 200_000
OWNER = ["asn", "asn_org", "asn_country"]


def longest_prefix(addresses: DataFrame, table: DataFrame, address_col: str = "ip", cidr_col: str = "cidr") -> DataFrame:
    """(address, and all columns of ``table``) for each distinct address text that a network holds: those of the longest one.

    Texts that are no address and networks that are none meet nothing. Of networks given twice, the first in order of their columns counts.
    """
    wanted = [c for c in table.columns if c != address_col]
    known = table.select(F.struct(*wanted).alias("__row"), N.network(F.col(cidr_col)).alias("__net")).filter("__net IS NOT NULL")
    known = known.groupBy(*(F.col(f"__net.{k}").alias(f"__{k}") for k in ("family", "length", "high", "low"))).agg(F.min("__row").alias("__row"))
    lengths = known.select("__family", "__length").distinct().collect()  # 162 rows at most
    if known.count() <= MAX_BROADCAST:
        known = F.broadcast(known)
    own = addresses.select(F.col(address_col).cast("string").alias("__text")).filter("__text IS NOT NULL").distinct().withColumn("__a", N.address(F.col("__text"))).filter("__a IS NOT NULL")
    cut = []
    for r in lengths:
        high, low = N.masks(r["__family"], r["__length"])
        cut.append(F.when(F.col("__a.family") == r["__family"], F.struct(F.lit(r["__family"]).alias("__family"), F.lit(r["__length"]).alias("__length"), F.col("__a.high").bitwiseAND(F.lit(high)).alias("__high"), F.col("__a.low").bitwiseAND(F.lit(low)).alias("__low"))))
    if not cut:
        return own.select(F.col("__text").alias(address_col)).limit(0).crossJoin(table.select(*wanted).limit(0))
    tried = own.select("__text", F.inline(F.filter(F.array(*cut), lambda x: x.isNotNull())))
    met = tried.join(known, ["__family", "__length", "__high", "__low"])
    best = met.groupBy("__text").agg(F.max_by("__row", "__length").alias("__row"))
    return best.select(F.col("__text").alias(address_col), *(F.col(f"__row.`{c}`").alias(c) for c in wanted))


def host_networks(hosts: DataFrame, table: DataFrame, host_col: str = "host", addresses_col: str = "ips", cidr_col: str = "cidr") -> DataFrame:
    """(host, num_distinct_ips, asn_list, asn_org_list, asn_country_list, cidr_list): the networks of each host's distinct addresses, in address order.

    A host that is an address itself is its own only address, whatever was resolved for it. An address that no network holds has nulls in its place.
    """
    direct = N.address(F.col(host_col)).isNotNull()
    listed = F.when(direct, F.array(host_col)).otherwise(F.coalesce(F.array_compact(addresses_col), F.array().cast("array<string>")))
    each = hosts.select(F.col(host_col).alias("__host"), F.explode_outer(F.array_distinct(listed)).alias("ip")).distinct()
    found = longest_prefix(each.filter("ip IS NOT NULL"), table.select(F.col(cidr_col).alias("cidr"), *OWNER), "ip", "cidr")
    joined = each.join(found, "ip", "left").groupBy("__host").agg(F.count("ip").alias("num_distinct_ips"), F.array_sort(F.collect_list(F.when(F.col("ip").isNotNull(), F.struct("ip", *OWNER, "cidr")))).alias("__all"))
    return joined.select(F.col("__host").alias(host_col), "num_distinct_ips", *(F.col(f"__all.{c}").alias(f"{c}_list") for c in (*OWNER, "cidr")))
