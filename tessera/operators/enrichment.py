"""Batches of URLs enriched from recorded lookups: every row comes out once, with what was found or with why nothing was.

Hosts are made distinct before the lookup, so a host is looked up once however many rows have it. Rows and error rows are parts of one table, written in one pass;
its counters are read from the one column of what was committed, so they tell what is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import url as U

#: Why a row has nothing.
ERRORS = ["no url", "no host", "no record", "lookup failed"]


def looked_up(urls: DataFrame, records: DataFrame, url_col: str = "url", host_col: str = "host") -> DataFrame:
    """``urls`` with the columns of ``records`` (one row a host; ``error`` tells that the lookup failed) and ``error``, null where all is well."""
    own = urls.withColumn("__host", F.nullif(U.host(F.col(url_col)), F.lit("")))
    wanted = [c for c in records.columns if c not in (host_col, "error")]
    once = own.select("__host").filter("__host IS NOT NULL").distinct()
    known = once.join(records.select(F.col(host_col).alias("__host"), F.lit(True).alias("__there"), F.col("error").alias("__failed"), *wanted).dropDuplicates(["__host"]), "__host")
    joined = own.join(known, "__host", "left")
    error = F.when(F.col(url_col).isNull(), ERRORS[0]).when(F.col("__host").isNull(), ERRORS[1]).when(F.col("__there").isNull(), ERRORS[2]).when(F.col("__failed").isNotNull(), ERRORS[3])
    kept = [F.when(F.col("__failed").isNull(), F.col(c)).alias(c) for c in wanted]
    return joined.select(*urls.columns, *kept, error.alias("error"))


def enrich(urls: DataFrame, records: DataFrame, path: str, batch: str, **columns: str) -> dict[str, int]:
    """Writes ``{path}/batch={batch}/failed={true,false}`` and gives the counters of the pass: rows, well, and each kind of error."""
    folder = f"{path}/batch={batch}"
    looked_up(urls, records, **columns).withColumn("failed", F.col("error").isNotNull()).write.mode("overwrite").partitionBy("failed").parquet(folder)
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("error").isNull()).alias("well"), *(F.count_if(F.col("error") == e).alias(e) for e in ERRORS)]
    return urls.sparkSession.read.schema("error string").parquet(folder).agg(*counts).first().asDict()
