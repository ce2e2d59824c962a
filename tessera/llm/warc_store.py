"""Content-addressed WARC archive.

``write_archive`` stores two Parquet tables: ``payloads`` has each distinct payload once, under
its SHA-256; ``headers`` has one row per record with the exact bytes before the payload (WARC
header block and HTTP header block), the digest and the record's order. ``read_archive``
checks each stored payload against its digest and rebuilds the records, byte for byte, with a join.

Defined cases: a null payload is empty; a null url leaves the target line out; a url with line breaks is
percent-encoded, with a line that says so, and decoded on reading; rows with a null id
get a record without ``page`` line and come last when the first of equal payloads is chosen.
Repeated rows give repeated records, each with a record id of its own; all rows that share the smallest id of their payload are
responses, and revisits refer to one of them. Of payloads below ``min_revisit`` bytes every record is a response. An empty table
gives empty archives. Columns of the input beside id, url and payload are not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, materialise, work_path

CRLF = "\r\n"
#: What the standard names as the kind of these revisits.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAKS = r"[\r\n]"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _encoded(url: Column) -> Column:
    """A url without line breaks as it is, another one with these and percent signs encoded."""
    whole = F.replace(F.replace(F.replace(url, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.when(url.rlike(BREAKS), whole).otherwise(url)


def _decoded(url: Column) -> Column:
    return F.replace(F.replace(F.replace(url, F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%"))


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit: int) -> DataFrame:
    """(page_id, url, payload_digest, payload_bytes, record_id, first_id, first_record): which payload each row has and who has it first."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), as_bytes(F.col(payload_col)).alias("payload"))
    own = own.select("page_id", "url", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")).alias("record_id"))
    own = materialise(own, "warc-records")  # the random ids are drawn once
    # null ids come last, as in min()
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id"))
    first = own.filter(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(least.alias("first"), F.count(F.lit(1)).alias("__n"))
    # only digests that repeat are joined; the rest are their own first
    again = first.filter("__n > 1").select(F.col("payload_digest").alias("__digest"), F.col("first.page_id").alias("first_id"), F.col("first.record_id").alias("first_record"))
    return own.join(again, own["payload_digest"] == again["__digest"], "left").drop("__digest")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes ``{path}/headers`` and ``{path}/payloads``."""
    rows = plan_records(pages, id_col, url_col, payload_col, min_revisit)
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), _line("Content-Length", F.col("payload_bytes")), F.lit(CRLF))
    rows = rows.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "http": http})
    block = F.length("http") + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    warc = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _encoded(F.col("url"))),
        _line("WARC-Target-URI-Encoding", F.when(F.col("url").rlike(BREAKS), F.lit("percent"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, F.col("first_record"))),
        _line("WARC-Refers-To-Page", F.when(revisit, F.col("first_id"))),
        _line("WARC-Page", F.col("page_id")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _line("Content-Length", block),
        F.lit(CRLF),
    )
    rows.select(F.concat(warc, "http").cast("binary").alias("header"), F.length(warc).alias("warc_chars"), "payload_digest", "record_type").write.parquet(f"{path}/headers")

    # one row for each digest: the holders of the smallest id, and of these one
    source = pages.select(F.col(id_col).alias("__id"), as_bytes(F.col(payload_col)).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    holder = source.groupBy("digest").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")).withColumnRenamed("digest", "__digest")
    keep = source.join(holder, (source["digest"] == holder["__digest"]) & source["__id"].eqNullSafe(holder["__first"]))
    single = keep.filter("__n = 1").select("digest", "payload")
    shared = keep.filter("__n > 1").select("digest", "payload").dropDuplicates(["digest"])
    single.unionByName(shared).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: parsed header fields, payload facts computed from the stored bytes, and the whole ``record``.

    ``verified`` is false where a payload is missing or its bytes do not have the digest they are stored under.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads").select(F.col("digest").alias("__digest"), "payload", F.sha2("payload", 256).alias("__actual"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    joined = headers.join(payloads, headers["payload_digest"] == payloads["__digest"], "left")
    text = F.col("header").cast("string")

    def field(name: str) -> Column:
        pattern = rf"\r\n{name}: ([^\r]*)\r\n"
        return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))

    revisit = field("WARC-Type") == "revisit"
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return joined.select(
        field("WARC-Page").alias("page"),
        F.when(field("WARC-Target-URI-Encoding").isNotNull(), _decoded(field("WARC-Target-URI"))).otherwise(field("WARC-Target-URI")).alias("url"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Refers-To").alias("refers_to_record"),
        field("WARC-Refers-To-Page").alias("refers_to"),
        F.col("__actual").alias("payload_digest"),
        "payload_bytes",
        (F.coalesce(F.col("__actual") == F.substring_index(field("WARC-Payload-Digest"), ":", -1), F.lit(False))).alias("verified"),
        "payload",
        F.concat(F.col("header"), body, F.lit(b"\r\n\r\n")).alias("record"),
    )


def checked(records: DataFrame) -> DataFrame:
    """``records``; reading one that isn't verified is an error."""
    return records.filter(F.col("verified") | F.raise_error(F.lit("a stored payload does not have its digest")).isNotNull())


def op1_warc(spark, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    records = checked(read_archive(spark, path))
    return records.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
