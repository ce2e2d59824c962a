"""Line deduplication with once-seen and twice-seen Bloom filters.

Pass 1 builds both filters over the line keys of each document; pass 2 shuffles only lines whose
key is in the twice-seen filter, counts their documents exactly and chooses what goes; a last
pass rewrites the texts. Filter bits follow the number of lines, up to ``max_filter_bits``; beyond
that more lines are suspected and shuffled, and the result is the same.

Defined cases: a null or empty text is one empty line. Rows with the same id count as one document
(null is an id too) and every row gets its own result. Keys shorter than ``min_chars`` never go.
Very long texts are treated whole. An empty table gives an empty result. Columns beside id and
text pass through ``dedup_lines``; working columns have names starting with ``__``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, map_batches, power_of_two
from tessera.llm.repeat_filter import build, gather, suspected

ROWS = 2
LINES = "n_lines long, n_dropped long, kept binary"


def line_keys(text: bytes) -> list[bytes]:
    """Keys of a text's lines: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [line.strip() for line in text.lower().split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, max_filter_bits: int = 1 << 30) -> DataFrame:
    """(doc, key, n_docs, first) for each document and each of its keys found in ``min_docs`` documents or more.

    ``first`` is true in the document of smallest id (nulls last), the first occurrence.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("__id"), as_bytes(F.col(text_col)).alias("__text"))
    newline = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1
    n_lines = docs.agg(F.sum(newline)).first()[0] or 1
    bits = power_of_two(16 * n_lines, 1 << 16, max_filter_bits)

    def keys_of(text: bytes) -> list[bytes]:
        return [k for k in dict.fromkeys(line_keys(text)) if long_enough(k, min_chars)]

    def hashes_of(batch):
        found = [xxhash.xxh3_64_intdigest(k) for t in batch.column("__text").to_pylist() for k in keys_of(t)]
        return np.array(found, np.uint64)

    twice = gather(spark, build(hashes_of, source.select("__text"), bits, ROWS), bits, ROWS)

    def suspects(batches):
        for batch in batches:
            ids, keys = [], []
            for i, t in enumerate(batch.column("__text").to_pylist()):
                mine = keys_of(t)
                for j in np.flatnonzero(suspected(twice.value, np.array([xxhash.xxh3_64_intdigest(k) for k in mine], np.uint64))):
                    ids.append(i)
                    keys.append(mine[j])
            yield {"doc": batch.column("__id").take(np.array(ids, np.int64)), "key": keys}

    id_type = docs.schema[id_col].dataType.simpleString()
    places = map_batches(source, suspects, f"doc {id_type}, key binary").distinct()
    # counted per key after the distinct, with map-side sums, so that a hot key is a few rows per task
    counts = places.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc").alias("__first")).filter(F.col("n_docs") >= min_docs)
    return places.join(counts, "key").select("doc", "key", "n_docs", F.coalesce(F.col("doc") == F.col("__first"), F.col("__first").isNull()).alias("first"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, max_filter_bits: int = 1 << 30) -> DataFrame:
    """``docs`` with ``text_col`` rewritten and ``n_lines`` and ``n_dropped`` added (or replaced).

    ``keep_first``: the first line with the key stays in the document of smallest id.
    """
    docs = docs.drop("n_lines", "n_dropped")
    found = repeated_lines(docs, id_col, text_col, min_docs, min_chars, max_filter_bits)
    per_doc = found.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("key", "first")).alias("__keys"))
    joined = docs.join(per_doc, docs[id_col].eqNullSafe(per_doc["__doc"]), "left").drop("__doc")
    others = [c for c in docs.columns if c != text_col]

    def rewrite(batches):
        for batch in batches:
            n, dropped, kept = [], [], []
            for text, keys in zip(batch.column("__text").to_pylist(), batch.column("__keys").to_pylist(), strict=True):
                lines = text.split(b"\n")
                n.append(len(lines))
                if keys:
                    first = {k["key"]: k["first"] for k in keys}
                    rest, seen = [], set()
                    for line, key in zip(lines, line_keys(text), strict=True):
                        if key not in first or (keep_first and first[key] and key not in seen):
                            rest.append(line)
                        seen.add(key)
                    lines = rest
                dropped.append(n[-1] - len(lines))
                kept.append(b"\n".join(lines))
            yield {c: batch.column(c) for c in others} | {"__n": n, "__dropped": dropped, "__kept": kept}

    source = joined.select(*others, as_bytes(F.col(text_col)).alias("__text"), "__keys")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema.fields)
    out = map_batches(source, rewrite, f"{schema}, __n long, __dropped long, __kept binary")
    return out.select(*(F.col("__kept").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), F.col("__n").alias("n_lines"), F.col("__dropped").alias("n_dropped"))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = """
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i)
), keyed AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), hot AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hot.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot USING (k) GROUP BY doc_id
"""
