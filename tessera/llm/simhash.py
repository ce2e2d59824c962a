"""SimHash fingerprints, and near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments, each read as a word of the 23-bit Golay code. Where two words differ in one bit at most,
the codeword nearest to one is among the codewords nearest to the other or to one of its one-bit neighbours, which are six at most. Two
fingerprints that differ in three bits at most have their errors in one of two ways: one bit at most in every segment, or two or three in one segment, and then one of the others
is equal and the last differs in one bit at most. So each fingerprint gives a few keys that join its own codeword indices with nearby ones: one kind over all three segments (36 bits), and for each
ordered pair of segments one of the first's bits and the second's index (33 bits or more). Keys are joined, and a
pair is a link only if the join's condition finds ``max_bits`` or fewer differing bits. Equal fingerprints are
joined once for all; copies are never expanded into pairs. Documents reachable over links form a component.

Defined cases: null and empty texts, and texts of white space, have fingerprint zero and link like any other. Rows are
judged one by one, so repeated rows and equal ids each get a row. The component id is the smallest id
that is not null (null where all are). Very long texts are hashed whole. An empty table gives an empty
result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import golay
from tessera.llm.common import as_bytes, map_batches, materialise
from tessera.llm.components import connected_components

SEED = 42
#: 64 bits as segments of at most 23.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
CHUNK = 1 << 16


def fingerprint(text: bytes, n: int) -> int:
    """Bit b is set where more than half of the hashes of the ``n``-word shingles have it; no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(n, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros((8, 8), np.int64)
    for at in range(0, len(starts), CHUNK):
        ones += ones_of(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)], "<u8"))
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones.reshape(64) > len(starts)))


def ones_of(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, by byte and bit."""
    columns = hashes.view(np.uint8).reshape(-1, 8)
    return np.stack([np.bincount(columns[:, byte], minlength=256) @ BYTE_BITS for byte in range(8)])


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes that are at hand; none: zero."""
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones_of(hashes).reshape(64) > len(hashes)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, n) for t in batch.column("__text").to_pylist()], np.uint64)
            yield {"doc_id": batch.column("__id"), "fp": found.view(np.int64)}

    return map_batches(docs.select(F.col(id_col).alias("__id"), as_bytes(F.col(text_col)).alias("__text")), run, f"doc_id {id_type}, fp long")


def fuzzy_keys(prints: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For the left and the right side of the join: row numbers of ``prints`` and keys."""
    parts = [(prints >> np.uint64(start) & np.uint64((1 << width) - 1)).astype(np.int32) for start, width in SEGMENTS]
    home = [golay.index(p).astype(np.int64) for p in parts]
    near = [golay.nearby(p, width).astype(np.int64) for p, (_, width) in zip(parts, SEGMENTS, strict=True)]
    # one bit at most in each segment: two own indices and one nearby, or two nearby and one own
    row, at = np.nonzero(near[2] >= 0)
    left = [(row, home[0][row] << 24 | home[1][row] << 12 | near[2][row, at])]
    row, at, to = np.nonzero((near[0] >= 0)[:, :, None] & (near[1] >= 0)[:, None, :])
    right = [(row, near[0][row, at] << 24 | near[1][row, to] << 12 | home[2][row])]
    # more in one segment: of the other two, one is equal and one differs in one bit at most
    for k, (a, b) in enumerate(PAIRS, 1):
        same = k << 36 | parts[a].astype(np.int64) << 12
        left.append((np.arange(len(prints)), same | home[b]))
        row, at = np.nonzero(near[b] >= 0)
        right.append((row, same[row] | near[b][row, at]))
    return tuple(tuple(np.concatenate(x) for x in zip(*side, strict=True)) for side in (left, right))


def links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b) with a < b: all pairs of different fingerprints (column fp, distinct) that differ in ``max_bits`` (3 at most) bits or fewer."""
    if max_bits > 3:
        raise ValueError("the keys find pairs of three differing bits at most")

    def keys(side):
        def run(batches):
            for batch in batches:
                fp = batch.column("fp").to_numpy(zero_copy_only=False)
                for at in range(0, len(fp), CHUNK):
                    row, key = fuzzy_keys(fp[at : at + CHUNK].view(np.uint64))[side]
                    yield {"key": key, "fp": fp[at : at + CHUNK][row]}

        return map_batches(prints.select("fp"), run, "key long, fp long")

    left, right = keys(0).withColumnRenamed("fp", "a"), keys(1).withColumnRenamed("fp", "b")
    # each pair meets in both directions, so one of them is enough
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    # many keys come of one fingerprint, which Spark's estimate of the sizes doesn't know: neither side is to be broadcast
    return left.alias("l").hint("merge").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``."""
    own = materialise(fingerprints(docs, id_col, text_col, n), "fingerprints")
    prints = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(prints, max_bits)).withColumnRenamed("node", "fp")
    members = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = members.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = members.join(smallest, "root").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, max_bits: int = 3) -> DataFrame:
    """``docs`` with one document of each component: that of smallest id. Rows that repeat its id stay with it."""
    found = near_duplicates(docs, id_col, text_col, n, max_bits)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept"]), "left_semi")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
