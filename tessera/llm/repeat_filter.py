"""Once/twice bit filters over 64-bit hashes, built per task and merged without false negatives.

A filter has ``rows`` rows of ``bits`` bits. A hash sets one bit in each row of the *once*
filter; where a bit is hit by two hash occurrences it is set in *twice*. Two partial filters merge as
``twice = twice_a | twice_b | (once_a & once_b)`` and ``once = once_a | once_b``, so a hash
that occurs twice anywhere has all its bits in the merged *twice* filter. Other hashes may too;
users confirm suspects exactly. The merged filter's size is bounded by the caller (``bits`` x ``rows``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, pack_bits, sliced, unpack_bits

BLOCKS = 64
PARTIALS = "block int, part int, once binary, twice binary"


def positions(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Bit of each hash in a row: disjoint or remixed parts of the hash serve as row hashes."""
    mixed = hashes if row == 0 else (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * row)
    return (mixed >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


class Partial:
    """The filter of one task."""

    def __init__(self, bits: int, rows: int):
        self.bits, self.rows = bits, rows
        self.once = np.zeros((rows, bits // 8), np.uint8)
        self.twice = np.zeros((rows, bits // 8), np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """Adds one batch; equal hashes within it are seen twice."""
        for row in range(self.rows):
            at = np.sort(positions(hashes, row, self.bits))
            first = np.ones(len(at), bool)
            first[1:] = at[1:] != at[:-1]
            set_bits(self.twice[row], at[~first])
            at = at[first]
            set_bits(self.twice[row], at[test_bits(self.once[row], at)])
            set_bits(self.once[row], at)

    def blocks(self, part: int):
        """Rows of ``PARTIALS``, one for each non-empty block."""
        once, twice = (x.reshape(self.rows * BLOCKS, -1) for x in (self.once, self.twice))
        full = np.flatnonzero(once.any(axis=1))
        for start in range(0, len(full), 8):
            some = full[start : start + 8]
            yield {"block": some, "part": [part] * len(some), "once": [pack_bits(once[i]) for i in some], "twice": [pack_bits(twice[i]) for i in some]}


def set_bits(bitmap: np.ndarray, at: np.ndarray) -> None:
    """``at`` is sorted, repeats allowed."""
    if len(at):
        byte, value = at >> 3, (1 << (at & 7)).astype(np.uint8)
        starts = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        bitmap[byte[starts]] |= np.bitwise_or.reduceat(value, starts)


def test_bits(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def merged(partials: DataFrame) -> DataFrame:
    """One row per block. Two levels, so that no task holds the partial filters of all tasks at once."""

    def merge(batches):
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, once, twice in zip(*(batch.column(n).to_pylist() for n in ("block", "once", "twice")), strict=True):
                a, b = unpack_bits(once), unpack_bits(twice)
                if block in found:
                    mine = found[block]
                    mine[1] |= b | (mine[0] & a)
                    mine[0] |= a
                else:
                    found[block] = [a.copy(), b.copy()]
        for block, (a, b) in found.items():
            yield {"block": [block], "part": [0], "once": [pack_bits(a)], "twice": [pack_bits(b)]}

    # rows of one block meet in one task; a task keeps the running merge of its blocks only
    first = map_batches(partials.repartition(F.col("block"), F.col("part") % 16), merge, PARTIALS)
    return map_batches(first.repartition("block"), merge, PARTIALS)


def build(hashes_of, df: DataFrame, bits: int, rows: int) -> DataFrame:
    """Merged filter of ``hashes_of(batch) -> uint64 array`` over all batches of ``df``."""

    def partial(batches):
        from pyspark import TaskContext

        mine = Partial(bits, rows)
        for batch in sliced(batches):
            if len(found := hashes_of(batch)):
                mine.add(found)
        yield from mine.blocks(TaskContext.get().partitionId())

    return merged(map_batches(df, partial, PARTIALS))


def gather(spark, filter_blocks: DataFrame, bits: int, rows: int):
    """Broadcast of the *twice* filter: ``bits * rows / 8`` bytes at most, whatever the input."""
    size = bits // 8 // BLOCKS
    twice = np.zeros((rows * BLOCKS, size), np.uint8)
    for r in filter_blocks.select("block", "twice").toLocalIterator():
        twice[r["block"]] = unpack_bits(bytes(r["twice"]), np.uint8)
    return spark.sparkContext.broadcast(twice.reshape(rows, -1))


def suspected(twice: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Mask of hashes that may occur twice; a hash that does always is."""
    bits = twice.shape[1] * 8
    found = test_bits(twice[0], positions(hashes, 0, bits))
    for row in range(1, len(twice)):
        at = np.flatnonzero(found)
        found[at] = test_bits(twice[row], positions(hashes[at], row, bits))
    return found
