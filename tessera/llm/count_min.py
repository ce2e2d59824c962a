"""Count-min sketches of 64-bit hashes: one per task, merged by addition.

A sketch has ``rows`` rows of ``cells`` small counters; a hash adds one in each row, and its estimate is the least of its
counters. Counters stop at ``TOP``, and so do their sums, so an estimate is never below the smaller of the true count and ``TOP``.
The merged sketch's size is bounded by the caller (``cells`` x ``rows`` bytes).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, pack_bits, unpack_bits
from tessera.llm.repeat_filter import BLOCKS, positions

TOP = 255
PARTS = "block int, part int, cells binary"


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of counters, at most ``TOP``."""
    total = a + b
    total[total < a] = TOP
    return total


class Sketch:
    """The counters of one task."""

    def __init__(self, cells: int, rows: int):
        self.cells, self.counts = cells, np.zeros((rows, cells), np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for row, counts in enumerate(self.counts):
            at = np.sort(positions(hashes, row, self.cells))
            begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
            n = np.minimum(np.diff(np.r_[begin, len(at)]), TOP).astype(np.uint8)
            counts[at[begin]] = added(counts[at[begin]], n)

    def merge(self, other: Sketch) -> None:
        self.counts = added(self.counts, other.counts)

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        return np.min([counts[positions(hashes, row, self.cells)] for row, counts in enumerate(self.counts)], axis=0)

    def blocks(self, part: int):
        """Rows of ``PARTS``, one for each non-empty block of counters."""
        blocks = self.counts.reshape(len(self.counts) * BLOCKS, -1)
        for i in np.flatnonzero(blocks.any(axis=1)):
            yield {"block": [i], "part": [part], "cells": [pack_bits(blocks[i])]}


def build(hashes_of, df: DataFrame, cells: int, rows: int) -> DataFrame:
    """Merged sketch of ``hashes_of(batch) -> uint64 array`` over all batches of ``df``, one row per block."""

    def partial(batches):
        from pyspark import TaskContext

        mine = Sketch(cells, rows)
        for batch in batches:
            if len(found := hashes_of(batch)):
                mine.add(found)
        yield from mine.blocks(TaskContext.get().partitionId())

    def merge(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                counts = unpack_bits(data, np.uint8)
                found[block] = added(found[block], counts) if block in found else counts
        for block, counts in found.items():
            yield {"block": [block], "part": [0], "cells": [pack_bits(counts)]}

    # two levels, so that no task holds the sketches of all tasks; a task keeps the running sums of its blocks only
    parts = map_batches(df, partial, PARTS)
    first = map_batches(parts.repartition(F.col("block"), F.col("part") % 16), merge, PARTS)
    return map_batches(first.repartition("block"), merge, PARTS)


def gather_repeated(spark, blocks: DataFrame, cells: int, rows: int):
    """Broadcast of one bit per counter, set where it is two or more: ``cells * rows / 8`` bytes, whatever the input."""

    def bits(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                yield {"block": [block], "bits": [pack_bits(np.packbits(unpack_bits(data, np.uint8) > 1, bitorder="little"))]}

    repeated = np.zeros((rows * BLOCKS, cells // BLOCKS // 8), np.uint8)
    for r in map_batches(blocks.select("block", "cells"), bits, "block int, bits binary").toLocalIterator():
        repeated[r["block"]] = unpack_bits(bytes(r["bits"]), np.uint8)
    return spark.sparkContext.broadcast(repeated.reshape(rows, -1))
