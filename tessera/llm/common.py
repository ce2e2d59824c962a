"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import workdir
from tessera.sources.workdir import materialise as materialise  # noqa: PLC0414

#: ``[\x20\x09-\x0D]``, what ``bytes.split()`` and ``bytes.strip()`` also treat as white space.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder below ``spark.checkpoint.dir``."""
    return workdir.shared(spark, name)


def as_bytes(column: Column) -> Column:
    """UTF-8 of a text column; null counts as empty."""
    return F.coalesce(column.cast("string").cast("binary"), F.lit(b""))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that yield dicts of columns, in the order of ``schema``."""
    arrow = None

    def run(batches):
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns.values(), (f.type for f in arrow), strict=True)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(schema)
    arrow = to_arrow_schema(parsed)
    return df.mapInArrow(run, parsed)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Parts of ``rows`` rows, so that what a task makes of them is not that of a whole batch at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pack_bits(bits: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(bits.tobytes())


def unpack_bits(data: bytes, dtype=np.uint64) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=dtype)


def power_of_two(n: float, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))))
