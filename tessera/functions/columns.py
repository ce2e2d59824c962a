"""Choosing columns by name and type, and fitting tables to one another's schema."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def by_name(df: DataFrame, pattern: str) -> list[str]:
    """Names that the pattern matches from the start, such as ``has_|num_``."""
    return [c for c in df.columns if re.match(pattern, c)]


def by_type(df: DataFrame, *kinds: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def without(df: DataFrame, names: list[str]) -> list[str]:
    return [c for c in df.columns if c not in names]


def same_columns(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same set of columns."""
    return set(a.columns) == set(b.columns)


def fit_schema(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Columns of ``schema`` first, with defaults for missing ones; columns that it lacks come last."""
    defaults = defaults or {}
    known = [(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(defaults.get(f.name)).cast(f.dataType)).alias(f.name) for f in schema.fields]
    return df.select(*known, *(c for c in df.columns if c not in schema.names))


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in by_type(df, T.FractionalType)})


def clipped(value: Column) -> Column:
    """Negative values as 0, for learners that take none."""
    return F.greatest(value, F.lit(0.0))


def squashed(df: DataFrame, column: str, out: str) -> DataFrame:
    """Decision scores as 0 to 1 by the table's range, from one row of bounds."""
    bounds = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    joined = df.crossJoin(F.broadcast(bounds))
    return joined.withColumn(out, (F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + F.lit(1e-12))).drop("__lo", "__hi")


def as_json(df: DataFrame, keys: list[str], out: str = "features") -> DataFrame:
    """Keys, and all other columns as one JSON text."""
    return df.select(*keys, F.to_json(F.struct(*without(df, keys))).alias(out))
