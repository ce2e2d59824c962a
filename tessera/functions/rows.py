"""Row filters over many columns, as single expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULTS = ["", "0", "0.0", "-999", "-999.0", "MISSING", "N/A"]


def present(fields: list[T.StructField]) -> Column:
    """Number of columns that are not null."""
    return sum((F.col(f.name).isNotNull().cast("int") for f in fields), F.lit(0))


def infinite(fields: list[T.StructField]) -> Column:
    found = F.lit(False)
    for f in fields:
        if isinstance(f.dataType, T.FractionalType):
            found = found | F.coalesce(F.abs(f.name) == F.lit(float("inf")), F.lit(False))
    return found


def validity(fields: list[T.StructField], least: int = 3) -> Column:
    """Struct (is_valid, reason): not all null, nothing infinite, at least ``least`` values."""
    n = present(fields)
    reason = F.when(n == 0, "all values are null").when(infinite(fields), "infinite value").when(n < least, f"fewer than {least} values")
    return F.struct(reason.isNull().alias("is_valid"), reason.alias("reason"))


def meaningful(fields: list[T.StructField]) -> Column:
    """Number of columns with a value that is no default."""
    return sum(((~F.coalesce(F.col(f.name).cast("string"), F.lit("")).isin(DEFAULTS)).cast("int") for f in fields), F.lit(0))


def rich_enough(fields: list[T.StructField], share: float) -> Column:
    return meaningful(fields) / F.lit(float(max(len(fields), 1))) >= share
