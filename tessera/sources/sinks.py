"""Writers for feature tables, reports and masters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sanitized(df: DataFrame, limit: int = 500) -> DataFrame:
    """Text columns without line breaks, cut to ``limit`` characters: what the line-based interchange files hold."""
    return df.withColumns({f.name: F.substring(F.regexp_replace(f.name, r"[\r\n]", " "), 1, limit) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("header", "true").option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, append: bool = False, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append" if append else "overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as JSON lines in one file; for reports of a few rows only."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_version(df: DataFrame, path: str, version: str) -> str:
    """A master under a path of its own; readers switch by path, older versions stay as backups."""
    out = f"{path}/version={version}"
    df.write.mode("errorifexists").parquet(out)
    return out
