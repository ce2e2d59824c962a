"""Folders for intermediate tables, one for each application, and their removal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where it is unset, a temporary folder becomes the checkpoint folder, on a local master only: executors on other
    machines would write where nobody reads.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def application(spark: SparkSession) -> str:
    return f"{base(spark)}/tessera/{spark.sparkContext.applicationId}"


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder."""
    return f"{application(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there."""
    path = shared(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str | None = None) -> None:
    """Removes one intermediate folder, or all of this application; what reads them must be done."""
    folder = path or application(spark)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
