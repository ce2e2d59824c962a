"""Readers for feeds, batches and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that a feed's CSV writers mean as null.
NA_TOKENS = ["", "#N/A", "#NA", "N/A", "NA", "NULL", "NaN", "None", "nan", "null", "n/a", "-nan", "-NaN", "<NA>"]

URL_BATCH = T.StructType([T.StructField("url", T.StringType()), T.StructField("label", T.StringType()), T.StructField("source", T.StringType())])
EVENT_LOG = T.StructType([T.StructField(n, t) for n, t in (("source", T.StringType()), ("operation", T.StringType()), ("identifier", T.StringType()), ("start_ts", T.DoubleType()), ("duration_s", T.DoubleType()), ("status", T.StringType()))])


def nulls(df: DataFrame) -> DataFrame:
    """NA tokens in text columns become null."""
    return df.withColumns({f.name: F.when(~F.col(f.name).isin(NA_TOKENS), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})


def csv(spark: SparkSession, path: str | list[str], schema: T.StructType, skip_bad_lines: bool = False, **options: str) -> DataFrame:
    """CSV with a header and a fixed schema; never inferred, so one pass reads it. Bad lines are null rows or dropped."""
    reader = spark.read.schema(schema).option("header", "true").option("mode", "DROPMALFORMED" if skip_bad_lines else "PERMISSIVE").option("escape", '"').options(**options)
    return nulls(reader.csv(path))


def optional_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An empty table where the path doesn't exist."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return csv(spark, path, schema) if exists else spark.createDataFrame([], schema)


def batches(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.csv", modified_after: str | None = None) -> DataFrame:
    """All batch files that match, with ``file_name``; ``modified_after`` as a timestamp text limits them."""
    options = {"pathGlobFilter": pattern} | ({"modifiedAfter": modified_after} if modified_after else {})
    return csv(spark, path, schema, **options).withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1))


def latest(df: DataFrame) -> DataFrame:
    """Rows of the file whose name is the largest."""
    newest = df.agg(F.max("file_name").alias("__newest"))
    return df.join(F.broadcast(newest), F.col("file_name") == F.col("__newest")).drop("__newest")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines of a text feed without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter(F.col("line") != "")


#: Feed kinds: index of the URL field (None: whole line), prefix for entries without a scheme, label.
FEEDS: dict[str, tuple[int | None, str, str]] = {
    "indexed_1": (1, "", "phishing"),
    "indexed_2": (2, "", "phishing"),
    "plain": (None, "", "phishing"),
    "domains": (None, "https://", "legitimate"),
    "hosts": (None, "http://", "phishing"),
}


def parse_feed(raw: DataFrame, kind: str, source: str) -> DataFrame:
    """(url, label, source) from the column ``line``: comment lines and entries that are no http URL go."""
    field, prefix, label = FEEDS[kind]
    line = F.col("line")
    value: Column = line if field is None else F.get(F.split(line, ","), F.lit(field))
    value = F.trim(F.replace(value, F.lit('"'), F.lit("")))
    if prefix:
        value = F.when(value.startswith("http"), value).otherwise(F.concat(F.lit(prefix), value))
    return raw.filter(~line.startswith("#")).select(value.alias("url"), F.lit(label).alias("label"), F.lit(source).alias("source")).filter(F.col("url").startswith("http"))


PULSES = "results array<struct<name string, indicators array<struct<type string, indicator string>>>>"


def parse_pulses(raw: DataFrame, column: str = "value") -> DataFrame:
    """URL indicators of nested JSON pulses."""
    pulse = raw.select(F.explode(F.from_json(column, PULSES)["results"]).alias("p"))
    return pulse.select(F.explode("p.indicators").alias("i")).filter("i.type = 'URL'").select(F.col("i.indicator").alias("url"), F.lit("phishing").alias("label"))


def ranked_domains(spark: SparkSession, path: str) -> DataFrame:
    """Headerless rank,domain files."""
    return spark.read.schema("rank INT, domain STRING").csv(path).select("rank", F.concat(F.lit("https://"), "domain").alias("url"))


def jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A relational table read in parallel ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions), **options).load()


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)
