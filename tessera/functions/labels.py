"""Labels, imputation and encodings as column expressions and small aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ranks import numbered, percentiles

# Fixed values of the strict label map; the loose rule disagrees on "malicious" on purpose.
STRICT_LABELS = {"legitimate": 0, "legit": 0, "benign": 0, "0": 0, "phishing": 1, "phish": 1, "malicious": 1, "1": 1}
SENTINEL, MISSING = -999, "MISSING"


def strict_label(label: Column) -> Column:
    """0 or 1 by the map; null for anything else, which callers drop."""
    text = F.lower(F.trim(label.cast("string")))
    found = F.when(F.lit(False), F.lit(0))
    for k, v in STRICT_LABELS.items():
        found = found.when(text == k, v)
    return found


def loose_label(label: Column) -> Column:
    """1 for phishing or "1", else 0, also for null."""
    return F.coalesce(F.lower(F.trim(label.cast("string"))).isin("phishing", "1"), F.lit(False)).cast("int")


def bucket(source: Column) -> Column:
    return F.coalesce(source, F.lit("unknown"))


def list_size(text: Column) -> Column:
    """Number of items in a printed list such as ``['a', "b'c"]``; 0 for null and for what is no list."""
    inner = F.regexp_extract(F.trim(text), r"(?s)^\[(.*)\]$", 1)
    quoted = F.regexp_count(inner, F.lit(r"'[^']*'|\"[^\"]*\""))
    plain = F.when(F.trim(inner) == "", 0).otherwise(F.regexp_count(inner, F.lit(",")) + 1)
    return F.coalesce(F.when(inner.rlike("['\"]"), quoted).otherwise(plain), F.lit(0))


def list_columns_to_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces list-like text columns by counts; a column is list-like if its first value that is not null looks like a list."""
    first = df.agg(*(F.first(c, ignorenulls=True).alias(c) for c in columns)).first()
    return df.withColumns({c: list_size(F.col(c)) for c in columns if isinstance(first[c], str) and first[c].strip().startswith("[")})


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType | T.BooleanType)


def impute_sentinel(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """-999 for null numbers (and NaN), ``MISSING`` for null text; booleans become numbers."""
    out = {}
    for f in df.schema.fields:
        if f.name in skip:
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, T.FractionalType):
            out[f.name] = F.coalesce(F.nanvl(c, F.lit(None)), F.lit(SENTINEL).cast(f.dataType))
        elif isinstance(f.dataType, T.BooleanType):
            out[f.name] = F.coalesce(c.cast("int"), F.lit(SENTINEL))
        elif is_numeric(f.dataType):
            out[f.name] = F.coalesce(c, F.lit(SENTINEL).cast(f.dataType))
        elif isinstance(f.dataType, T.StringType):
            out[f.name] = F.coalesce(c, F.lit(MISSING))
    return df.withColumns(out)


def listed(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(name, value): all values of ``columns`` that are not null, one row each."""
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast(kind).alias("value")) for c in columns))
    return df.select(F.inline(pairs)).filter("value IS NOT NULL")


def impute_fitted(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """Medians and most frequent values (the smallest on ties) fill nulls; columns without any value stay null. One row of fitted values is joined."""
    fitted = df.sparkSession.range(1).drop("id")
    if numeric:
        medians = percentiles(listed(df, numeric, "double"), ["name"], "value", {"m": 0.5})
        fitted = fitted.crossJoin(medians.agg(*(F.max(F.when(F.col("name") == c, F.col("m"))).alias(f"__{c}") for c in numeric)))
    if text:
        counts = listed(df, text, "string").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
        modes = counts.groupBy("name").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("m"))
        fitted = fitted.crossJoin(modes.agg(*(F.max(F.when(F.col("name") == c, F.col("m"))).alias(f"__{c}") for c in text)))
    joined = df.crossJoin(F.broadcast(fitted))  # exactly one row
    return joined.select(*((F.coalesce(c, F.col(f"__{c}")).alias(c) if c in numeric + text else F.col(c)) for c in df.columns))


def first_seen_codes(df: DataFrame, column: str, order: str, out: str) -> DataFrame:
    """Codes by first appearance in ``order``, from 0; null gives -1. The codes are made from the distinct values, not from all rows."""
    firsts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.min(order).alias("__first"))
    codes = numbered(firsts, None, "__first", "__n", then="__v").select("__v", (F.col("__n") - 1).cast("int").alias(out))
    return df.join(codes, df[column] == codes["__v"], "left").drop("__v").withColumn(out, F.coalesce(out, F.lit(-1)))


def sorted_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """Codes by sorted value, from 0; null gives -1."""
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("__v")).distinct()
    codes = numbered(values, None, "__v", "__n").select("__v", (F.col("__n") - 1).cast("int").alias(out))
    return df.join(codes, df[column] == codes["__v"], "left").drop("__v").withColumn(out, F.coalesce(out, F.lit(-1)))
