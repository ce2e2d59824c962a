"""Keyed merges, deduplication, sampling and top-k as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranks import numbered


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. One aggregation with map-side maxima, no sort."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("__row"))
    return packed.select(*((F.col(c) if c in keys else F.col(f"__row.{c}").alias(c)) for c in df.columns))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("__row"))
    return packed.select(*((F.col(c) if c in keys else F.col(f"__row.{c}").alias(c)) for c in df.columns))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Union by name, missing columns null; a key's last row wins, rows of ``new`` after those of ``existing``."""
    both = existing.withColumn("__gen", F.lit(0)).unionByName(new.withColumn("__gen", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, ["__gen", *order]).drop("__gen")


def update_present(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Update or insert where only values count: each column of a key is its last value that is not null, rows of ``new`` after those of ``existing``."""
    both = existing.withColumn("__gen", F.lit(0)).unionByName(new.withColumn("__gen", F.lit(1)), allowMissingColumns=True)
    place = F.struct("__gen", *order)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in both.columns if c not in (*keys, "__gen")]
    return both.groupBy(*keys).agg(*last).select(*existing.columns, *(c for c in new.columns if c not in existing.columns))


def insert_only(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing`` are added, one for each key."""
    fresh = new.join(existing.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
    return existing.unionByName(fresh, allowMissingColumns=True)


def merge_counts(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(existing, incoming, added, duplicates) in one row, in one pass over the keys."""
    tagged = existing.select(*keys, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(*keys, F.lit(0).alias("o"), F.lit(1).alias("n")))
    per_key = tagged.groupBy(*keys).agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    added = F.coalesce(F.sum(((F.col("o") == 0) & (F.col("n") > 0)).cast("long")), F.lit(0))
    incoming = F.coalesce(F.sum("n"), F.lit(0))
    return per_key.agg(F.coalesce(F.sum("o"), F.lit(0)).alias("existing"), incoming.alias("incoming"), added.alias("added"), (incoming - added).alias("duplicates"))


def update_from(base: DataFrame, changes: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """``base`` with ``column`` from the last change of its key where it differs, and ``status`` (updated, same, untouched)."""
    last = changes.groupBy(F.col(key).alias("__k")).agg(F.max_by(column, order).alias("__new"))
    joined = base.join(last, base[key] == last["__k"], "left")
    status = F.when(F.col("__k").isNull(), "untouched").when(F.col("__new").eqNullSafe(F.col(column)), "same").otherwise("updated")
    return joined.withColumn("status", status).withColumn(column, F.when(F.col("status") == "updated", F.col("__new")).otherwise(F.col(column))).drop("__k", "__new")


def left_with_suffix(left: DataFrame, right: DataFrame, key: str, suffix: str = "_feature") -> DataFrame:
    """Left join; clashing columns of the right side get the suffix."""
    return left.join(right.withColumnsRenamed({c: f"{c}{suffix}" for c in right.columns if c in left.columns and c != key}), key, "left")


def align(df: DataFrame, order: list[str], default: float = 0.0) -> DataFrame:
    """Columns in a model's order; missing ones are the default."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(default).alias(c)) for c in order))


def by_hash(column: str, seed: int = 42) -> Column:
    """A fixed pseudo-random order."""
    return F.xxhash64(F.lit(seed), F.col(column))


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(by_hash(key, seed), key).limit(n)


def cap_per_group(df: DataFrame, group: str, cap: int, order: str) -> DataFrame:
    """The first ``cap`` rows of each group by a numeric column."""
    return numbered(df, group, order, "__cap").filter(F.col("__cap") <= cap).drop("__cap")


def quota(df: DataFrame, stratum: str, target: int, order: str) -> DataFrame:
    """``min(n, floor(target * share))`` rows of each stratum, shares from the table itself."""
    n = df.count()
    sizes = df.groupBy(F.col(stratum).alias("__s")).agg(F.count(F.lit(1)).alias("__size"))
    limits = sizes.select("__s", F.floor(F.lit(float(target)) * F.col("__size") / F.lit(max(n, 1))).alias("__q"))
    ranked = numbered(df, stratum, order, "__cap")
    return ranked.join(limits, ranked[stratum].eqNullSafe(limits["__s"])).filter(F.col("__cap") <= F.col("__q")).select(*df.columns)


def folds(df: DataFrame, label: str, order: str, k: int = 5, seed: int | None = None) -> DataFrame:
    """Stratified fold numbers from 0, dealt in the order of a column, or shuffled by a hash of it where there is a seed."""
    if seed is not None:
        return folds(df.withColumn("__shuffled", by_hash(order, seed)), label, "__shuffled", k).drop("__shuffled")
    return numbered(df, label, order, "fold").withColumn("fold", ((F.col("fold") - 1) % k).cast("int"))


def top_per_group(df: DataFrame, group: str, k: int, order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def by_position(left: DataFrame, right: DataFrame, order_left: str, order_right: str) -> DataFrame:
    """Rows paired by their rank in each table; the ranks are made in ranges, not in one task."""
    return numbered(left, None, order_left, "__pos").join(numbered(right, None, order_right, "__pos"), "__pos").drop("__pos")


def class_balance(df: DataFrame, stratum: str, order: str) -> DataFrame:
    """As many rows of each stratum as the smallest has."""
    least = df.groupBy(stratum).count().agg(F.min("count").alias("__least"))
    ranked = numbered(df, stratum, order, "__cap").join(F.broadcast(least), F.col("__cap") <= F.col("__least"))  # one row
    return ranked.select(*df.columns)
