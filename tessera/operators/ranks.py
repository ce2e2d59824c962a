"""Row numbers, running sums and percentiles without one task per group.

Rows are dealt to ranges of their group and order by Spark's range partitioning and written once, so that the ranges hold
still. They are numbered (or summed) within each range, and what the ranges before hold is added: a group with a third of all rows is
spread over many tasks, and so are rows with equal order values. The results are those of one ordered window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.workdir import materialise

#: Of percentiles: the sketches' accuracy, rows of a group that are put in order whole, and groups (about 200 bytes each) whose bounds are broadcast.
ACCURACY, SMALL, MAX_GROUPS = 100_000, 200_000, 100_000


def ranged(df: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``__range``, whose numbers rise with ``keys``, and ``__salt``, which parts rows that are equal in them."""
    parts = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__salt", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, "__salt")
    return materialise(dealt.withColumn("__range", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, group: str | None, order: str, out: str, ranges: int | None = None, then: str | None = None) -> DataFrame:
    """``row_number`` over ``group`` (None: all rows) by a column, nulls first; ``then`` settles ties."""
    staged, group_ = df, group or "__all"
    if group is None:
        staged = staged.withColumn(group_, F.lit(0))
    by = [order, *([then] if then else [])]
    staged = ranged(staged, [group_, *by], ranges)
    sizes = staged.groupBy(F.col(group_).alias("__g"), F.col("__range").alias("__r")).agg(F.count(F.lit(1)).alias("__n"))
    # a row for each range of a group
    ahead = sizes.select("__g", "__r", (F.sum("__n").over(Window.partitionBy("__g").orderBy("__r")) - F.col("__n")).alias("__ahead"))
    ranked = staged.withColumn("__rn", F.row_number().over(Window.partitionBy(group_, "__range").orderBy(*by, "__salt")))
    joined = ranked.join(ahead, ranked[group_].eqNullSafe(ahead["__g"]) & (ranked["__range"] == ahead["__r"]))
    return joined.select(*df.columns, (F.col("__rn") + F.col("__ahead")).alias(out))


def running_sum(df: DataFrame, order: str, value: str, out: str, ranges: int | None = None) -> DataFrame:
    """Sum of ``value`` over all rows up to and with this one's order value; order values are distinct."""
    return running_sums(df, order, {out: value}, ranges)


def running_sums(df: DataFrame, order: str, sums: dict[str, str], ranges: int | None = None) -> DataFrame:
    """``df`` with a running sum for each name in ``sums``, of the column it stands for, added or replaced; order values are distinct."""
    staged = ranged(df, [order], ranges)
    sizes = staged.groupBy(F.col("__range").alias("__r")).agg(*(F.sum(v).alias(f"__n{i}") for i, v in enumerate(sums.values())))
    before = Window.orderBy("__r")
    ahead = sizes.select("__r", *((F.sum(f"__n{i}").over(before) - F.col(f"__n{i}")).alias(f"__ahead{i}") for i in range(len(sums))))  # a row per range
    inside = Window.partitionBy("__range").orderBy(order)
    joined = staged.withColumns({f"__in{i}": F.sum(v).over(inside) for i, v in enumerate(sums.values())}).join(F.broadcast(ahead), F.col("__range") == F.col("__r"))
    return joined.select(*(c for c in df.columns if c not in sums), *((F.col(f"__in{i}") + F.col(f"__ahead{i}")).alias(out) for i, out in enumerate(sums)))


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by..., and for each name in ``shares`` the exact, linearly interpolated percentile) of the values that are not null.

    A mergeable sketch of each group gives two values around each percentile, nearer than a few in ``ACCURACY`` of the group's rows. A second pass counts the rows below the lower
    one and the rows of each value between the two, and only these are put in order. Groups of ``SMALL`` rows at most are put in order whole.
    """
    own = df.filter(F.col(value).isNotNull()).select(F.struct(*(F.col(c) for c in by)).alias("__key") if by else F.lit(0).alias("__key"), F.col(value).cast("double").alias("__v"))
    margin = 3 / ACCURACY
    around = F.array(*(F.lit(min(1.0, max(0.0, share + side * margin))) for share in shares.values() for side in (-1, 1)))
    sketch = own.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", around, F.lit(ACCURACY)).alias("__q"))
    large = F.col("__n") > SMALL
    # a bound that is null holds nothing off
    edge = lambda i, side, open_: F.when(large & F.lit(not open_), F.col("__q")[2 * i + side])
    bounds = F.array(*(F.struct(F.lit(i).alias("i"), edge(i, 0, share <= margin).alias("lo"), edge(i, 1, share >= 1 - margin).alias("hi")) for i, share in enumerate(shares.values())))
    groups = materialise(sketch.select(F.col("__key").alias("__k"), "__n", bounds.alias("__bounds")), "percentile-bounds")
    if groups.count() <= MAX_GROUPS:
        groups = F.broadcast(groups)
    v = F.col("__v")
    near = F.transform(F.filter("__bounds", lambda b: b["hi"].isNull() | (v <= b["hi"])), lambda b: F.struct(b["i"].alias("i"), F.when(b["lo"].isNull() | (v >= b["lo"]), v).alias("v")))
    counts = own.join(groups, F.col("__key").eqNullSafe(F.col("__k"))).select("__key", "__n", F.inline(near)).groupBy("__key", "__n", "i", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("__key", "i").orderBy(F.asc_nulls_first("v")))
    place = F.get(F.array(*map(F.lit, map(float, shares.values()))), F.col("i")) * (F.col("__n") - 1)
    first = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    picked = counts.withColumn("upto", upto).withColumn("at", F.floor(place)).withColumn("part", place - F.floor(place)).groupBy("__key", "i", "part").agg(first(F.col("at") + 1).alias("a"), first(F.least(F.col("at") + 2, "__n")).alias("b"))
    exact = F.when(F.col("part") > 0, F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part")).otherwise(F.col("a"))
    found = picked.groupBy("__key").agg(*(F.max(F.when(F.col("i") == i, exact)).alias(name) for i, name in enumerate(shares)))
    return found.select(*(F.col(f"__key.{c}").alias(c) for c in by), *shares)
