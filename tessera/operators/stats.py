"""Counts, diversity, classification metrics and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranks import percentiles, ranged, running_sum


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def group_entropy(df: DataFrame, column: str) -> DataFrame:
    """(n_values, n, entropy): Shannon entropy of the value counts, base 2."""
    counts = value_counts(df, column)
    # -sum p log p = log N - sum n log n / N, so one pass over the counts is enough
    n = F.sum("n")
    return counts.agg(F.count(F.lit(1)).alias("n_values"), n.alias("n"), (F.log2(n) - F.sum(F.col("n") * F.log2("n")) / n).alias("entropy"))


def gini(df: DataFrame, column: str) -> DataFrame:
    """Gini coefficient of the value counts. Equal counts are grouped first, so only distinct counts are ranked."""
    sizes = value_counts(df, column).groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    ranked = running_sum(sizes, "n", "k", "upto").withColumn("before", F.col("upto") - F.col("k"))
    # ranks before+1 .. before+k share the count n
    rank_sum = F.col("k") * F.col("before") + F.col("k") * (F.col("k") + 1) / 2
    total, m = F.sum(F.col("n") * F.col("k")), F.sum("k")
    return ranked.agg((2 * F.sum(rank_sum * F.col("n")) / (m * total) - (m + 1) / m).alias("gini"))


def confusion(actual: Column, predicted: Column) -> dict[str, Column]:
    both = lambda a, p: F.count_if((actual == a) & (predicted == p))
    return {"tp": both(1, 1), "fp": both(0, 1), "fn": both(1, 0), "tn": both(0, 0)}


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Confusion counts and accuracy, precision, recall, F1 and false-positive rate; an empty denominator gives 0."""
    counted = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupBy(*(by or [])).agg(*(v.alias(k) for k, v in confusion(F.col(actual), F.col(predicted)).items()))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    scored = counted.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn)})
    return scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def roc_auc(df: DataFrame, actual: str, score: str) -> DataFrame:
    """Exact area by average ranks. Rows are counted per score first, and scores are ranked in ranges."""
    per = df.filter(F.col(actual).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("__s")).agg(F.count_if(F.col(actual) == 1).alias("__p"), F.count_if(F.col(actual) == 0).alias("__n"))
    below = F.col("__upto") - F.col("__n")
    wins = running_sum(per, "__s", "__n", "__upto").select("__p", "__n", (F.col("__p") * (below + F.col("__n") / 2)).alias("__w"))
    return wins.agg(ratio(F.sum("__w"), F.sum("__p") * F.sum("__n")).alias("auc"))


def roc_auc_by(df: DataFrame, actual: str, score: str, by: str) -> DataFrame:
    """(by, auc): the area within each group, ranked per group over the distinct scores."""
    per = df.filter(F.col(actual).isNotNull() & F.col(score).isNotNull()).groupBy(by, F.col(score).alias("__s")).agg(F.count_if(F.col(actual) == 1).alias("__p"), F.count_if(F.col(actual) == 0).alias("__n"))
    staged = ranged(per, [by, "__s"])
    sizes = staged.groupBy(F.col(by).alias("__g"), F.col("__range").alias("__r")).agg(F.sum("__n").alias("__k"))
    ahead = sizes.select("__g", "__r", (F.sum("__k").over(Window.partitionBy("__g").orderBy("__r")) - F.col("__k")).alias("__ahead"))  # a row for each range of a group
    inside = staged.withColumn("__in", F.sum("__n").over(Window.partitionBy(by, "__range").orderBy("__s")) - F.col("__n"))
    joined = inside.join(ahead, inside[by].eqNullSafe(ahead["__g"]) & (inside["__range"] == ahead["__r"]))
    return joined.groupBy(by).agg(ratio(F.sum(F.col("__p") * (F.col("__in") + F.col("__ahead") + F.col("__n") / 2)), F.sum("__p") * F.sum("__n")).alias("auc"))


def log_loss(df: DataFrame, actual: str, p: str) -> DataFrame:
    c = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    y = F.col(actual)
    return df.agg(F.avg(-(y * F.ln(c) + (1 - y) * F.ln(1 - c))).alias("log_loss"), F.avg(F.pow(F.col(p) - y, 2)).alias("brier"))


def null_ratios(df: DataFrame) -> DataFrame:
    """(column_name, null_ratio), one pass over the table."""
    one = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns))
    return one.unpivot([], df.columns, "column_name", "null_ratio")


def latency(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean and exact, linearly interpolated percentiles."""
    found = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return with_percentiles(found, df, by, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}).select(*by, "n", "mean", "p50", "p95", "p99")


def with_percentiles(groups: DataFrame, df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``groups``, a row per group of ``df``, with percentiles; null where a group has no value."""
    found = percentiles(df, by, value, shares).withColumnsRenamed({c: f"__{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & groups[c].eqNullSafe(F.col(f"__{c}"))
    return groups.join(found, same, "left").drop(*(f"__{c}" for c in by))


def rate_per_hour(df: DataFrame, ts: str, by: list[str]) -> DataFrame:
    seconds = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1e6
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ratio(F.count(F.lit(1)).cast("double"), seconds / 3600.0).alias("per_hour"))


def quality_issues(df: DataFrame, rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    """(column_name, rule, severity, n) for the rules that rows break; all rules are counted in one pass."""
    one = df.agg(*(F.count_if(condition).alias(f"r{i}") for i, (*_, condition) in enumerate(rules)))
    listed = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.col(f"r{i}").alias("n")) for i, (c, r, s, _) in enumerate(rules)))
    return one.select(F.inline(listed)).filter("n > 0")


def passes(issues: DataFrame) -> DataFrame:
    """One row: whether no rule of severity error is broken."""
    return issues.agg((F.count_if(F.col("severity") == "error") == 0).alias("passed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_issues"))


def url_rules() -> list[tuple[str, str, str, Column]]:
    """Rules of the lexical family."""
    c = F.col
    lengths = [r for n in ("url_length", "hostname_length", "path_length") for r in ((n, "negative", "error", c(n) < 0), (n, "over 10000", "warning", c(n) > 10000))]
    counts = [r for n in ("num_dots", "num_digits", "num_special_chars", "num_directories") for r in ((n, "negative", "error", c(n) < 0), (n, "over 1000", "warning", c(n) > 1000))]
    entropies = [r for n in ("url_entropy", "hostname_entropy") for r in ((n, "negative", "error", c(n) < 0), (n, "over 10", "warning", c(n) > 10))]
    flags = [(n, "not 0 or 1", "error", ~c(n).isin(0, 1)) for n in ("is_ip_address", "is_shortened", "is_risky_port")]
    ports = [("port", "negative", "warning", c("port") < 0), ("port", "over 65535", "warning", c("port") > 65535)]
    return lengths + counts + entropies + flags + ports


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of several tables, as one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def agreement(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of feature families, and whether all are equal."""
    sizes = table_sizes(tables)
    spread = sizes.agg((F.min("n") == F.max("n")).alias("agree"))
    return sizes.crossJoin(F.broadcast(spread))  # one row


def growth(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(name, previous, current, added) of row counts per table; a table that is new had none."""
    joined = current.select("name", F.col("n").alias("current")).join(previous.select("name", F.col("n").alias("previous")), "name", "left")
    return joined.select("name", F.coalesce("previous", F.lit(0)).cast("long").alias("previous"), "current", (F.col("current") - F.coalesce("previous", F.lit(0))).cast("long").alias("added"))


def queue_state(df: DataFrame, ts: str, by: list[str]) -> DataFrame:
    """Waiting rows, the earliest and the latest, and rows an hour between the two."""
    hours = (F.max(ts).cast("timestamp").cast("double") - F.min(ts).cast("timestamp").cast("double")) / 3600
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("earliest"), F.max(ts).alias("latest"), F.when(hours > 0, F.count(F.lit(1)) / hours).alias("per_hour"))


def speed_up(df: DataFrame, value: str, group: str, base: str) -> DataFrame:
    """(group, p95, speed_up): how many times the 95th percentile of ``base`` is that of each group."""
    p95 = with_percentiles(df.select(group).distinct(), df, [group], value, {"p95": 0.95})
    own = p95.filter(F.col(group) == base).select(F.col("p95").alias("__base"))
    return p95.crossJoin(F.broadcast(own)).select(group, "p95", F.try_divide("__base", "p95").alias("speed_up"))  # one row
