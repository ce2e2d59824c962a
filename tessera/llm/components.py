"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, materialise

MAX_ROUNDS = 60
#: Links that one task thins out at a time.
LOCAL = 250_000


def stars(batches, local: int = LOCAL) -> Iterator[dict]:
    """Of the links of one task, a link from each node to the smallest of those it is joined with (or itself).

    A task that gets more than ``local`` links gives out what it has whenever it holds their number of nodes, so its memory is bounded.
    """
    parent: dict = {}

    def root(x):
        while (up := parent[x]) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
            if len(parent) > 2 * local:
                yield {"a": list(parent), "b": [root(x) for x in parent]}
                parent.clear()
    yield {"a": list(parent), "b": [root(x) for x in parent]}


def connected_components(links: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); nodes of one component share a root.

    Each round thins the links first: tasks of ``local`` links replace theirs by one link from each node. If one task had them all, that is the result. Else every
    node hooks onto the neighbour (or itself) that comes first in an order by hash that changes
    from round to round, and the links are rewritten between hooks. The links keep joining what they joined, and
    their number of ends falls by a constant factor a round, so chains and stars alike take a logarithmic number
    of rounds. All steps are joins and aggregations with map-side minima; nothing is gathered.
    """
    links = materialise(links.select("a", "b").filter("a <> b").distinct(), "links")
    kind, hooks = links.schema["a"].dataType.simpleString(), []
    for r in range(MAX_ROUNDS):
        n = links.count()
        parts = max(1, -(-n // local))
        dealt = links.coalesce(parts) if links.rdd.getNumPartitions() >= parts else links.repartition(parts)
        thin = materialise(map_batches(dealt, partial(stars, local=local), f"a {kind}, b {kind}"), "stars")
        if parts == 1:
            hooks.append(thin.select(F.col("a").alias("node"), F.col("b").alias("to")))
            break
        both = thin.filter("a <> b").distinct()
        both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(r), c).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        hook = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", rank("a"))["v"].alias("to"))
        hook = materialise(hook, "hooks")
        hooks.append(hook)
        ends = thin.filter("a <> b").join(hook.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(hook.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        links = materialise(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    roots = hooks[0].withColumnRenamed("to", "root")
    for hook in hooks[1:]:
        step = hook.select(F.col("node").alias("root"), "to")
        roots = roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return roots
