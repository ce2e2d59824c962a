"""Nearest neighbours by inner product with vantage-point trees per shard.

Inner product becomes a metric by one more coordinate: with R the largest norm, x is taken as (x, sqrt(R^2 - |x|^2)) and a
query as (q, 0), and the squared distance is |q|^2 + R^2 - 2 q.x. Rows go to the nearest of some sampled pivots, and each pivot's cell
is cut into shards of a bounded number of rows. A shard holds a
tree over its distinct vectors; a node keeps the ranges of distances from its vantage point to both halves. A half is
searched only if the triangle inequality leaves room for something nearer than ``factor`` times the distance to the
worst of the nearest found so far. Cells are left out by the same rule: a block of queries searches one shard of its own cell
first, and what it finds there bounds its search of all others. A factor of one prunes only what cannot be nearer, so the search is exact; a smaller
one searches less. All rows are indexed. A query's finds from all shards are merged by a window per query.

Defined cases: rows with a null id, and vectors that are null, zero, hold null or non-finite components or have another
length than most, take no part, as queries and as candidates. Equal vectors share one place in a tree and come out by smaller id. A
repeated row is a candidate each time, but never for a query of its own id. Fewer than ``k`` candidates are
all returned. An empty table gives an empty result. Columns other than id and vector are ignored.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, materialise

LEAF = 128
#: Of the registered query: exact. Smaller factors search less; see the README for the recall measured.
FACTOR = 1.0
#: Cells that rows are dealt to; their pivots and ranges are what tasks receive.
MAX_CELLS = 1024
#: What rounding may add to a distance and to a product, as shares of the largest norm and of its square.
ROUNDING, PRODUCT_ROUNDING = 1e-6, 1e-12
#: Shards that one task searches, and blocks of queries that it searches them for, at most.
SHARDS, BLOCKS = 32, 64


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def build(ids: np.ndarray, vectors: np.ndarray, radius2: float) -> dict[str, np.ndarray]:
    """Tree over the distinct vectors of a shard, as flat arrays."""
    x, which = np.unique(vectors, axis=0, return_inverse=True)
    which = which.reshape(-1)
    order = np.lexsort((ids, which))
    ids, first = ids[order], np.searchsorted(which[order], np.arange(len(x) + 1))
    wide = x.astype(np.float64)
    norms = (wide * wide).sum(1)
    full = np.concatenate([wide, np.sqrt(np.maximum(radius2 - norms, 0))[:, None]], axis=1)
    places, nodes, todo = np.arange(len(x)), [], [(0, len(x), -1, 0)]
    while todo:
        begin, end, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = me
        mine = places[begin:end]
        node = [begin, end, -1, -1, -1, 0.0, 0.0, 0.0, 0.0, 0.0]
        nodes.append(node)
        if end - begin <= LEAF:
            continue
        centre = full[mine].mean(0)
        vantage = mine[np.argmax(((full[mine] - centre) ** 2).sum(1))]
        away = np.sqrt(((full[mine] - full[vantage]) ** 2).sum(1))
        ranked = np.argsort(away, kind="stable")
        half = (end - begin) // 2
        places[begin:end], away = mine[ranked], away[ranked]
        node[4:] = [vantage, (away[half - 1] + away[half]) / 2, away[0], away[half - 1], away[half], away[-1]]
        todo += [(begin, begin + half, me, 0), (begin + half, end, me, 1)]
    table = np.array(nodes, np.float64).reshape(-1, 10)
    return {"x": x, "ids": ids, "first": first, "places": places, "nodes": table}


def search(tree: dict[str, np.ndarray], queries: np.ndarray, own_ids: np.ndarray, radius2: float, k: int, factor: float, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, id, score) of the nearest found in one shard, ``k`` at most for each query, and how many vectors were compared with queries.

    ``limit``: distances beyond which nothing can be among a query's nearest.
    """
    visited, radius = 0, math.sqrt(radius2)
    if limit is None:
        limit = np.full(len(queries), np.inf)
    x, places, nodes = tree["x"].astype(np.float64), tree["places"], tree["nodes"]
    # an id stands for a vector: the smallest; of equal scores the smaller id is nearer, and one more than k is kept, as one may be the query's own
    smallest, width = tree["ids"][tree["first"][:-1]], k + 1
    best, at = np.full((len(queries), width), -np.inf), np.full((len(queries), width), -1)
    norms, loose = (queries * queries).sum(1), 2 * PRODUCT_ROUNDING * radius2

    def distance(rows, products):
        return np.sqrt(np.maximum(norms[rows] + radius2 - 2 * products, 0))

    def worst(rows):
        low = best[rows, -1]
        return np.minimum(np.where(np.isinf(low), np.inf, distance(rows, np.where(np.isinf(low), 0, low))), limit[rows])

    def exactly(q, u):
        """One term after the other, whatever the shard."""
        out = np.empty(len(q))
        for begin in range(0, len(q), 1 << 14):
            some = slice(begin, begin + (1 << 14))
            out[some] = np.cumsum(queries[q[some]] * x[u[some]], axis=1)[:, -1]
        return out

    def meet(rows, mine):
        """Keeps the nearest by score and smallest id; products of the matrix decide only what is compared exactly."""
        products = queries[rows] @ x[mine].T
        low = best[rows, -1]
        if len(mine) > width:
            low = np.maximum(low, np.partition(products, len(mine) - width, axis=1)[:, len(mine) - width])
        r, c = np.nonzero(products >= (low - loose)[:, None])
        if not len(r):
            return
        some = np.unique(r)
        old, slot = np.nonzero(at[rows[some]] >= 0)
        who = np.concatenate([some[old], r])
        vector = np.concatenate([at[rows[some]][old, slot], mine[c]])
        score = np.concatenate([best[rows[some]][old, slot], exactly(rows[r], mine[c])])
        order = np.lexsort((smallest[vector], -score, who))
        who, vector, score = who[order], vector[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        kept = rank < width
        best[rows[who[kept]], rank[kept]], at[rows[who[kept]], rank[kept]] = score[kept], vector[kept]

    def visit(n, rows):
        nonlocal visited
        begin, end, inner, outer, vantage = nodes[n, :5].astype(np.int64)
        if not len(rows):
            return
        if inner < 0:
            visited += len(rows) * (end - begin)
            meet(rows, places[begin:end])
            return
        border, lo_in, hi_in, lo_out, hi_out = nodes[n, 5:]
        away = distance(rows, queries[rows] @ x[vantage])
        near = away <= border

        def may(some, lo, hi):
            bound = np.maximum(np.maximum(away[some] - hi, lo - away[some]), 0)
            return rows[some][bound <= factor * worst(rows[some]) + ROUNDING * radius]

        visit(inner, rows[near])
        visit(outer, may(near, lo_out, hi_out))
        visit(outer, rows[~near])
        visit(inner, may(~near, lo_in, hi_in))

    visit(0, np.arange(len(queries)))
    q, slot = np.nonzero(at >= 0)
    u = at[q, slot]
    # each distinct vector stands for its smallest ids
    n = np.minimum(tree["first"][u + 1] - tree["first"][u], width)
    ids = tree["ids"][np.repeat(tree["first"][u] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    score, q = np.repeat(best[q, slot], n), np.repeat(q, n)
    other = ids != own_ids[q]
    q, ids, score = q[other], ids[other], score[other]
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], ids[rank < k], score[rank < k], visited


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def distances(queries: np.ndarray, points: np.ndarray, radius2: float) -> np.ndarray:
    """Of each query (q, 0) to each point (x, sqrt(R^2 - |x|^2))."""
    return np.sqrt(np.maximum((queries * queries).sum(1)[:, None] + radius2 - 2 * queries @ points.T, 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, block_rows: int = 2048, with_visits: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` where ``is_query`` holds, against all rows but the query's own id.

    ``with_visits``: instead, (visited), how many comparisons each search of a shard made.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("is_query")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    shape = own.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("r2")).orderBy(F.desc("n"), "d").first()
    d, n, radius2 = (shape["d"], shape["n"], float(shape["r2"])) if shape else (1, 0, 1.0)
    own = own.filter(F.size("v") == d)
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    dtype = np.float32 if kind == "float" else np.float64
    cells = max(1, min(MAX_CELLS, math.ceil(n / shard_rows)))
    sampled = own.orderBy(F.xxhash64("id"), "id").limit(cells).select("v").collect()  # MAX_CELLS at most
    pivots = spark.sparkContext.broadcast(np.array([r["v"] for r in sampled], np.float64).reshape(-1, d))

    def rows_of(column) -> np.ndarray:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
        return flat.to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, d)

    def deal(batches):
        centres = pivots.value
        tall = np.sqrt(np.maximum(radius2 - (centres * centres).sum(1), 0))
        for batch in batches:
            x = rows_of(batch.column("v")).astype(np.float64)
            high = np.sqrt(np.maximum(radius2 - (x * x).sum(1), 0))
            away = np.sqrt(np.maximum(2 * radius2 - 2 * (x @ centres.T + high[:, None] * tall), 0))
            cell = away.argmin(1)
            yield {"id": batch.column("id"), "v": batch.column("v"), "is_query": batch.column("is_query"), "cell": cell, "away": away[np.arange(len(x)), cell], "home": distances(x, centres, radius2).argmin(1)}

    dealt = materialise(map_batches(own.select("id", "v", F.coalesce("is_query", F.lit(False)).alias("is_query")), deal, f"id long, v array<{kind}>, is_query boolean, cell long, away double, home long"), "vp-rows") if sampled else own.select("id", "v", "is_query", *(F.lit(0).cast(t).alias(c) for c, t in (("cell", "long"), ("away", "double"), ("home", "long"))))
    ranges = {r["cell"]: r for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()}  # a row per cell
    asked = {r["home"]: r["n"] for r in dealt.filter("is_query").groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    low, high = (np.array([ranges[c][side] if c in ranges else np.nan for c in range(cells)]) for side in ("low", "high"))

    def part(key: str, sizes: dict[int, int], rows: int, salt: int) -> Column:
        """Number of a row's part of its cell; hashed ids spread evenly, so a part has about ``rows``."""
        parts = F.array(*(F.lit(math.ceil(sizes.get(c, 1) / rows)) for c in range(cells)))
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.get(parts, F.col(key).cast("int")).cast("long"))

    def plant(table: pa.Table) -> pa.Table:
        tree = pack(**build(table.column("id").to_numpy(), rows_of(table.column("v")), radius2))
        return pa.table({"cell": table.column("cell")[:1].cast(pa.int64()), "shard": table.column("shard")[:1].cast(pa.int64()), "tree": pa.array([tree], pa.binary())})

    def bundle(table: pa.Table) -> pa.Table:
        return pa.table({"home": table.column("home")[:1].cast(pa.int64()), "queries": pa.array([pack(ids=table.column("id").to_numpy(), x=rows_of(table.column("v")))], pa.binary())})

    shards = dealt.select("id", "v", "cell", part("cell", {c: r["n"] for c, r in ranges.items()}, shard_rows, 0).alias("shard"))
    trees = materialise(shards.groupBy("cell", "shard").applyInArrow(plant, "cell long, shard long, tree binary"), "vp-trees")
    # shards and blocks of queries are grouped, and each task searches a group of shards for a group of blocks: a tree moves once for each group of blocks
    # that needs it, a block once for each group of shards
    sizes = [math.ceil(ranges[c]["n"] / shard_rows) if c in ranges else 0 for c in range(cells)]
    begins, n_shards, n_blocks = np.cumsum([0, *sizes]), max(1, sum(sizes)), max(1, sum(math.ceil(m / block_rows) for m in asked.values()))
    wanted = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sides = min(n_blocks, max(math.ceil(n_blocks / BLOCKS), math.ceil(wanted / n_shards)))
    together = max(1, min(SHARDS, n_shards * sides // wanted))
    groups = [np.flatnonzero((begins[:-1] < g + together) & (begins[1:] > g)) for g in range(0, n_shards, together)]
    spread = min(4 * len(groups) * sides, 4 * wanted)

    blocks = dealt.filter("is_query").select("id", "v", "home", part("home", asked, block_rows, 1).alias("block"))
    bundles = materialise(blocks.groupBy("home", "block").applyInArrow(bundle, "home long, queries binary").withColumn("side", F.pmod(F.xxhash64("home", "queries"), F.lit(sides))), "vp-queries")
    slack = ROUNDING * math.sqrt(radius2)

    def first(batches):
        """A block's finds in one shard of its own cell, and what is left to search: its queries with their bounds, for each group of shards that may hold nearer ones."""
        for batch in batches:
            for home, side, tree, block in zip(*(batch.column(c).to_pylist() for c in ("home", "side", "tree", "queries")), strict=True):
                asked_ = dict(np.load(io.BytesIO(block)))
                x, ids = asked_["x"].astype(np.float64), asked_["ids"]
                limit = np.full(len(ids), np.inf)
                if tree is not None:
                    q, near, score, visited = search(dict(np.load(io.BytesIO(tree))), x, ids, radius2, k, factor)
                    yield {"slot": [None], "home": [None], "queries": [None], "query_id": [ids[q]], "vec_id": [near], "score": [score], "visited": [visited]}
                    full = np.bincount(q, minlength=len(ids)) >= k
                    last = np.searchsorted(q, np.arange(len(ids)), "right") - 1
                    limit[full] = distances_of(x[full], score[last[full]], radius2)
                may = reachable(x, limit)
                for g, mine in enumerate(groups):
                    some = np.flatnonzero(may[:, mine].any(1))
                    if len(some):
                        yield {"slot": [g * sides + side], "home": [home if tree is not None else -1], "queries": [pack(ids=ids[some], x=asked_["x"][some], limit=limit[some])], "query_id": [None], "vec_id": [None], "score": [None], "visited": [None]}

    def reachable(x, limit):
        """Whether each cell may hold something nearer to each query than its limit."""
        away = distances(x, pivots.value, radius2)
        gap = np.maximum(np.maximum(away - high, low - away), 0)
        return ~np.isnan(low) & (np.where(np.isnan(gap), np.inf, gap) <= factor * limit[:, None] + slack)

    def others(trees: pa.Table, waiting: pa.Table) -> pa.Table:
        """Each tree of the group with all queries of the group that may find something in its cell; limits follow what is found."""
        out = {"query_id": [], "vec_id": [], "score": [], "visited": []}
        blocks = [dict(np.load(io.BytesIO(b))) | {"home": h} for b, h in zip(waiting.column("queries").to_pylist(), waiting.column("home").to_pylist(), strict=True)]
        for b in blocks:
            b["x"] = b["x"].astype(np.float64)
        for cell, shard, tree in zip(*(trees.column(c).to_pylist() for c in ("cell", "shard", "tree")), strict=True):
            held = dict(np.load(io.BytesIO(tree)))
            for b in blocks:
                if b["home"] == cell and shard == 0:
                    continue
                some = np.flatnonzero(reachable(b["x"], b["limit"])[:, cell])
                if not len(some):
                    continue
                q, near, score, visited = search(held, b["x"][some], b["ids"][some], radius2, k, factor, b["limit"][some] + slack)
                full = np.flatnonzero(np.bincount(q, minlength=len(some)) >= k)
                last = np.searchsorted(q, full, "right") - 1
                b["limit"][some[full]] = np.minimum(b["limit"][some[full]], distances_of(b["x"][some[full]], score[last], radius2))
                for c, value in zip(out, (b["ids"][some[q]], near, score, visited), strict=True):
                    out[c].append(value)
        types = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), types, strict=True)})

    finds = "query_id array<long>, vec_id array<long>, score array<double>, visited long"
    started = bundles.join(trees.filter("shard = 0").select(F.col("cell").alias("home"), "tree"), "home", "left")
    begun = materialise(map_batches(started.select("home", "side", "tree", "queries"), first, f"slot long, home long, queries binary, {finds}"), "vp-begun")
    waiting = begun.filter("slot IS NOT NULL").select("slot", "home", "queries").repartition(spread, "slot")
    # a row for each group of shards and group of blocks
    slots = begun.filter("slot IS NOT NULL").select(F.col("slot").alias("to"), F.floor(F.col("slot") / sides).alias("group")).distinct()
    place = F.array(*(F.lit(int(b)) for b in begins[:-1]))
    placed = trees.withColumn("group", F.floor((F.get(place, F.col("cell").cast("int")) + F.col("shard")) / together))
    needed = placed.join(slots, "group").select("to", "cell", "shard", "tree").repartition(spread, "to")
    met = needed.groupBy("to").cogroup(waiting.groupBy("slot")).applyInArrow(others, finds)
    found = begun.filter("visited IS NOT NULL").select("query_id", "vec_id", "score", "visited").unionByName(met)
    if with_visits:
        return found.select("visited")
    each = found.select(F.inline(F.arrays_zip("query_id", "vec_id", "score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def distances_of(queries: np.ndarray, products: np.ndarray, radius2: float) -> np.ndarray:
    return np.sqrt(np.maximum((queries * queries).sum(1) + radius2 - 2 * products, 0))


def op5_vptree(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 20 == 0, k=20, factor=FACTOR)

OP5_SQL = """
WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM a WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
v AS (SELECT * FROM u WHERE len(e) = (SELECT len(e) FROM u GROUP BY len(e) ORDER BY count(*) DESC, len(e) LIMIT 1)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
) WHERE rank <= 20
"""
