"""Ranked lexical search over a clustered index.

Documents are gathered into blocks within tasks, and recursive graph bisection reorders each block: the documents of a part are cut into
halves, and pairs are swapped between them while that lowers the estimated bits of the terms' gaps. Runs of the new order are clusters,
a row each of the index: terms, postings with their impacts, and for every term the largest impact.

The impact of a term in a document, ``(1000000000 * tf) div (1000 * tf + 8 * m)``, depends on no query, so a document's score is a sum of weight times impact and
a cluster's bound for an item is the sum of weight times largest impact. Items are taken in blocks. One pass over the terms counts
documents; a second finds the clusters of highest bound for each item, and scoring those gives a score that ``k`` documents reach; the last
visits clusters in the order of their bounds and stops for an item where the bound is less than what it has found. A bound that
equals the k-th score is visited, as ties go to the smaller id, so the result is exact. Scores
are sums of integers below 2^53 in doubles, which are exact too.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased.

Defined cases: null and empty texts and texts without terms are no documents. Rows are judged one by one, so repeated rows are ranked each; null document ids
come after all others of their score. Texts of one item id (null is an id) are one item. Items without terms, or
with none that a document holds, have no rows. Very long texts are read whole. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, as_bytes, map_batches, materialise, pack_bits, unpack_bits

#: White space for every byte that parts terms, lower case for A-Z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Documents and postings of a block that is reordered at once, documents of a cluster, and rounds of swaps in each part.
BLOCK_DOCS, BLOCK_POSTINGS, CLUSTER, ROUNDS = 8192, 4_000_000, 256, 8
#: (item, term) entries of items that are searched together, and clusters of each item that are scored first.
ENTRIES, FIRST = 200_000, 4


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def bisected(doc: np.ndarray, term: np.ndarray, n: int, leaf: int) -> list[np.ndarray]:
    """Documents 0 .. n-1 in clusters of at most ``leaf``; ``doc`` and ``term`` are the postings, by document."""
    starts = np.searchsorted(doc, np.arange(n + 1))
    done, todo = [], [np.arange(n)]
    while todo:
        mine = todo.pop()
        if len(mine) <= leaf:
            done.append(mine)
            continue
        sizes = starts[mine + 1] - starts[mine]
        at = np.repeat(starts[mine] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        who, (_, what) = np.repeat(np.arange(len(mine)), sizes), np.unique(term[at], return_inverse=True)
        half = np.zeros(len(mine), bool)
        half[len(mine) // 2 :] = True
        n_terms = int(what.max()) + 1 if len(what) else 0
        for _ in range(ROUNDS if n_terms else 0):
            right = np.bincount(what[half[who]], minlength=n_terms)
            left = np.bincount(what, minlength=n_terms) - right
            n_right = int(half.sum())
            n_left = len(mine) - n_right

            def bits(a, b, n_left=n_left, n_right=n_right):
                a, b = np.maximum(a, 0), np.maximum(b, 0)
                return a * np.log2(n_left / (a + 1)) + b * np.log2(n_right / (b + 1))

            now = bits(left, right)
            moved = np.where(half[who], (now - bits(left + 1, right - 1))[what], (now - bits(left - 1, right + 1))[what])
            gain = np.bincount(who, moved, len(mine))
            a, b = np.flatnonzero(~half), np.flatnonzero(half)
            a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
            both = min(len(a), len(b))
            swap = int(np.count_nonzero(gain[a[:both]] + gain[b[:both]] > 1e-9))
            if not swap:
                break
            half[a[:swap]], half[b[:swap]] = True, False
        todo += [mine[half], mine[~half]]
    return done


@dataclass
class Index:
    """Clusters by row, and the corpus figures their impacts rest on: documents with terms, and terms of all documents."""

    clusters: DataFrame
    n_docs: int
    n_terms: int


class Block:
    """Documents that wait to be reordered."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.ids, self.lengths, self.terms, self.counts, self.postings = [], [], [], [], 0

    def add(self, id_, words: list[bytes]) -> None:
        number, tf = self.number, Counter(words)
        found = list(map(number.get, tf))
        if None in found:
            for i, w in enumerate(tf):
                if found[i] is None:
                    found[i] = number[w] = len(number)
        self.ids.append(id_)
        self.lengths.append(len(words))
        self.terms.append(np.array(found, np.int32))
        self.counts.append(np.fromiter(tf.values(), np.int64, len(tf)))
        self.postings += len(tf)

    def rows(self, n_docs: int, n_terms: int, first: int, cluster_docs: int):
        sizes = np.array([len(t) for t in self.terms])
        doc, term, tf = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(self.terms), np.concatenate(self.counts)
        m = np.array([10 + 90 * n * n_docs // n_terms for n in self.lengths], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        words = np.array(list(self.number), object)
        # a term of one document weighs the same in either half
        shared = np.bincount(term, minlength=len(words))[term] > 1
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for k, mine in enumerate(bisected(doc[shared], term[shared], len(sizes), cluster_docs)):
            at = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in mine])
            slot = np.repeat(np.arange(len(mine)), sizes[mine])
            order = np.argsort(term[at], kind="stable")
            at, slot = at[order], slot[order]
            own, begin, n = np.unique(term[at], return_index=True, return_counts=True)
            yield {
                "cluster": [first + k], "ids": [[self.ids[d] for d in mine]], "terms": [pack_text(words[own])], "df": [pack_bits(n.astype(np.uint32))],
                "most": [pack_bits(np.maximum.reduceat(impact[at], begin).astype(np.uint32))], "slots": [pack_bits(slot.astype(np.uint16))], "impacts": [pack_bits(impact[at].astype(np.uint32))],
            }


def pack_text(words) -> bytes:
    return pack_bits(np.frombuffer(b"\n".join(words), np.uint8))


def unpack_text(data: bytes) -> list[bytes]:
    return unpack_bits(data, np.uint8).tobytes().split(b"\n")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cluster_docs: int = CLUSTER) -> Index:
    """All terms of all documents, in clusters of at most ``cluster_docs`` (65,536 at most)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("__id"), as_bytes(F.col(text_col)).alias("__text"))

    def lengths(batches):
        for batch in batches:
            n = [len(terms_of(t)) for t in batch.column("__text").to_pylist()]
            yield {"docs": [sum(map(bool, n))], "terms": [sum(n)]}

    whole = map_batches(source.select("__text"), lengths, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    n_docs, n_terms = whole["docs"] or 0, whole["terms"] or 0

    def run(batches):
        from pyspark import TaskContext

        block, number = Block(), TaskContext.get().partitionId() << 32

        def rows(number):
            for row in block.rows(n_docs, n_terms, number, cluster_docs):
                yield row

        for batch in batches:
            for id_, text in zip(batch.column("__id").to_pylist(), batch.column("__text").to_pylist(), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                block.add(id_, words)
                if len(block.ids) >= BLOCK_DOCS or block.postings >= BLOCK_POSTINGS:
                    for row in rows(number):
                        number += 1
                        yield row
                    block = Block()
        if block.ids:
            yield from rows(number)

    blobs = ", ".join(f"{c} binary" for c in ("terms", "df", "most", "slots", "impacts"))
    return Index(materialise(map_batches(source, run, f"cluster long, ids array<{id_type}>, {blobs}"), "search-clusters"), n_docs, n_terms)


class Items:
    """A block of items: their terms, and by term the items that hold it."""

    def __init__(self, rows: list[tuple[int, list[bytes]]]):
        self.keys = [k for k, _ in rows]
        self.number: dict[bytes, int] = {}
        term = np.array([self.number.setdefault(t, len(self.number)) for _, terms in rows for t in terms], np.int64)
        item = np.repeat(np.arange(len(rows)), [len(t) for _, t in rows])
        order = np.argsort(term, kind="stable")
        self.item = item[order]
        self.starts = np.searchsorted(term[order], np.arange(len(self.number) + 1))
        self.weight = np.zeros(len(self.number), np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def weigh(self, df: dict[int, int], n_docs: int) -> None:
        for t, n in df.items():
            self.weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        # sums of doubles are exact below 2^53
        most = np.bincount(self.item, np.repeat(self.weight, np.diff(self.starts)).astype(np.float64), len(self)).max(initial=0)
        if most * 1_000_000 >= 1 << 53:
            raise ValueError("an item's scores may exceed 2^53")

    def held(self, terms: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places of the cluster's terms that items hold, and their numbers."""
        found = [(i, t) for i, t in enumerate(map(self.number.get, unpack_text(terms))) if t is not None]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    def entries(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all items of these terms: place in ``numbers``, item."""
        sizes = self.starts[numbers + 1] - self.starts[numbers]
        at = np.repeat(self.starts[numbers] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.repeat(np.arange(len(numbers)), sizes), self.item[at]

    def bounds(self, place: np.ndarray, numbers: np.ndarray, most: bytes) -> np.ndarray:
        """No document of the cluster has a higher score for the item."""
        at, item = self.entries(numbers)
        high = self.weight[numbers] * unpack_bits(most, np.uint32)[place]
        return np.bincount(item, high[at].astype(np.float64), len(self))

    def scores(self, row: dict, place: np.ndarray, numbers: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Scores of the cluster's documents for the active items."""
        df, slots, impacts = unpack_bits(row["df"], np.uint32).astype(np.int64), unpack_bits(row["slots"], np.uint16), unpack_bits(row["impacts"], np.uint32)
        ends, n = np.cumsum(df)[place], df[place]
        at = np.repeat(ends - np.cumsum(n), n) + np.arange(n.sum())
        held = np.zeros((len(place), len(row["ids"])))
        held[np.repeat(np.arange(len(place)), n), slots[at]] = impacts[at]
        row_of = np.full(len(self), -1)
        row_of[active] = np.arange(len(active))
        at, item = self.entries(numbers)
        some = row_of[item] >= 0
        weights = np.zeros((len(active), len(place)))
        weights[row_of[item[some]], at[some]] = self.weight[numbers[at[some]]]
        return weights @ held


class Best:
    """The best ``k`` documents of each item so far, and the score that the last of them has."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least, self.found = k, np.maximum(least, 1.0), [[] for _ in range(n)]

    def add(self, items: np.ndarray, scores: np.ndarray, ids: list) -> None:
        for i, d in zip(*np.nonzero(scores >= self.least[items][:, None]), strict=True):
            self.found[items[i]].append((-int(scores[i, d]), ids[d] is None, ids[d] if ids[d] is not None else 0))
        for item in items:
            if len(mine := self.found[item]) > self.k:
                mine.sort()
                del mine[self.k :]
            if len(mine) == self.k:
                self.least[item] = max(self.least[item], -max(mine)[0])

    def rows(self, keys: list[int]) -> dict:
        flat = [(keys[i], -s, None if null else d) for i, mine in enumerate(self.found) for s, null, d in mine]
        item, score, ids = zip(*flat, strict=True) if flat else ((), (), ())
        return {"item": list(item), "score": list(score), "doc_id": list(ids)}


def top_of_block(index: Index, items: Items, k: int, id_type: str, with_visits: bool = False) -> DataFrame:
    """(item, score, doc_id): the best ``k`` of each task for each item, of which the best ``k`` are the item's."""
    spark, clusters = index.clusters.sparkSession, index.clusters
    shared = spark.sparkContext.broadcast(items)

    def count(batches):
        own = shared.value
        total = np.zeros(len(own.number), np.int64)
        for batch in batches:
            for terms, df in zip(batch.column("terms").to_pylist(), batch.column("df").to_pylist(), strict=True):
                place, numbers = own.held(terms)
                total[numbers] += unpack_bits(df, np.uint32)[place]
        at = np.flatnonzero(total)
        yield {"term": at, "df": total[at]}

    # a row for each term of the block of items at most
    df = map_batches(clusters.select("terms", "df"), count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    items.weigh({r["term"]: r["df"] for r in df.collect()}, index.n_docs)
    shared = spark.sparkContext.broadcast(items)

    def highest(batches):
        own = shared.value
        high, who = np.zeros((len(own), FIRST)), np.full((len(own), FIRST), -1)
        for batch in batches:
            for r in batch.to_pylist():
                high = np.concatenate([high, own.bounds(*own.held(r["terms"]), r["most"])[:, None]], axis=1)
                who = np.concatenate([who, np.full((len(own), 1), r["cluster"])], axis=1)
                order = np.argsort(-high, axis=1, kind="stable")[:, :FIRST]
                high, who = np.take_along_axis(high, order, 1), np.take_along_axis(who, order, 1)
        item, at = np.nonzero((who >= 0) & (high > 0))
        yield {"item": item, "cluster": who[item, at], "bound": high[item, at]}

    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "cluster"))
    first = map_batches(clusters.select("cluster", "terms", "most"), highest, "item long, cluster long, bound double").withColumn("__place", place).filter(F.col("__place") <= FIRST)
    chosen: dict[int, list[int]] = {}
    for r in first.collect():  # FIRST rows for each item of the block at most
        chosen.setdefault(r["cluster"], []).append(r["item"])
    schema = f"item long, score long, doc_id {id_type}"

    def visit_first(batches):
        own = shared.value
        best = Best(len(own), k, np.zeros(len(own)))
        for batch in batches:
            for r in batch.to_pylist():
                active = np.array(chosen[r["cluster"]])
                best.add(active, own.scores(r, *own.held(r["terms"]), active), r["ids"])
        yield best.rows(list(range(len(own))))

    least = np.zeros(len(items))
    if chosen:
        wanted = F.broadcast(spark.createDataFrame([(c,) for c in chosen], "cluster long"))
        reached = map_batches(clusters.join(wanted, "cluster", "left_semi"), visit_first, schema)
        order = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
        for r in reached.withColumn("__place", order).filter(F.col("__place") == k).select("item", "score").collect():  # one row an item at most
            least[r["item"]] = r["score"]
    known = spark.sparkContext.broadcast(least)

    def visit(batches):
        own = shared.value
        best, visits = Best(len(own), k, known.value), 0
        for batch in batches:
            rows = batch.to_pylist()
            held = [own.held(r["terms"]) for r in rows]
            bounds = np.array([own.bounds(*h, r["most"]) for h, r in zip(held, rows, strict=True)])
            for c in np.argsort(-(bounds - best.least).max(1), kind="stable") if rows else ():
                active = np.flatnonzero(bounds[c] >= best.least)
                visits += len(active)
                if len(active):
                    best.add(active, own.scores(rows[c], *held[c], active), rows[c]["ids"])
        yield {"item": [None], "score": [visits], "doc_id": [None]} if with_visits else best.rows(own.keys)

    return map_batches(clusters, visit, schema)


def search(index: Index, items: DataFrame, k: int = 10, item_id_col: str = "item_id", item_text_col: str = "text", with_visits: bool = False) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item.

    ``with_visits``: instead, (visited), how many clusters the items of each task had to visit.
    """
    spark, item_type = items.sparkSession, items.schema[item_id_col].dataType.simpleString()
    id_type = index.clusters.schema["ids"].dataType.elementType.simpleString()
    words = F.array_remove(F.split(F.translate(F.coalesce(F.col(item_text_col).cast("string"), F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")
    held = items.select(F.col(item_id_col).alias("item_id"), F.explode(words).alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    held = materialise(held.withColumn("key", F.xxhash64("item_id", F.lit(7))), "search-items")
    blocks, out = max(1, -(-(held.agg(F.sum(F.size("terms"))).first()[0] or 0) // ENTRIES)), []
    for b in range(blocks):
        # about ENTRIES terms
        rows = held.filter(F.pmod("key", F.lit(blocks)) == b).select("item_id", "terms").collect() if index.n_docs else []
        if not rows:
            continue
        numbered = Items([(i, [t.encode() for t in r["terms"]]) for i, r in enumerate(rows)])
        best = top_of_block(index, numbered, k, id_type, with_visits)
        if with_visits:
            out.append(best.select(F.col("score").alias("visited")))
            continue
        order = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {item_type}")
        ranked = best.withColumn("rank", order).filter(F.col("rank") <= k)
        out.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    result = out[0] if out else spark.createDataFrame([], "visited long" if with_visits else f"item_id {item_type}, rank int, doc_id {id_type}, score long")
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def op12_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(build_index(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), k=10)


_TERMS = f"unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> ''))"
#: Every document scored for every item that shares a term with it.
OP12_SQL = f"""
WITH words AS (SELECT row, doc_id, {_TERMS} AS w FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
tf AS (SELECT row, any_value(doc_id) AS doc_id, w, count(*) AS tf FROM words GROUP BY row, w),
docs AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY row),
corpus AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM docs),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
items AS (SELECT DISTINCT item_id, {_TERMS} AS w FROM benchmark),
weights AS (SELECT w, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight FROM df, corpus),
impacts AS (SELECT row, doc_id, w, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)) AS impact FROM tf JOIN docs USING (row), corpus WHERE w IN (SELECT w FROM items)),
scores AS (SELECT item_id, row, any_value(doc_id) AS doc_id, CAST(sum(weight * impact) AS BIGINT) AS score FROM items JOIN weights USING (w) JOIN impacts USING (w) GROUP BY item_id, row),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
