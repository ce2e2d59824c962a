"""The pipeline's near-duplicates: SimHash links by Golay keys, verified, and completed by an exact Jaccard join of word shingles.

Texts with equal shingle sets are collapsed first. Each set has a fingerprint of its shingles, and the Golay keys of
``simhash`` find the fingerprints within three bits; such a pair of sets is a link if it reaches the similarity ``t``. Fingerprints
within three bits are too near to find most pairs at 0.8 (they differ in ten bits on average), so a prefix-filtered join completes the links.

Shingles have one order over the whole corpus: those that a once/twice
filter shows to be in one row only, then the others by the power of two of their estimated count, then by hash. Two
sets of similarity ``t`` share one of the first ``n - ceil(t * n) + 1`` shingles of each, so these are the keys; keys of one row
only meet nothing and are not written. Sizes of filter and counts change what is written, never what is found.

Where sets that share keys make too many pairs, they are compared in rounds. In each, every set is compared with some pivots of the key, and what
is similar becomes one component; groups of near copies need few rounds. When few pairs are left (or pivots find nothing
more), each set outside its key's largest component is compared with all others that lengths, places of the
key and sketches allow. A set's sketch has a bit for each of ``SKETCH`` cells of its shingles: whether the cell holds an odd number of them. Sets differ in at least as
many shingles as their sketches in bits, so a pair whose sketches differ in more bits than the similarity leaves room for is no link. Every pair that is left has its common shingles counted, so the components are
those of all pairs that reach the similarity.

Defined cases: case is that of ASCII, words are parted by ASCII white space. A text of fewer words than a shingle is one shingle;
null, empty and blank texts have the empty set and are copies of each other. Equal ids and null ids are
judged as in ``simhash``. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import as_bytes, map_batches, materialise, pack_bits, power_of_two, sliced, unpack_bits
from tessera.llm.components import connected_components
from tessera.llm.repeat_filter import build, gather, suspected

SEED = 42
#: Cells of the estimated counts.
HEAT = 1 << 20
#: Rounds of comparisons with pivots, pivots of a key in each, and the open pairs for each key of a set that are few enough to compare them all.
ROUNDS, PIVOTS, FEW = 4, 32, 32
#: Bits of a set's sketch.
SKETCH = 1024
U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, U)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, SEED) for w in words), U, len(words))
    k = min(n, len(words))
    total = np.full(len(words) - k + 1, k, U)
    for i in range(k):
        total = mixed(total + hashes[i : len(words) - k + 1 + i])
    return np.unique(total)


def set_id(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & U(HEAT - 1)).astype(np.int64)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """A bit for each cell with an odd number of the hashes, as longs."""
    odd = np.bincount((hashes >> U(40) & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def needed(n: int, threshold: float) -> int:
    """Common shingles that a set of ``n`` has with any set of that similarity, at least."""
    return math.ceil(threshold * n - 1e-9)


def sets_of_rows(source: DataFrame, id_type: str, n: int) -> DataFrame:
    """(doc_id, sid, fp) of each row, and for each task a row with ``heat``, its counts of shingles by cell."""

    def run(batches):
        heat = np.zeros(HEAT, U)
        for batch in sliced(batches):
            found, prints = [], []
            for text in batch.column("__text").to_pylist():
                mine = shingles(text, n)
                found.append(set_id(mine))
                prints.append(simhash.majority(mine))
                np.add.at(heat, cells(mine), U(1))
            yield {"doc_id": batch.column("__id"), "sid": found, "fp": np.array(prints, U).view(np.int64), "heat": [None] * len(found)}
        yield {"doc_id": [None], "sid": [None], "fp": [None], "heat": [pack_bits(heat)]}

    return materialise(map_batches(source, run, f"doc_id {id_type}, sid binary, fp long, heat binary"), "shingle-sets")


def estimated(rows: DataFrame) -> np.ndarray:
    """Power of two of the counts by cell; 1 MB, whatever the input."""

    def total(batches):
        heat = np.zeros(HEAT, U)
        for batch in batches:
            for part in batch.column("heat").to_pylist():
                heat += unpack_bits(part)
        yield {"heat": [pack_bits(heat)]}

    heat = np.zeros(HEAT, U)
    for r in map_batches(rows.select("heat").filter("heat IS NOT NULL").repartition(8), total, "heat binary").toLocalIterator():
        heat += unpack_bits(bytes(r["heat"]))
    return np.log2(heat + U(1)).astype(np.uint8)


def keyed_sets(source: DataFrame, n: int, threshold: float, twice, heat) -> DataFrame:
    """(sid, n, before, keys, sketch, hashes) of the sets with keys; ``before`` are the shingles that come before the keys."""

    def run(batches):
        for batch in sliced(batches):
            rows = []
            for text in batch.column("__text").to_pylist():
                mine = shingles(text, n)
                if not len(mine):
                    continue
                prefix = len(mine) - needed(len(mine), threshold) + 1
                shared = mine[suspected(twice.value, mine)]
                before = len(mine) - len(shared)
                if before < prefix:
                    order = np.lexsort((shared, heat.value[cells(shared)]))[: prefix - before]
                    rows.append((set_id(mine), len(mine), before, shared[order].view(np.int64), odd_sketch(mine), mine.tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield dict(zip(("sid", "n", "before", "keys", "sketch", "hashes"), map(list, columns), strict=True))

    found = map_batches(source.select("__text"), run, "sid binary, n long, before long, keys array<long>, sketch array<long>, hashes binary")
    return materialise(found.groupBy("sid").agg(*(F.first(c).alias(c) for c in ("n", "before", "keys", "sketch", "hashes"))), "keyed-sets")


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(x, y) of those of ``pairs`` (a, b, x, y) whose sets a and b reach the similarity."""

    def run(batches):
        for batch in sliced(batches):
            x, y = [], []
            for *ends, p, q in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "p", "q")), strict=True):
                p, q = np.frombuffer(p, U), np.frombuffer(q, U)
                common = len(np.intersect1d(p, q, assume_unique=True))
                if common >= threshold * (len(p) + len(q) - common) - 1e-9:
                    x.append(ends[0])
                    y.append(ends[1])
            yield {"a": x, "b": y}

    own = sets.select("sid", "hashes")
    left = pairs.hint("merge").join(own.select(F.col("sid").alias("a"), F.col("hashes").alias("p")), "a")
    both = left.hint("merge").join(own.select(F.col("sid").alias("b"), F.col("hashes").alias("q")), "b")
    return materialise(map_batches(both.select("x", "y", "p", "q"), run, "a binary, b binary"), "similar")


def golay_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) of sets whose fingerprints differ in three bits at most; sets of one fingerprint meet in its smallest."""
    prints = materialise(rows.select("sid", "fp").distinct(), "prints")
    smallest = prints.groupBy("fp").agg(F.min("sid").alias("a"))
    same = prints.join(smallest.hint("merge"), "fp").filter("sid <> a").select("a", F.col("sid").alias("b"))
    of = lambda end: smallest.select(F.col("fp").alias(end), F.col("a").alias(f"__{end}")).hint("merge")
    linked = simhash.links(smallest.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("__a").alias("a"), F.col("__b").alias("b"))
    return same.unionByName(linked)


def components(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(sid, root) of the sets with keys."""
    longer = threshold / (1 + threshold)
    long_enough = lambda a, b: F.least(a, b) >= threshold * F.greatest(a, b) - 1e-9
    # the first key that two sets share leaves enough shingles after it in both
    reach = lambda a, b, i, j: F.least(a - i, b - j) >= longer * (a + b) - 1e-9
    # what a pair may differ in
    differ = lambda a, b: sum((F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0))
    room = lambda a, b: (1 - threshold) / (1 + threshold) * (a + b) + 1e-9
    keys = sets.select("sid", "n", "before", F.posexplode("keys").alias("i", "key")).select("key", "sid", "n", (F.col("before") + F.col("i")).alias("place"))
    # the smaller set of a pair has the key among its first ones
    first = F.col("n") - F.col("place") >= 2 * longer * F.col("n") - 1e-9
    met = keys.groupBy("key").agg(F.min(F.when(first, F.col("n"))).alias("least"), F.count(F.lit(1)).alias("members")).filter("members > 1 AND least IS NOT NULL")
    members = keys.join(met.select("key", "least").hint("merge"), "key").filter(first | (F.col("n") > F.col("least"))).select("key", "sid", "n", "place", first.alias("first"))
    members = materialise(members.withColumn("root", F.col("sid")), "shingle-keys")
    total, merges, before = members.count(), [], math.inf

    def merged(table: DataFrame, links: DataFrame) -> DataFrame:
        merges.append(materialise(connected_components(links), "merges"))
        step = merges[-1].select(F.col("node").alias("root"), F.col("root").alias("__to"))
        return materialise(table.join(step.hint("merge"), "root", "left").withColumn("root", F.coalesce("__to", "root")).drop("__to"), "shingle-keys")

    # all of these tables grow with the corpus: none is broadcast, however small it is here
    near = similar(golay_pairs(rows).select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), sets, threshold)
    if not near.isEmpty():
        members = merged(members, near)
    for r in range(ROUNDS):
        # keys whose sets are all in one component are done
        sizes = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        state = sizes.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), ((F.pow(F.sum("n"), 2) - F.sum(F.pow("n", 2))) / 2).alias("open")).filter("open > 0")
        state = materialise(state, "open-keys")
        members = members.join(state.select("key").hint("merge"), "key")
        if "sketch" not in members.columns:
            # only sets of open keys are compared
            members = members.join(sets.select("sid", "sketch").hint("merge"), "sid")
        members = materialise(members, "shingle-keys")
        left = state.agg(F.sum("open")).first()[0] or 0
        # few, or pivots don't help any more: what is left is mostly unlike
        if left <= FEW * total or left > before / 2:
            break
        before = left
        # the same sets come first for all keys that they share
        order = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(F.lit(r), "sid"), "sid"))
        pivots = members.filter("first").withColumn("__order", order).filter(F.col("__order") <= PIVOTS).select("key", F.struct("sid", "n", "place", "root", "sketch").alias("p"))
        met = members.join(pivots.hint("merge"), "key").filter((F.col("root") != F.col("p.root")) & long_enough(F.col("n"), F.col("p.n")) & reach(F.col("n"), F.col("p.n"), F.col("place"), F.col("p.place")) & (differ("sketch", "p.sketch") <= room(F.col("n"), F.col("p.n"))))
        near = similar(met.select(F.col("p.sid").alias("a"), F.col("sid").alias("b"), F.col("p.root").alias("x"), F.col("root").alias("y")).distinct(), sets, threshold)
        if near.isEmpty():
            break
        members = merged(members, near)
    if r == ROUNDS - 1 or not near.isEmpty():
        sizes = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        state = materialise(sizes.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main")), "open-keys")
    outside = members.join(state.select("key", "main").hint("merge"), "key").filter("root <> main")
    a, b = outside.alias("a"), members.alias("b")
    allowed = (F.col("a.root") != F.col("b.root")) & long_enough(F.col("a.n"), F.col("b.n")) & reach(F.col("a.n"), F.col("b.n"), F.col("a.place"), F.col("b.place")) & (differ("a.sketch", "b.sketch") <= room(F.col("a.n"), F.col("b.n")))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & allowed)
    swap = F.col("a.sid") > F.col("b.sid")
    ends = lambda c: (F.when(swap, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")), F.when(swap, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")))
    (p, q), (x, y) = ends("sid"), ends("root")
    pairs = pairs.select(p.alias("a"), q.alias("b"), x.alias("x"), y.alias("y")).distinct()
    near = similar(pairs, sets, threshold)
    if not near.isEmpty():
        merges.append(materialise(connected_components(near), "merges"))
    roots = sets.select("sid", F.col("sid").alias("root"))
    for merge in merges:
        step = merge.select(F.col("node").alias("root"), F.col("root").alias("__to"))
        roots = roots.join(step.hint("merge"), "root", "left").select("sid", F.coalesce("__to", "root").alias("root"))
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, max_filter_bits: int = 1 << 28) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs``: rows joined by pairs of similarity ``threshold`` or more."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("__id"), as_bytes(F.col(text_col)).alias("__text"))
    rows = sets_of_rows(source, docs.schema[id_col].dataType.simpleString(), n)
    own = rows.filter("sid IS NOT NULL").select("doc_id", "sid")
    n_words = (docs.agg(F.sum(F.length(text_col))).first()[0] or 1) / 6
    bits = power_of_two(2 * n_words, 1 << 16, max_filter_bits)

    def hashes_of(batch):
        return np.concatenate([np.empty(0, U), *(shingles(t, n) for t in batch.column("__text").to_pylist())])

    twice = gather(spark, build(hashes_of, source.select("__text"), bits, 1), bits, 1)
    heat = spark.sparkContext.broadcast(estimated(rows))
    roots = components(rows.filter("sid IS NOT NULL"), keyed_sets(source, n, threshold, twice, heat), threshold)
    firsts = own.groupBy("sid").agg(F.min("doc_id").alias("first"))
    classes = materialise(firsts.join(roots.hint("merge"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "classes")
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(classes.join(smallest.hint("merge"), "root").select("sid", "component_id").hint("merge"), "sid").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each component: that of smallest id. Rows that repeat its id stay with it."""
    found = near_duplicates(docs, id_col, text_col, n, threshold)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept.hint("merge"), docs[id_col].eqNullSafe(kept["__kept"]), "left_semi")
