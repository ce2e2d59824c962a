"""Removal of word passages that occur elsewhere, with a count-min prefilter.

A window is ``size`` consecutive words of one document. Each window is represented in the sketch by its anchor, the
least hash among its runs of ``GRAM`` words: equal windows have equal anchors at different places, so the number of places of an
anchor is never below the number of occurrences of a window. Pass 1 counts anchor places in one count-min sketch per
task and merges the sketches by addition; a window's estimate is that of its anchor, which is never below its true count. Pass 2 shuffles
only windows estimated repeated, as 128-bit hashes, each distinct one once per task, and groups them exactly; the groups of one are
the estimate's mistakes and travel back to their documents, by the row's 64-bit key and 64 bits of the window itself, so that
rows with one key cannot spoil each other's windows. What is estimated repeated and not a mistake is repeated, so none is lost and none is added.

The sketch's size follows the corpus up to ``max_cells`` counters a row; beyond that more windows are shuffled, and the
result is the same.

Defined cases: a null or empty text has no words. Rows are judged as documents of their own, so
a repeated row repeats all its windows; null and equal ids are allowed. Texts shorter than a window keep all words. Very
long texts are read whole. An empty table gives an empty result. ``remove_repeats`` passes other columns through;
working columns have names starting with ``__``.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, map_batches, power_of_two
from tessera.llm.count_min import build, gather_repeated
from tessera.llm.repeat_filter import suspected

ROWS = 2
SIZE, GRAM = 35, 20
CHUNK_WORDS = 100_000
#: Suspected windows that a task gathers before it emits the distinct ones.
FLUSH = 1 << 21
MASK = (1 << 64) - 1
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = power_of_two(n, 1 << 18, 1 << 62)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        _POWERS[base] = tuple(both)
    return _POWERS[base]


def rolling(values: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hash of each run of ``k`` values."""
    up, down = powers(base, len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * down[: len(values)], dtype=np.uint64)])
    found = (sums[k:] - sums[:-k]) * up[: len(values) - k + 1]
    return (found ^ (found >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Chunk:
    """Some documents of a batch: their words one after the other."""

    def __init__(self, first: int, lists: list[list[bytes]], size: int, gram: int):
        self.first, self.lists, self.size, self.gram = first, lists, size, gram
        self.hashes: np.ndarray | None = None
        lengths = np.array([len(x) for x in lists], np.int64)
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        self.n = int(self.ends[-1]) if len(lists) else 0
        windows = np.maximum(lengths - size + 1, 0)
        #: Start of each window, and its document.
        self.doc = np.repeat(np.arange(len(lists)), windows)
        self.starts = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(self.begins, windows)
        if len(self.starts):
            digest = xxhash.xxh3_64_intdigest
            self.words = np.fromiter((digest(w) for x in lists for w in x), np.uint64, self.n)
            self.grams = rolling(self.words, gram, BASES[0])
            least, width = self.grams, 1
            span = size - gram + 1
            while width < span:
                step = min(width, span - width)
                least, width = np.minimum(least[:-step], least[step:]), width + step
            self.least = least

    def anchor_places(self) -> np.ndarray:
        """Hash of each place that is the anchor of some window."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        is_window = np.zeros(len(self.least), bool)
        is_window[self.starts] = True
        chosen = np.zeros(len(self.grams), bool)
        for o in range(self.size - self.gram + 1):
            chosen[o : o + len(self.least)] |= is_window & (self.grams[o : o + len(self.least)] == self.least)
        return self.grams[chosen]

    def suspects(self, twice: np.ndarray) -> np.ndarray:
        """Mask of the windows whose anchor is estimated repeated."""
        return suspected(twice, self.least[self.starts]) if len(self.starts) else np.zeros(0, bool)

    def window_hashes(self) -> np.ndarray:
        """First column of ``exact`` for a window at each place."""
        if self.hashes is None:
            self.hashes = rolling(self.words, self.size, BASES[0])
        return self.hashes

    def exact(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes of windows, as two columns."""
        mixed = (self.words ^ (self.words >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        at = self.starts[some]
        return self.window_hashes()[at], rolling(mixed, self.size, BASES[1])[at]


def chunks(texts: list[bytes], size: int, gram: int):
    lists, first, n = [], 0, 0
    for i, text in enumerate(texts):
        words = text.split()
        lists.append(words)
        n += len(words)
        if n >= CHUNK_WORDS:
            yield Chunk(first, lists, size, gram)
            lists, first, n = [], i + 1, 0
    if lists:
        yield Chunk(first, lists, size, gram)


def row_key(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, max_cells: int = 1 << 27) -> DataFrame:
    """``docs`` with ``text_col`` as the kept words joined by one space, and ``n_words`` and ``n_removed`` added (or replaced)."""
    spark = docs.sparkSession
    gram = min(gram, size)
    docs = docs.drop("n_words", "n_removed")
    keyed = docs.withColumn("__row", row_key(F.col(id_col), F.col(text_col).cast("string")))
    source = keyed.select("__row", as_bytes(F.col(text_col)).alias("__text"))
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    anchors = n_bytes / 6 * 2 / (size - gram + 2)
    cells = power_of_two(3 * anchors, 1 << 16, max_cells)

    def anchor_hashes(batch):
        found = [c.anchor_places() for c in chunks(batch.column("__text").to_pylist(), size, gram)]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    twice = gather_repeated(spark, build(anchor_hashes, source.select("__text"), cells, ROWS), cells, ROWS)

    def suspects(batches):
        held, n = [], 0

        def flush():
            h1, h2, row, at = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((h2, h1))
            h1, h2, row, at = h1[order], h2[order], row[order], at[order]
            new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            begin = np.flatnonzero(new)
            counts = np.diff(np.r_[begin, len(h1)])
            # a window met twice needs no way back: it stands for itself with a count of two
            for s in range(0, len(begin), 1 << 16):
                b = begin[s : s + (1 << 16)]
                yield {"h1": h1[b].view(np.int64), "h2": h2[b].view(np.int64), "row": row[b], "at": np.where(counts[s : s + (1 << 16)] > 1, -1, at[b]).astype(np.int32)}

        for batch in batches:
            rows = batch.column("__row").to_numpy(zero_copy_only=False)
            for c in chunks(batch.column("__text").to_pylist(), size, gram):
                some = np.flatnonzero(c.suspects(twice.value))
                if len(some):
                    held.append((*c.exact(some), rows[c.first + c.doc[some]], c.starts[some] - c.begins[c.doc[some]]))
                    n += len(some)
                if n >= FLUSH:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    # shuffled as they are, since a task has made them distinct; the grouping itself may spill
    grouped = map_batches(source, suspects, "h1 long, h2 long, row long, at int").repartition("h1", "h2").groupBy("h1", "h2")
    alone = grouped.agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("row"), F.min("at").alias("at")).filter("n = 1 and at >= 0")
    mistakes = alone.groupBy(F.col("row").alias("__match")).agg(F.collect_list("at").alias("__alone"), F.collect_list("h1").alias("__windows"))
    joined = keyed.join(mistakes, keyed["__row"] == mistakes["__match"], "left")
    others = [c for c in docs.columns if c != text_col]

    def rewrite(batches):
        for batch in batches:
            texts, alone, windows = batch.column("__text").to_pylist(), batch.column("__alone"), batch.column("__windows")
            n_words, n_removed, kept = [], [], []
            for c in chunks(texts, size, gram):
                repeated = c.suspects(twice.value)
                covered = np.zeros(c.n + 1, np.int64)
                is_repeated = np.zeros(c.n + 1, bool)
                is_repeated[c.starts[repeated]] = True
                for i, begin in enumerate(c.begins):
                    if (mine := alone[c.first + i]).is_valid:
                        at = begin + mine.values.to_numpy(zero_copy_only=False)
                        same = windows[c.first + i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                        # of another row with this key no place, or another window, is meant
                        at, same = at[at + size <= c.ends[i]], same[at + size <= c.ends[i]]
                        if len(at):
                            is_repeated[at[c.window_hashes()[at] == same]] = False
                at = np.flatnonzero(is_repeated)
                np.add.at(covered, at, 1)
                np.add.at(covered, at + size, -1)
                gone = np.cumsum(covered)[: c.n] > 0
                for words, b, e in zip(c.lists, c.begins, c.ends, strict=True):
                    mine = gone[b:e]
                    n_words.append(len(words))
                    n_removed.append(int(mine.sum()))
                    kept.append(b" ".join([w for w, g in zip(words, mine.tolist(), strict=True) if not g] if n_removed[-1] else words))
            yield {k: batch.column(k) for k in others} | {"__n": n_words, "__removed": n_removed, "__kept": kept}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema.fields)
    out = map_batches(joined.select(*others, as_bytes(F.col(text_col)).alias("__text"), "__alone", "__windows"), rewrite, f"{schema}{', ' if others else ''}__n long, __removed long, __kept binary")
    return out.select(*(F.col("__kept").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), F.col("__n").alias("n_words"), F.col("__removed").alias("n_removed"))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 33, 1))) AS i)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + o AS p FROM rep, (SELECT unnest(range(0, 35)) AS o)
), pos AS (
  SELECT doc_id, p, ws[p] AS word FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS p)
), kept AS (
  SELECT pos.doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone.p IS NOT NULL) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY pos.p) FILTER (WHERE gone.p IS NULL), '') AS kept
  FROM pos LEFT JOIN gone ON pos.doc_id = gone.doc_id AND pos.p = gone.p GROUP BY pos.doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
