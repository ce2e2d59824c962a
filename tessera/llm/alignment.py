"""Alignment of two tokenizers over the same bytes.

A stretch of text is encoded by both; its B tokens form a static interval index (their sorted starts and ends), and each A token stabs
it by bisection for the run of B tokens that its bytes overlap. A gap between two B tokens that no A token spans is a border of groups.

Both tokenizers start a new token at a single space between visible characters, so a text's tokens, links and groups are those of its
stretches one after the other, and each distinct stretch of a chunk of documents is encoded and aligned once. Corpus-wide counts of
linked id pairs are added up in buckets of pairs: a chunk sends each of its distinct pairs once and gets the
total back, so what moves is distinct pairs per chunk, a pair of all chunks is one entry of each, and no table of all pairs is
held anywhere. What is broadcast is one number for each id of B's vocabulary.

Defined cases: null and empty texts have no tokens. Texts whose joined token bytes differ from space and text (a U+2581 in the text, for
one) have none either. Rows are judged one by one: repeated rows count each time and keep a row each, null ids too. Very long texts
are aligned whole. An empty table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import byte_symbols, vocabulary
from tessera.llm.common import map_batches, materialise, pack_bits, unpack_bits

#: Characters of the documents of one chunk (the last document may exceed it), and documents encoded at a time.
CHUNK_CHARS, DOCS = 24_000_000, 256
#: Stretches that a Python worker remembers, and the longest one among them.
CACHE, LONGEST = 300_000, 48
#: Pairs of all chunks that one bucket adds up.
BUCKET_PAIRS = 4_000_000
#: A space that ends nothing: at either end of the text, or before other white space.
LOOSE = re.compile(r"\A | \s| \Z")
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
U = np.uint64


def overlaps(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token the first and the last B token whose bytes it overlaps."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    return np.searchsorted(b_ends, a_ends - a_lengths, "right"), np.searchsorted(b_ends - b_lengths, a_ends, "left") - 1


def group_ends(first: np.ndarray, last: np.ndarray, n_b: int) -> np.ndarray:
    """Whether a group ends after each B token: no A token spans the gap behind it."""
    spans = np.zeros(n_b + 1, np.int64)
    np.add.at(spans, first, 1)
    np.add.at(spans, last, -1)
    return np.cumsum(spans)[:n_b] == 0


class Aligner:
    """Both tokenizers, and a memory for stretches: (pairs as integers, groups as text, A tokens, B tokens, groups), None if the bytes differ."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {s: i for i, s in enumerate(byte_symbols())}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        self.size_b = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.size_b) for p in [self.b.id_to_piece(i)]]
        self.a_lengths, self.b_lengths = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        #: Decimal ids with what may stand before them: A's first of all, of a group, within one; B's first of a group, within one.
        kinds = [(self.a_bytes, b""), (self.a_bytes, b";"), (self.a_bytes, b","), (self.b_bytes, b"|"), (self.b_bytes, b",")]
        self.form_bytes = [before + b"%d" % i for entries_, before in kinds for i in range(len(entries_))]
        self.form_lengths = np.array(list(map(len, self.form_bytes)), np.int64)
        self.forms = np.cumsum([0, *(len(entries_) for entries_, _ in kinds[:-1])])
        self.dtype = np.uint32 if len(self.a_bytes) * self.size_b < 1 << 32 else np.uint64
        self.known: dict[str, tuple | None] = {}

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of A and B for space and text; None where the bytes of either differ from it."""
        raw = [f" {t}" for t in texts]
        ids = list(zip([e.ids for e in self.a.encode_batch_fast(raw, add_special_tokens=False)], self.b.encode(texts, num_threads=1), strict=True))
        joined = lambda side, entries, some: b"".join(map(entries.__getitem__, chain.from_iterable(x[side] for x in some)))
        same = lambda text, some: joined(0, self.a_bytes, some) == text.encode() == joined(1, self.b_bytes, some)
        # a text of other bytes than its tokens differs from them where the others are like theirs
        return ids if same("".join(raw), ids) else [x if same(r, [x]) else None for r, x in zip(raw, ids, strict=True)]

    def measure(self, texts: list[str]) -> list[tuple | None]:
        """Records of texts that both tokenizers may take one after the other, so one index serves them all."""
        ids = self.encode(texts)
        good = [x for x in ids if x is not None]
        a, b = (np.fromiter(chain.from_iterable(x[side] for x in good), np.int64) for side in (0, 1))
        n_a, n_b = (np.array([len(x[side]) for x in good], np.int64) for side in (0, 1))
        first, last = overlaps(self.a_lengths[a], self.b_lengths[b])
        ends = group_ends(first, last, len(b))
        n = last - first + 1
        pairs = np.repeat(a * self.size_b, n) + b[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
        # groups as text: by group, A's ids before B's, each with what stands before it
        group_b = np.cumsum(ends) - ends
        group_a = group_b[first] if len(a) else first
        begins_a, begins_b = (np.diff(g, prepend=-1) > 0 for g in (group_a, group_b))
        lead = np.zeros(len(a), bool)
        lead[np.cumsum(n_a) - n_a] = True
        form_a = np.where(lead, self.forms[0], np.where(begins_a, self.forms[1], self.forms[2])) + a
        form_b = np.where(begins_b, self.forms[3], self.forms[4]) + b
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        form = np.concatenate([form_a, form_b])[order]
        text = b"".join(map(self.form_bytes.__getitem__, form.tolist()))
        until = lambda values, counts: np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        text_at, pair_at, group_at = until(self.form_lengths[form], n_a + n_b), until(n * self.dtype().itemsize, n_a), until(ends, n_b)
        packed = pairs.astype(self.dtype).tobytes()
        spans = zip(pairwise(pair_at), pairwise(text_at), n_a.tolist(), n_b.tolist(), pairwise(group_at), strict=True)
        records = ((packed[p:q], text[x:y], k, m, h - g) for (p, q), (x, y), k, m, (g, h) in spans)
        return [None if x is None else next(records) for x in ids]

    def learn(self, stretches: set[str]) -> None:
        if len(self.known) > CACHE:
            self.known = dict(islice(self.known.items(), CACHE // 2))
        new = [s for s in stretches if s not in self.known]
        if new:
            self.known.update(zip(new, self.measure(new), strict=True))


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker and pair of files."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


def stretches_of(text: str) -> list[str]:
    """Parts between spaces at which both tokenizers start a token."""
    return CUT.split(text) if LOOSE.search(text) else text.split(" ")


class Chunk:
    """Documents whose distinct stretches are numbered."""

    def __init__(self, own: Aligner):
        self.own, self.number, self.records, self.forms = own, {}, [], []
        self.ids, self.shas, self.texts, self.chars = [], [], [], 0
        #: Numbers of stretches whose bytes differ from their tokens'.
        self.differ: set[int] = set()

    def keep(self, record: tuple | None) -> int:
        if record is None:
            self.differ.add(len(self.records))
        self.records.append(record or (b"", b"", 0, 0, 0))
        self.forms.append(self.records[-1][1])
        return len(self.records) - 1

    def add(self, ids: list, texts: list[str | None]) -> None:
        own, number = self.own, self.number
        cut = [stretches_of(t) if t else [] for t in texts]
        new = set().union(*cut).difference(number)
        own.learn(new)
        for s in new:
            number[s] = self.keep(own.known[s])
            if len(s) > LONGEST:
                del own.known[s]
        whole, form = {}, self.forms.__getitem__
        for text, parts in zip(texts, cut, strict=True):
            found = list(map(number.__getitem__, parts))
            if self.differ and not self.differ.isdisjoint(found):
                # the bytes of a part differ, so those of the whole are looked at
                if text not in whole:
                    whole[text] = [] if (record := own.measure([text])[0]) is None else [self.keep(record)]
                found = whole[text]
            self.texts.append(np.array(found, np.uint32))
            self.shas.append(hashlib.sha256(b";".join(map(form, found))).hexdigest() if found else "")
            self.chars += len(text or "")
        self.ids += ids

    def row(self, chunk: int) -> dict:
        records = self.records
        links = np.frombuffer(b"".join([r[0] for r in records]), self.own.dtype).astype(U)
        counts = np.array([[len(r[0]) // self.own.dtype().itemsize, *r[2:]] for r in records], np.int64).reshape(-1, 4)
        at, sizes = np.concatenate([np.zeros(0, np.uint32), *self.texts]), np.array([len(t) for t in self.texts], np.int64)
        times = np.bincount(at, minlength=len(records)).astype(np.int64)
        pairs, place = np.unique(links, return_inverse=True)
        n = np.bincount(place, np.repeat(times, counts[:, 0]).astype(np.float64), len(pairs)).astype(np.int64)
        # stretches of texts that have no tokens are in no document
        used = n > 0
        place = np.where(used[place], np.cumsum(used)[place] - 1, 0) if len(place) else place
        sums = np.stack([added(counts[:, k][at], sizes) for k in range(4)])
        return {
            "chunk": [chunk], "n_pairs": [int(used.sum())], "ids": [self.ids], "shas": [self.shas], "sums": [pack_bits(sums)],
            "at": [pack_bits(at)], "sizes": [pack_bits(sizes)], "place": [pack_bits(place.astype(np.uint32))], "links": [pack_bits(counts[:, 0])], "live": [pack_bits(times > 0)],
            "pairs": [pack_bits(pairs[used])], "n": [pack_bits(n[used])],
        }


def added(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; runs may be empty."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    h = pairs * U(0x9E3779B97F4A7C15)
    return ((h ^ (h >> U(31))) % U(buckets)).astype(np.int64)


def chunks_of(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """A row for each chunk of documents: their stretches by number, the links of each stretch, and the distinct pairs with their counts."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        number, open_ = TaskContext.get().partitionId() << 32, Chunk(aligner(path_a, path_b))
        for batch in batches:
            ids, texts = batch.column("__id").to_pylist(), batch.column("__text").to_pylist()
            for at in range(0, len(ids), DOCS):
                open_.add(ids[at : at + DOCS], texts[at : at + DOCS])
                if open_.chars >= CHUNK_CHARS:
                    yield open_.row(number)
                    number, open_ = number + 1, Chunk(open_.own)
        if open_.ids:
            yield open_.row(number)

    blobs = ", ".join(f"{c} binary" for c in ("sums", "at", "sizes", "place", "links", "live", "pairs", "n"))
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return materialise(map_batches(source, run, f"chunk long, n_pairs long, ids array<{id_type}>, shas array<string>, {blobs}"), "aligned-chunks")


def added_up(chunks: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, totals) for what each chunk sent to a bucket, and a row for each bucket with its distinct ``pairs`` and their ``totals``."""

    def send(batches):
        for batch in batches:
            for chunk, pairs, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "n")), strict=True):
                pairs, n = unpack_bits(pairs), unpack_bits(n, np.int64)
                bucket = bucket_of(pairs, buckets)
                order = np.argsort(bucket, kind="stable")
                ends = np.cumsum(np.bincount(bucket, minlength=buckets))
                for b, some in enumerate(np.split(order, ends[:-1])):
                    if len(some):
                        yield {"bucket": [b], "chunk": [chunk], "pairs": [pack_bits(pairs[some])], "n": [pack_bits(n[some])]}

    def merge(table: pa.Table) -> pa.Table:
        sent = [unpack_bits(p) for p in table.column("pairs").to_pylist()]
        n = np.concatenate([unpack_bits(x, np.int64) for x in table.column("n").to_pylist()])
        pairs, place = np.unique(np.concatenate(sent), return_inverse=True)
        totals = np.zeros(len(pairs), np.int64)
        np.add.at(totals, place, n)
        back = np.split(totals[place], np.cumsum([len(s) for s in sent])[:-1])
        bucket, rows = table.column("bucket")[0].as_py(), len(sent)
        return pa.table({
            "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()), "bucket": pa.array([bucket] * (rows + 1), pa.int64()),
            "pairs": pa.array([None] * rows + [pack_bits(pairs)], pa.binary()), "totals": pa.array([*map(pack_bits, back), pack_bits(totals)], pa.binary()),
        })

    sent = map_batches(chunks.select("chunk", "pairs", "n"), send, "bucket long, chunk long, pairs binary, n binary")
    return materialise(sent.groupBy("bucket").applyInArrow(merge, "chunk long, bucket long, pairs binary, totals binary"), "pair-totals")


def buckets_for(chunks: DataFrame) -> int:
    return max(1, -(-(chunks.agg(F.sum("n_pairs")).first()[0] or 0) // BUCKET_PAIRS))


def pair_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n): how many links of all documents hold A's id a and B's id b linked."""
    size_b = aligner(path_a, path_b).size_b
    chunks = chunks_of(docs, path_a, path_b, id_col, text_col)

    def rows(batches):
        for batch in batches:
            for pairs, totals in zip(batch.column("pairs").to_pylist(), batch.column("totals").to_pylist(), strict=True):
                pairs = unpack_bits(pairs).astype(np.int64)
                yield {"a": (pairs // size_b).astype(np.int32), "b": (pairs % size_b).astype(np.int32), "n": unpack_bits(totals, np.int64)}

    return map_batches(added_up(chunks, buckets_for(chunks)).filter("chunk IS NULL").select("pairs", "totals"), rows, "a int, b int, n long")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, b, groups) of each row: the ids of both tokenizers, and for each group how many of each it holds."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = aligner(path_a, path_b)
        for batch in batches:
            a, b, groups = [], [], []
            for text in batch.column("__text").to_pylist():
                ids = (own.encode([text])[0] if text else None) or ([], [])
                a.append(ids[0])
                b.append(ids[1])
                x, y = np.array(ids[0], np.int64), np.array(ids[1], np.int64)
                first, last = overlaps(own.a_lengths[x], own.b_lengths[y])
                ends = group_ends(first, last, len(y))
                group = np.cumsum(ends) - ends
                n = int(ends.sum())
                each = zip(np.bincount(group[first], minlength=n).tolist(), np.bincount(group, minlength=n).tolist(), strict=True) if n else ()
                groups.append([{"n_a": p, "n_b": q} for p, q in each])
            yield {"doc_id": batch.column("__id"), "a": a, "b": b, "groups": groups}

    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return map_batches(source, run, f"doc_id {id_type}, a array<int>, b array<int>, groups array<struct<n_a int, n_b int>>")


def alignment_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    ``n_best``: links whose pair is the most frequent one of its B id in the corpus; ``count_sum``: the corpus counts of all links.
    """
    spark, id_type, size_b = docs.sparkSession, docs.schema[id_col].dataType.simpleString(), aligner(path_a, path_b).size_b
    chunks = chunks_of(docs, path_a, path_b, id_col, text_col)
    buckets = buckets_for(chunks)
    merged = added_up(chunks, buckets)

    def highest(batches):
        most = np.zeros(size_b, np.int64)
        for batch in batches:
            for pairs, totals in zip(batch.column("pairs").to_pylist(), batch.column("totals").to_pylist(), strict=True):
                np.maximum.at(most, (unpack_bits(pairs) % U(size_b)).astype(np.int64), unpack_bits(totals, np.int64))
        at = np.flatnonzero(most)
        yield {"b": at, "most": most[at]}

    each = map_batches(merged.filter("chunk IS NULL").select("pairs", "totals"), highest, "b long, most long").groupBy("b").agg(F.max("most").alias("most"))
    most = np.zeros(size_b, np.int64)
    for r in each.collect():  # one row for each id of B's vocabulary at most
        most[r["b"]] = r["most"]
    best = spark.sparkContext.broadcast(most)

    def finish(batches):
        for batch in batches:
            for r in batch.to_pylist():
                pairs, totals = unpack_bits(r["pairs"]), np.zeros(r["n_pairs"], np.int64)
                bucket = bucket_of(pairs, buckets)
                for sent in r["sent"] or []:
                    totals[bucket == sent["bucket"]] = unpack_bits(sent["totals"], np.int64)
                place, links = unpack_bits(r["place"], np.uint32), unpack_bits(r["links"], np.int64)
                live = np.repeat(unpack_bits(r["live"], bool), links)
                top = totals == best.value[(pairs % U(size_b)).astype(np.int64)]
                look = lambda values: np.where(live, values[place], 0) if len(values) else np.zeros(len(place), np.int64)
                at, sizes = unpack_bits(r["at"], np.uint32), unpack_bits(r["sizes"], np.int64)
                n_links, n_a, n_b, n_groups = unpack_bits(r["sums"], np.int64).reshape(4, -1)
                n_best, count_sum = (added(added(look(v), links)[at], sizes) for v in (top, totals))
                yield {"doc_id": r["ids"], "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "n_best": n_best, "count_sum": count_sum, "groups_sha256": r["shas"]}

    back = merged.filter("chunk IS NOT NULL").groupBy(F.col("chunk").alias("__chunk")).agg(F.collect_list(F.struct("bucket", "totals")).alias("sent"))
    # chunks are large rows and what comes back grows with them, so neither side is broadcast at any size
    whole = chunks.drop("n").join(back.hint("merge"), F.col("chunk") == F.col("__chunk"), "left").drop("__chunk")
    return map_batches(whole, finish, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return alignment_counts(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
