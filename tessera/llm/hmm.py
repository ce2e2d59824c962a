"""A hidden Markov language model: Baum-Welch over all training documents, exact likelihoods by the scaled forward recursion.

A text is its words and one end. Each state emits classes: the end and the most frequent words have one each, all other words share classes by their ending.
A word's probability in its class is its smoothed share, so the model is ``P(word | state) = P(class | state) P(word | class)``, with counts of all words of all
training documents. An iteration runs over all training documents: tasks gather expected counts of starts, transitions and emissions, these are added up in a tree, and the
driver gets one set of bounded size (states times classes).

Word counts are of any size and stay in the cluster: documents are gathered into chunks with their distinct words, words are added up in
buckets by hash, and a chunk asks each bucket once for the words it holds. A word of all chunks is one entry of each.

Defined cases: null, empty and blank texts are an end only. Case is that of ASCII, words are parted by ASCII white space. Rows are judged one by one, so repeated rows count each time.
Rows whose ``held_out`` is null count as held out. Very long texts are scored whole; training holds states times tokens of the longest text. Without training rows all words are unknown and all states alike. An empty table gives an
empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, map_batches, materialise, pack_bits, unpack_bits

#: Bytes of the texts of one chunk (the last text may exceed it), words that one bucket gets, tokens in one recursion (or one text), and parts that one task adds up.
CHUNK_BYTES, BUCKET_WORDS, BATCH_TOKENS, FAN = 24_000_000, 1_000_000, 1_000_000, 16
#: Stands for the end; words are never empty.
END = b""
SEED = 13


def pack_words(words: list[bytes]) -> bytes:
    return pack_bits(np.frombuffer(b"\n".join(words), np.uint8))


def unpack_words(data: bytes) -> list[bytes]:
    return unpack_bits(data, np.uint8).tobytes().split(b"\n")


def prepare(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each chunk of documents: ids, ``held`` marks, tokens by number of the chunk's distinct words, and the words' counts in training documents."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def row(chunk, number, ids, held, texts):
        words = sorted(number)
        rank = np.empty(len(words), np.uint32)
        rank[list(map(number.__getitem__, words))] = np.arange(len(words))
        sizes = np.array([len(t) for t in texts])
        tokens = rank[np.concatenate(texts)]
        n = np.bincount(tokens[np.repeat(~np.array(held), sizes)], minlength=len(words))
        return {"chunk": [chunk], "n_words": [len(words)], "ids": [ids], "held": [held], "sizes": [pack_bits(sizes)], "tokens": [pack_bits(tokens)], "words": [pack_words(words)], "n": [pack_bits(n)]}

    def run(batches):
        from pyspark import TaskContext

        chunk, number, ids, held, texts, size = TaskContext.get().partitionId() << 32, {END: 0}, [], [], [], 0
        for batch in batches:
            for id_, out, text in zip(*(batch.column(c).to_pylist() for c in ("__id", "__held", "__text")), strict=True):
                words = text.lower().split()
                found = list(map(number.get, words))
                if None in found:
                    for i, w in enumerate(words):
                        if found[i] is None:
                            found[i] = number.setdefault(w, len(number))
                ids.append(id_)
                held.append(out)
                texts.append(np.array([*found, 0], np.uint32))
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield row(chunk, number, ids, held, texts)
                    chunk, number, ids, held, texts, size = chunk + 1, {END: 0}, [], [], [], 0
        if ids:
            yield row(chunk, number, ids, held, texts)

    source = docs.select(F.col(id_col).alias("__id"), F.coalesce(held_out, F.lit(True)).alias("__held"), as_bytes(F.col(text_col)).alias("__text"))
    return materialise(map_batches(source, run, f"chunk long, n_words long, ids array<{id_type}>, held array<boolean>, sizes binary, tokens binary, words binary, n binary"), "word-chunks")


def send(parts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, words, n): the words of each row of ``parts`` (chunk, words, n) by hash."""

    def run(batches):
        for batch in batches:
            for chunk, words, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "n")), strict=True):
                words, n = unpack_words(words), unpack_bits(n, np.int64)
                bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
                order = np.argsort(bucket, kind="stable")
                for some in np.split(order, np.cumsum(np.bincount(bucket, minlength=buckets))[:-1]):
                    if len(some):
                        yield {"bucket": [int(bucket[some[0]])], "chunk": [chunk], "words": [pack_words([words[i] for i in some])], "n": [pack_bits(n[some])]}

    return map_batches(parts.select("chunk", "words", "n"), run, "bucket long, chunk long, words binary, n binary")


def vocabulary(chunks: DataFrame) -> DataFrame:
    """(chunk, words, n, n_words): a row for each bucket with its words of training documents and their counts; ``chunk`` is null."""
    buckets = max(1, -(-(chunks.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_WORDS))

    def merge(table: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        for words, n in zip(table.column("words").to_pylist(), table.column("n").to_pylist(), strict=True):
            for w, x in zip(unpack_words(words), unpack_bits(n, np.int64).tolist(), strict=True):
                if x:
                    total[w] = total.get(w, 0) + x
        own = sorted(total)
        rows = min(len(own), 1)
        return pa.table({
            "chunk": pa.array([None] * rows, pa.int64()), "words": pa.array([pack_words(own)] * rows, pa.binary()),
            "n": pa.array([pack_bits(np.array([total[w] for w in own], np.int64))] * rows, pa.binary()), "n_words": pa.array([len(own)] * rows, pa.int64()),
        })

    return materialise(send(chunks, buckets).groupBy("bucket").applyInArrow(merge, "chunk long, words binary, n binary, n_words long"), "vocabulary")


@dataclass
class Classes:
    """Classes of words and what is known of each; all of it has a bounded size."""

    frequent: dict[bytes, int]
    endings: int
    n: np.ndarray
    v: np.ndarray

    @property
    def size(self) -> int:
        return len(self.frequent) + self.endings

    def of(self, words: list[bytes]) -> np.ndarray:
        """A frequent word's own class, else one for the last three bytes and the kind of the first."""
        own, first, n = self.frequent, len(self.frequent), self.endings
        return np.array([c if (c := own.get(w)) is not None else first + zlib.crc32(w[-3:] + (b"9" if w[:1].isdigit() else b"")) % n for w in words], np.int64)

    def share(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(word | class): add-half over the class's words and one unknown; a frequent word is all of its class."""
        p = (counts + 0.5) / (self.n[classes] + 0.5 * (self.v[classes] + 1))
        return np.where(classes < len(self.frequent), 1.0, p)

    def prior(self) -> np.ndarray:
        """Smoothed shares of the classes."""
        mass = self.n + 0.5 * (self.v + 1)
        return mass / mass.sum()


@dataclass
class Model:
    """Word counts (unbounded, a table), and the recursion's parameters (bounded)."""

    words: DataFrame
    classes: Classes
    train_tokens: int
    distinct: int
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    #: log10 likelihood of the training documents' classes before each iteration.
    course: list[float]


def classes_of(words: DataFrame, frequent: int, endings: int) -> Classes:
    def top(batches):
        for batch in batches:
            for w, n in zip(batch.column("words").to_pylist(), batch.column("n").to_pylist(), strict=True):
                w, n = unpack_words(w), unpack_bits(n, np.int64)
                # words are in order, so equal counts are too
                most = np.argsort(-n, kind="stable")[:frequent]
                yield {"word": [w[i] for i in most], "n": n[most]}

    best = map_batches(words.select("words", "n"), top, "word binary, n long").orderBy(F.desc("n"), "word").limit(frequent).collect()  # frequent rows at most
    own = {END: 0}
    for r in best:
        own.setdefault(bytes(r["word"]), len(own))
    found = Classes(own, endings, np.zeros(0), np.zeros(0))

    def count(batches):
        n, v = np.zeros(found.size, np.int64), np.zeros(found.size, np.int64)
        for batch in batches:
            for w, x in zip(batch.column("words").to_pylist(), batch.column("n").to_pylist(), strict=True):
                c, x = found.of(unpack_words(w)), unpack_bits(x, np.int64)
                np.add.at(n, c, x)
                v += np.bincount(c, minlength=found.size)
        at = np.flatnonzero(v)
        yield {"class": at, "n": n[at], "v": v[at]}

    n, v = np.zeros(found.size), np.zeros(found.size)
    for r in map_batches(words.select("words", "n"), count, "class long, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # a row a class
        n[r["class"]], v[r["class"]] = r["n"], r["v"]
    return Classes(own, endings, n, v)


class Steps:
    """Sequences side by side: all first symbols, then all second ones, the longest sequence first."""

    def __init__(self, symbols: np.ndarray, active: np.ndarray, who: np.ndarray | None = None):
        #: ``active``: sequences that have a symbol at each step; ``who``: the sequence of each symbol.
        self.symbols, self.active, self.who = symbols, active, who
        self.at = np.concatenate([[0], np.cumsum(active)]).tolist()

    @classmethod
    def of(cls, symbols: np.ndarray, sizes: np.ndarray) -> Steps:
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(sizes), np.int64)
        rank[order] = np.arange(len(sizes))
        active = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")
        at = np.concatenate([[0], np.cumsum(active)])
        place = at[np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] + np.repeat(rank, sizes)
        ordered, who = np.empty_like(symbols), np.empty(len(symbols), np.int64)
        ordered[place], who[place] = symbols, np.repeat(np.arange(len(sizes)), sizes)
        return cls(ordered, active, who)


def forward(steps: Steps, start: np.ndarray, move: np.ndarray, emit: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """The scale of each symbol (its probability, given those before); if kept, the scaled forward probabilities and the scaled emissions too."""
    emitted, scale, now, one = np.ascontiguousarray(emit.T), np.empty(len(steps.symbols), emit.dtype), None, np.ones(len(start), emit.dtype)
    alpha, scaled = (np.empty((len(steps.symbols), len(start)), emit.dtype) for _ in range(2)) if keep else (None, None)
    for t, n in enumerate(steps.active.tolist()):
        here = slice(steps.at[t], steps.at[t + 1])
        seen = emitted[steps.symbols[here]]
        now = seen * (start if t == 0 else now[:n] @ move)
        c = now @ one
        scale[here] = c
        c = (1 / c)[:, None]
        now *= c
        if keep:
            alpha[here] = now
            np.multiply(seen, c, out=scaled[here])
    return scale, alpha, scaled


def expected(steps: Steps, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, transitions and emissions, and the log10 likelihood."""
    scale, gamma, scaled = forward(steps, start, move, emit, keep=True)
    later, moved, back = 0, np.zeros(move.shape), np.ascontiguousarray(move.T)
    for t in range(len(steps.active) - 1, -1, -1):
        here, ahead = steps.at[t], steps.at[t + 1]
        if later:
            # ahead: scaled emissions times backward probabilities of the next step
            seen = scaled[ahead : ahead + later]
            moved += gamma[here : here + later].T @ seen
            beta = seen @ back
            gamma[here : here + later] *= beta
            scaled[here : here + later] *= beta
        later = ahead - here
    starts = gamma[: steps.at[1]].sum(0, dtype=np.float64) if len(steps.active) else np.zeros(len(start))
    emissions = np.stack([np.bincount(steps.symbols, gamma[:, k], emit.shape[1]) for k in range(len(start))])
    return starts, moved * move, emissions, float(np.log10(scale).sum(dtype=np.float64))


def batches_of(sizes: np.ndarray) -> list[np.ndarray]:
    """Places of sequences of about ``BATCH_TOKENS`` together, those of like length together."""
    order = np.argsort(-sizes, kind="stable")
    part = np.cumsum(sizes[order]) // BATCH_TOKENS
    return np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(order) else []


def picked(tokens: np.ndarray, sizes: np.ndarray, some: np.ndarray) -> np.ndarray:
    starts, n = (np.cumsum(sizes) - sizes)[some], sizes[some]
    return tokens[np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())]


def sequences(chunks: DataFrame, classes: Classes) -> DataFrame:
    """(symbols, active): the classes of training documents, step by step; a row for each batch of documents."""
    shared = chunks.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        for batch in batches:
            for held, sizes, tokens, words in zip(*(batch.column(c).to_pylist() for c in ("held", "sizes", "tokens", "words")), strict=True):
                sizes, kind = unpack_bits(sizes, np.int64), shared.value.of(unpack_words(words)).astype(np.uint16 if shared.value.size <= 1 << 16 else np.uint32)
                kind, mine = kind[unpack_bits(tokens, np.uint32)], np.flatnonzero(~np.array(held))
                for some in batches_of(sizes[mine]):
                    steps = Steps.of(picked(kind, sizes, mine[some]), sizes[mine[some]])
                    yield {"symbols": [pack_bits(steps.symbols)], "active": [pack_bits(steps.active.astype(np.uint32))]}

    return materialise(map_batches(chunks.select("held", "sizes", "tokens", "words"), run, "symbols binary, active binary"), "class-sequences")


def summed(parts: DataFrame) -> np.ndarray | None:
    """The sum of the vectors of all tasks, added up in a tree of ``FAN`` parts a task; one vector comes back."""

    def run(batches):
        total = None
        for batch in batches:
            for part in batch.column("sums").to_pylist():
                part = unpack_bits(part, np.float64)
                total = part if total is None else total + part
        if total is not None:
            yield {"sums": [pack_bits(total)]}

    n = parts.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // FAN)
        parts = map_batches(parts.repartition(n), run, "sums binary")
    rows = parts.collect()  # one row
    return sum(unpack_bits(bytes(r["sums"]), np.float64) for r in rows) if rows else None


def train(chunks: DataFrame, n_states: int = 12, frequent: int = 3000, endings: int = 1024, iterations: int = 6) -> Model:
    """Fits the model to the documents of ``chunks`` that are not held out."""
    spark, words = chunks.sparkSession, vocabulary(chunks)
    classes = classes_of(words, frequent, endings)
    totals = words.agg(F.sum("n_words")).first()[0] or 0
    rng, prior, size = np.random.default_rng(SEED), classes.prior(), classes.size
    start = np.full(n_states, 1 / n_states)
    move = np.full((n_states, n_states), 0.1 / n_states) + 0.9 * np.eye(n_states)
    emit = prior * rng.gamma(1.0, 1.0, (n_states, size)) + 1e-12
    emit /= emit.sum(1, keepdims=True)
    course, texts, kind = [], sequences(chunks, classes), np.uint16 if size <= 1 << 16 else np.uint32
    for _ in range(iterations):
        # the recursions of training are in single precision, their sums and all scores in double
        now: Broadcast = spark.sparkContext.broadcast(tuple(x.astype(np.float32) for x in (start, move, emit)))

        def gather(batches, now=now):
            sums = [np.zeros(x.shape) for x in now.value] + [0.0]
            for batch in batches:
                for symbols, active in zip(batch.column("symbols").to_pylist(), batch.column("active").to_pylist(), strict=True):
                    steps = Steps(unpack_bits(symbols, kind), unpack_bits(active, np.uint32).astype(np.int64))
                    sums = [a + b for a, b in zip(sums, expected(steps, *now.value), strict=True)]
            yield {"sums": [pack_bits(np.concatenate([np.ravel(s) for s in sums]))]}

        got = summed(map_batches(texts, gather, "sums binary"))
        if got is None or not got.any():
            break
        starts, moved, emissions = got[:n_states], got[n_states : n_states + n_states**2].reshape(n_states, n_states), got[n_states + n_states**2 : -1].reshape(n_states, size)
        course.append(float(got[-1]))
        start = (starts + 0.1) / (starts.sum() + 0.1 * n_states)
        move = (moved + 0.1) / (moved.sum(1, keepdims=True) + 0.1 * n_states)
        emit = (emissions + prior) / (emissions.sum(1, keepdims=True) + 1)
    return Model(words, classes, int(classes.n.sum()), totals, start, move, emit, course)


def word_counts(chunks: DataFrame, model: Model) -> DataFrame:
    """(chunk, sent): training counts of the words of each chunk, by bucket."""
    asked = chunks.select("chunk", "words", "n").unionByName(model.words.select("chunk", "words", "n"))
    buckets = buckets_of(chunks, model)

    def answer(table: pa.Table) -> pa.Table:
        known, asking = {}, []
        for chunk, words, n in zip(*(table.column(c).to_pylist() for c in ("chunk", "words", "n")), strict=True):
            if chunk is None:
                known.update(zip(unpack_words(words), unpack_bits(n, np.int64).tolist(), strict=True))
            else:
                asking.append((chunk, words))
        bucket = table.column("bucket")[0].as_py()
        return pa.table({
            "chunk": pa.array([c for c, _ in asking], pa.int64()), "bucket": pa.array([bucket] * len(asking), pa.int64()),
            "n": pa.array([pack_bits(np.array([known.get(w, 0) for w in unpack_words(words)], np.int64)) for _, words in asking], pa.binary()),
        })

    answered = send(asked, buckets).groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, n binary")
    return answered.groupBy(F.col("chunk").alias("__chunk")).agg(F.collect_list(F.struct("bucket", "n")).alias("sent"))


def buckets_of(chunks: DataFrame, model: Model) -> int:
    return max(1, -(-((chunks.agg(F.sum("n_words")).first()[0] or 0) + model.distinct) // BUCKET_WORDS))


def score(chunks: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document of ``chunks``."""
    spark, id_type = chunks.sparkSession, chunks.schema["ids"].dataType.elementType.simpleString()
    n_train, distinct, buckets = model.train_tokens, model.distinct, buckets_of(chunks, model)
    shared = spark.sparkContext.broadcast((model.classes, model.start, model.move, model.emit))

    def finish(batches):
        classes, start, move, emit = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                words, tokens, sizes = unpack_words(r["words"]), unpack_bits(r["tokens"], np.uint32), unpack_bits(r["sizes"], np.int64)
                bucket, counts = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets, np.zeros(len(words), np.int64)
                for sent in r["sent"] or []:
                    counts[bucket == sent["bucket"]] = unpack_bits(sent["n"], np.int64)
                kind, begin = classes.of(words), np.cumsum(sizes) - sizes
                each = lambda values: np.add.reduceat(values[tokens], begin)  # noqa: E731, B023
                likely = each(np.log10(classes.share(kind, counts)))
                for some in batches_of(sizes):
                    steps = Steps.of(picked(kind[tokens], sizes, some), sizes[some])
                    likely[some] += np.bincount(steps.who, np.log10(forward(steps, start, move, emit)[0]), len(some))
                base = each(np.log10((counts + 0.5) / (n_train + 0.5 * (distinct + 1))))
                yield {"doc_id": r["ids"], "held_out": r["held"], "n_tokens": sizes, "n_known": each((counts > 0).astype(np.int64)), "train_tokens": np.full(len(sizes), n_train), "base_score": base, "score": likely}

    whole = chunks.select("chunk", "ids", "held", "sizes", "tokens", "words").join(word_counts(chunks, model), F.col("chunk") == F.col("__chunk"), "left").drop("__chunk")
    return map_batches(whole, finish, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op13_hmm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chunks = prepare(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    return score(chunks, train(chunks))
