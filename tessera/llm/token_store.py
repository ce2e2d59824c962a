"""Token-id files: canonical length-limited Huffman codes in independent blocks.

Ids are counted over the whole corpus, the code lengths (at most ``MAX_BITS``) come from the counts by
package-merge, and the code book is stored as lengths only (canonical codes follow from them). A
dataset is a Parquet table of blocks in ascending document order, ``{path}/blocks``, and ``{path}/codebook``. A block holds
whole documents, each starting at a byte border, with the bit offset of every ``STEP``-th token of a
document as checkpoints, so a reader may begin at any checkpoint of any block (``read_range``). Decoding looks up ``MAX_BITS``
bits at a time in a table, for all checkpoints of a block at once.

Defined cases: a null or empty text has the end id only. Null document ids come first; rows with equal
ids are ordered by their tokens' checksum and length, and are dealt to several tasks if they are many. Very long texts are one document of one block. An empty table
gives empty files. Columns other than id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import byte_symbols, vocabulary
from tessera.llm.common import map_batches, materialise, work_path

MAX_BITS = 18
STEP = 128
BLOCK_TOKENS = 1 << 17
#: Stretches of text whose ids a Python worker remembers, their characters, and the longest one that is kept for later batches.
CACHE, CACHE_CHARS, LONGEST = 800_000, 12_000_000, 64
#: Documents encoded at a time.
DOCS = 1024
#: Bytes of ids that a task of the range partitioning gets.
PART_BYTES = 256 << 20
CUT = re.compile(r"(?<=\S) (?=\S)")
MARKS = ".,;:!?"
#: A stretch that is one word (Latin letters), perhaps after a line break and before a mark; else anything.
STRETCH = re.compile(r"(?:(\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]?)|([^ ]*))(?: |\Z)")

_LOADED: dict[str, Encoder] = {}


class Encoder:
    """The tokenizers library with a memory for stretches of text.

    The pre-tokenizer never joins what stands before a single space or line break between two visible characters with what
    follows, and a single line break is a piece of its own, so a text's ids are those of its stretches. Plain words (letters, perhaps one mark at
    the end) are one piece each and go straight to the library's BPE model; all else goes through the whole library. Arrow cuts the texts of a batch and puts
    their ids together, so only distinct stretches of a batch are Python objects.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        self.plain = {i: s for i, s in enumerate(byte_symbols())}
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.packed = [self.pack([i]) for i in range(self.size)]
        self.ends = {"": b""} | {m: self.pack(self.library.encode(m, add_special_tokens=False).ids) for m in MARKS}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.line = self.pack(self.library.encode("\n", add_special_tokens=False).ids)
        #: Ids of a stretch, with the space or line break before it, as bytes; None for stretches that white space makes part of others.
        self.known: dict[str, bytes | None] = {"\n": self.line}
        self.chars = 0

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def library_ids(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, stretches: list[str]) -> None:
        rest, known = [], self.known
        tokenize, packed, ends, join = self.model.tokenize, self.packed, self.ends, b"".join
        before, lead = {"": self.plain[32], "\n": ""}, {"": b"", "\n": self.line}
        for s, (line, word, mark, _) in zip(stretches, STRETCH.findall(" ".join(stretches)), strict=False):
            if mark and not line and (bare := known.get(word)):
                known[s] = bare + ends[mark]
            elif word:
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(self.plain)
                known[s] = lead[line] + join([packed[t.id] for t in tokenize(before[line] + word)]) + ends[mark]
            elif not (bare := s.removeprefix("\n")) or bare[0].isspace() or bare[-1].isspace():
                known[s] = None
            else:
                rest.append(s)
        known.update(zip(rest, self.library_ids([s if s[0] == "\n" else f" {s}" for s in rest]), strict=True))
        self.chars += sum(map(len, stretches))

    def forget(self) -> None:
        """Keeps the half that was met first, which holds the frequent words."""
        kept = ((s, ids) for s, ids in islice(self.known.items(), min(CACHE, len(self.known)) // 2) if len(s) <= LONGEST)
        self.known = dict(kept)
        self.chars = sum(map(len, self.known))

    def careful(self, text: str) -> bytes:
        """A text with longer runs of white space: cut only where that is safe."""
        return b"".join(self.library_ids([p if i == 0 else f" {p}" for i, p in enumerate(CUT.split(text))]))

    def encode(self, texts: list[str | None], end_id: int | None) -> list[bytes]:
        """Ids of each whole text as packed integers."""
        end, out, head = b"" if end_id is None else self.pack([end_id]), [], len(self.line)
        apart = ["\n\n\n", "\n\n ", *self.special]
        for at in range(0, len(texts), DOCS):
            batch = [t or "" for t in texts[at : at + DOCS]]
            # a line break before the text makes its first stretch like the others; its ids are cut off again
            parts = pc.split_pattern(pa.array([f"\n{t}".replace("\n", " \n")[1:] for t in batch], pa.large_string()), " ")
            coded = parts.values.dictionary_encode()
            some = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            if len(self.known) > CACHE or self.chars > CACHE_CHARS:
                self.forget()
            ids = list(map(self.known.get, some, repeat(False)))
            if new := [i for i, known in enumerate(ids) if known is False]:
                self.learn([some[i] for i in new])
                for i in new:
                    ids[i] = self.known[some[i]]
            found = pa.array(ids, pa.large_binary()).take(coded.indices)
            first = parts.offsets.to_numpy()
            unsafe = set((np.searchsorted(first, np.flatnonzero(found.is_null()), "right") - 1).tolist()) if found.null_count else ()
            data, byte_at = memoryview(found.buffers()[2] or b""), np.frombuffer(found.buffers()[1], np.int64)[first].tolist()
            for i, text in enumerate(batch):
                # of two line breaks before a visible character each is a piece of its own, others are not
                if i in unsafe or not text or text[0].isspace() or text.endswith("\n\n") or any(s in text for s in apart):
                    out.append(self.careful(text) + end)
                else:
                    out.append(bytes(data[byte_at[i] + head : byte_at[i + 1]]) + end)
        return out


def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def tokenise(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int | None) -> DataFrame:
    """(doc_id, n_tokens, crc, salt, ids, counts): ids as little-endian integers of two bytes where the vocabulary allows, else four.

    ``salt`` tells rows apart that are equal in all else. The last row of each task has its ``counts`` of ids instead of a document.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        own, row = encoder(path), TaskContext.get().partitionId() << 33
        width, total = own.dtype.itemsize, np.zeros(own.size, np.int64)
        for batch in batches:
            ids = own.encode(batch.column("__text").to_pylist(), end_id)
            total += np.bincount(np.frombuffer(b"".join(ids), own.dtype), minlength=own.size)
            yield {"doc_id": batch.column("__id"), "n_tokens": [len(i) // width for i in ids], "crc": list(map(zlib.crc32, ids)), "salt": range(row, row + len(ids)), "ids": ids, "counts": [None] * len(ids)}
            row += len(ids)
        yield {"doc_id": [None], "n_tokens": [None], "crc": [None], "salt": [None], "ids": [None], "counts": [total.tobytes()]}

    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return map_batches(source, run, f"doc_id {id_type}, n_tokens long, crc long, salt long, ids binary, counts binary")


def count_ids(tokens: DataFrame, size: int) -> dict[int, int]:
    """Occurrences of each id over all rows, added up from the tasks' counts; one row per id of the vocabulary comes back."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for counts in batch.column("counts").to_pylist():
                total += np.frombuffer(counts, np.int64)
        at = np.flatnonzero(total)
        yield {"id": at, "n": total[at]}

    counted = map_batches(tokens.filter("counts IS NOT NULL").select("counts"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counted.collect()}


def code_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Optimal lengths of at most ``max_bits``, by package-merge."""
    ids = sorted(counts, key=lambda i: (counts[i], i))
    n = len(ids)
    if n <= 1:
        return dict.fromkeys(ids, 1)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols don't fit in {max_bits} bits")
    weights = np.array([counts[i] for i in ids], np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(max_bits):
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < n)
        merged = both[order]
        even = len(merged) // 2 * 2
        packages = merged[:even:2] + merged[1:even:2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    return dict(zip(ids, lengths.tolist(), strict=True))


class Codebook:
    """Canonical codes: by length, then id."""

    def __init__(self, lengths: dict[int, int]):
        self.bits = max(lengths.values(), default=1)
        size = max(lengths, default=0) + 1
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.symbols, self.widths = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.uint8)
        code = before = 0
        for i in sorted(lengths, key=lambda i: (lengths[i], i)):
            n = lengths[i]
            code <<= n - before
            before = n
            self.code[i], self.length[i] = code, n
            first = code << (self.bits - n)
            self.symbols[first : first + (1 << (self.bits - n))] = i
            self.widths[first : first + (1 << (self.bits - n))] = n
            code += 1

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all documents one after the other, the first byte of each (and the end), and each token's bit within its document.

        ``counts``: tokens per document.
        """
        n = self.length[ids]
        ends = np.cumsum(n)
        before = np.concatenate([[0], ends])
        first_token = np.concatenate([[0], np.cumsum(counts)])
        doc_bits = before[first_token[1:]] - before[first_token[:-1]]
        doc_at = np.concatenate([[0], np.cumsum((doc_bits + 7) // 8)])
        within = before[:-1] - np.repeat(before[first_token[:-1]], counts)
        at = within + np.repeat(doc_at[:-1] * 8, counts)
        window = self.code[ids] << (32 - n - (at & 7)).astype(np.uint64)
        out = np.zeros(doc_at[-1] + 4)
        for lane in range(4):
            out += np.bincount((at >> 3) + lane, ((window >> np.uint64(24 - 8 * lane)) & np.uint64(255)).astype(np.float64), len(out))
        return out[: doc_at[-1]].astype(np.uint8), doc_at, within

    def decode(self, data: bytes, bit_at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of several runs of tokens, run after run; each starts at a bit and has a count."""
        raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint32)
        windows = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        order = np.argsort(-counts, kind="stable")
        at, left = bit_at[order].astype(np.int64), counts[order]
        start = (np.cumsum(counts) - counts)[order]
        out = np.zeros(int(counts.sum()), np.uint32)
        active = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), "left")
        for step, n in enumerate(active):
            place = at[:n]
            index = (windows[place >> 3] >> (32 - self.bits - (place & 7)).astype(np.uint32)) & np.uint32((1 << self.bits) - 1)
            out[start[:n] + step] = self.symbols[index]
            at[:n] += self.widths[index]
        return out


def binary_values(column: pa.BinaryArray, dtype: np.dtype) -> np.ndarray:
    """The bytes of all rows one after the other, without a copy."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(dtype) if len(column) else np.zeros(0, dtype)


def write_tokens(docs: DataFrame, path: str, vocab: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> None:
    """Tokenises ``docs`` and writes ``{path}/codebook`` and ``{path}/blocks``."""
    spark = docs.sparkSession
    tokens, dtype = materialise(tokenise(docs, vocab, id_col, text_col, end_id), "token-ids", compression="zstd"), encoder(vocab).dtype
    counts = count_ids(tokens, encoder(vocab).size)
    lengths = code_lengths(counts)
    spark.createDataFrame([(int(i), int(n)) for i, n in lengths.items()], "id long, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast(lengths)  # one entry per id of the vocabulary
    id_type = tokens.schema["doc_id"].dataType.simpleString()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), sum(counts.values()) * dtype.itemsize // PART_BYTES)
    # ids are read back for the range bounds, nothing is encoded twice; equal ids are ranged by what they are ordered by
    order = ["doc_id", "crc", "n_tokens", "salt"]
    ordered = tokens.filter("counts IS NULL").drop("counts").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def block(batches):
        from pyspark import TaskContext

        book, part, seq, held, size = Codebook(shared.value), TaskContext.get().partitionId(), 0, [], 0

        def close():
            doc_ids, counts, ids = pa.concat_arrays([d for d, *_ in held]), np.concatenate([n for _, n, _ in held]), np.concatenate([i for *_, i in held])
            data, doc_at, within = book.encode(ids, counts)
            first = np.cumsum(counts) - counts
            runs = (counts + STEP - 1) // STEP
            marks = np.repeat(first - (np.cumsum(runs) - runs) * STEP, runs) + np.arange(runs.sum()) * STEP
            return {"part": [part], "seq": [seq], "n_tokens": [size], "doc_ids": pa.ListArray.from_arrays([0, len(doc_ids)], doc_ids), "counts": [counts], "sizes": [np.diff(doc_at)], "marks": [within[marks].astype("<u4").tobytes()], "data": [data.tobytes()]}

        for batch in batches:
            counts, ids = batch.column("n_tokens").to_numpy(zero_copy_only=False), binary_values(batch.column("ids"), dtype)
            ends, at = np.cumsum(counts), 0
            while at < len(counts):
                done = int(ends[at - 1]) if at else 0
                # the document that fills the block is its last
                stop = min(len(counts), int(np.searchsorted(ends, done + BLOCK_TOKENS - size)) + 1)
                held.append((batch.column("doc_id").slice(at, stop - at), counts[at:stop], ids[done : ends[stop - 1]]))
                size, at = size + int(ends[stop - 1]) - done, stop
                if size >= BLOCK_TOKENS:
                    yield close()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield close()

    blocks = map_batches(ordered.select("doc_id", "n_tokens", "ids"), block, f"part int, seq int, n_tokens long, doc_ids array<{id_type}>, counts array<long>, sizes array<long>, marks binary, data binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def block_starts(blocks: DataFrame) -> DataFrame:
    """(part, seq, start): tokens before each block. Sums per part first, so the one ordered window has a row per part."""
    sizes = blocks.select("part", "seq", "n_tokens")
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return sizes.join(ahead, "part").select("part", "seq", (F.col("ahead") + inside).alias("start"))


def stored(spark: SparkSession, path: str):
    """Blocks with their starts, the broadcast code lengths, and the type of document ids."""
    blocks = spark.read.parquet(f"{path}/blocks")
    lengths = {r["id"]: r["bits"] for r in spark.read.parquet(f"{path}/codebook").collect()}  # one row per id of the vocabulary
    return blocks.join(block_starts(blocks), ["part", "seq"]), spark.sparkContext.broadcast(lengths), blocks.schema["doc_ids"].dataType.elementType.simpleString()


def rows_of(batches):
    """(start, document ids, tokens of each, tokens at each checkpoint, bit of each checkpoint, data) per block."""
    for batch in batches:
        lists = {c: batch.column(c) for c in ("doc_ids", "counts", "sizes")}
        for i, (start, marks, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("start", "marks", "data")), strict=True)):
            counts, sizes = (lists[c][i].values.to_numpy(zero_copy_only=False) for c in ("counts", "sizes"))
            runs = (counts + STEP - 1) // STEP
            bit_at = np.frombuffer(marks, "<u4").astype(np.int64) + np.repeat((np.cumsum(sizes) - sizes) * 8, runs)
            length = np.full(len(bit_at), STEP, np.int64)
            full = runs > 0
            length[np.cumsum(runs)[full] - 1] = (counts - (runs - 1) * STEP)[full]
            yield start, lists["doc_ids"][i].values, counts, length, bit_at, data


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) decoded from the files; ``start`` counts the ids of all documents before."""
    blocks, shared, id_type = stored(spark, path)

    def run(batches):
        book = Codebook(shared.value)
        for start, doc_ids, counts, length, bit_at, data in rows_of(batches):
            found = book.decode(data, bit_at, length).astype("<u4", copy=False)
            ends = np.cumsum(counts)
            pieces = [found[e - c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            out = {"doc_id": doc_ids, "start": start + ends - counts, "n_tokens": counts, "ids_crc32": list(map(zlib.crc32, pieces))}
            yield out | ({"ids": pieces} if with_ids else {})

    schema = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return map_batches(blocks, run, schema)


def read_range(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """(doc_id, start, ids) of the tokens ``start`` to ``start + length`` of the whole corpus, a row per document that has some.

    Only blocks that hold some are read, and only from the checkpoint at or before the first token to the last one wanted.
    """
    blocks, shared, id_type = stored(spark, path)
    wanted = blocks.filter((F.col("start") < start + length) & (F.col("start") + F.col("n_tokens") > start))

    def run(batches):
        book = Codebook(shared.value)
        for at, doc_ids, counts, n, bit_at, data in rows_of(batches):
            run_at = at + np.cumsum(n) - n
            doc_at = at + np.cumsum(counts) - counts
            some = np.flatnonzero((run_at < start + length) & (run_at + n > start))
            found = book.decode(data, bit_at[some], n[some])
            first = int(run_at[some[0]])
            # runs that follow one another are one stretch of tokens, cut at documents and at the ends of the range
            docs = np.flatnonzero((doc_at < start + length) & (doc_at + counts > start))
            low, high = np.maximum(doc_at[docs], start), np.minimum(doc_at[docs] + counts[docs], start + length)
            yield {"doc_id": doc_ids.take(pa.array(docs)), "start": low, "ids": [found[a - first : b - first].astype(np.int64) for a, b in zip(low.tolist(), high.tolist(), strict=True)]}

    return map_batches(wanted, run, f"doc_id {id_type}, start long, ids array<long>")


def op3_token_store(spark, sf_dir: str) -> DataFrame:
    path = work_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, path, with_ids=False)
