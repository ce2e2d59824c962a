"""BPE encoding by backtracking and decoding with an offset table.

For each piece of text the Aho-Corasick automaton of all tokens gives the longest token at every place. The encoder
takes the longest match, keeps it if the pair with the token before is one that the merges
could leave side by side, else tries its next shorter prefix token, else steps back; a bit per place
stops it from trying a place twice. The result is exactly that of applying the merges, in linear time.
Decoding copies token strings out of one byte table by offsets.

Text is cut at single spaces and each distinct stretch is normalised and encoded once per Python
worker (a cache of bounded size), which changes nothing in the result: no piece spans white space. Stretches beyond ASCII are
normalised and cut into pieces by the vocabulary file's own normaliser and pre-tokenizer, whose Unicode tables differ from Python's.

Defined cases: a null or empty text has no tokens, an empty id list and an empty decoded text. Special
tokens' strings in a text become their ids. Rows are encoded one by one: repeated rows and null ids are kept. Very long
texts are encoded whole. An empty table gives an empty result. Other columns pass through
``encode``; working columns have names starting with ``__``.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches

#: Fixed by the vocabulary's pre-tokenizer, for ASCII in lower case.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
END = "</w>"
#: Symbols that end a word are moved to private code points, one per byte.
WORD_END = 0xE000
CACHE = 400_000
#: A rank after that of all merges.
NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file whose ids follow the order of its merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        library = Tokenizer.from_file(path)
        self.normalise, self.pieces_of = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        symbols = byte_symbols()
        self.inner = {b: s for b, s in enumerate(symbols)}
        self.last = {s: chr(WORD_END + b) for b, s in enumerate(symbols)}

        def own(token: str) -> str:
            if token.endswith(END) and len(token) > len(END):
                stem = token[: -len(END)]
                return stem[:-1] + self.last[stem[-1]]
            return token

        self.id_of = {own(t): i for t, i in vocab.items() if t not in self.special}
        size = max(max(vocab.values()), *self.special.values()) + 1
        self.length, self.split, self.pair = [0] * size, [(i, i) for i in range(size)], {}
        for token, i in self.id_of.items():
            self.length[i] = len(token)
        before = -1
        for left, right in merges:
            a, b, c = vocab[left], vocab[right], vocab[left.removesuffix(END) + right if left.endswith(END) and len(left) > len(END) else left + right]
            if c <= before:
                raise ValueError("token ids do not follow the order of the merges")
            before = c
            self.split[c], self.pair[a << 32 | b] = (a, b), c
        self.trie = ahocorasick.Automaton()
        for token, i in self.id_of.items():
            self.trie.add_word(token, i)
        self.trie.make_automaton()
        self.prefix: list[int] = [-1] * size
        for token, i in self.id_of.items():
            for n in range(len(token) - 1, 0, -1):
                if (shorter := self.id_of.get(token[:n])) is not None:
                    self.prefix[i] = shorter
                    break
        strings = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            strings[i] = token.encode() + b" "
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        self.table = np.frombuffer(b"".join(strings), np.uint8)
        self.decimal = [b"%d" % i for i in range(size)]
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}
        self.ends: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        #: Whether two tokens may stand side by side.
        self.fits: dict[int, bool] = {}

    def spine(self, token: int, side: int) -> list[int]:
        """The symbols that stand at one end of a token (0: left, 1: right) one after the other while the merges build it, and ``NEVER``."""
        found = self.ends[side].get(token)
        if found is None:
            found, at = [NEVER, token], token
            while (child := self.split[at][side]) != at:
                found.append(at := child)
            found = self.ends[side][token] = found[::-1]
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges, in their order, leave a and b side by side.

        They don't if two symbols that meet at the border merge before either is used up on its own side. Of
        merges of one rank the left one comes first, so the right symbol may be due at the same rank.
        """
        right, left, pair = self.spine(a, 1), self.spine(b, 0), self.pair
        i = j = 1
        x, y, used_x, used_y = right[0], left[0], right[1], left[1]
        while True:
            merged = pair.get(x << 32 | y)
            if merged is not None and merged < used_x and merged <= used_y:
                return False
            if used_x <= used_y:
                if used_x == NEVER:
                    return True
                i += 1
                x, used_x = used_x, right[i]
            else:
                j += 1
                y, used_y = used_y, left[j]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as byte symbols."""
        word = piece[:-1] + self.last[piece[-1]]
        whole = self.id_of.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        longest, length, prefix = [-1] * (n + 1), self.length, self.prefix
        # matches come by their end, so the last one that starts at a place is the longest there
        for end, token in self.trie.iter(word):
            longest[end + 1 - length[token]] = token
        open_at, tokens, at, token, fits = [True] * (n + 1), [], 0, longest[0], self.fits
        while token >= 0:
            end, good = at + length[token], True
            if tokens and open_at[end]:
                good = fits.get(both := tokens[-1] << 32 | token)
                if good is None:
                    if len(fits) >= CACHE:
                        fits.clear()
                    good = fits[both] = self.compatible(tokens[-1], token)
            if good and open_at[end]:
                tokens.append(token)
                at, token = end, longest[end]
            elif prefix[token] >= 0:
                token = prefix[token]
            else:
                open_at[at] = False
                token = tokens.pop()
                at -= length[token]
        return tokens

    def encode_stretch(self, text: str) -> list[int]:
        """Ids of a text without regard to the cache."""
        ids: list[int] = []
        for k, part in enumerate(self.cut.split(text) if self.cut and "<" in text else [text]):
            if k % 2:
                ids.append(self.special[part])
            else:
                if part.isascii():
                    pieces = [p.translate(self.inner) for p in PIECE.findall(part.lower())]
                else:
                    pieces = [p for p, _ in self.pieces_of(self.normalise(part))]
                for piece in pieces:
                    known = self.pieces.get(piece)
                    if known is None:
                        if len(self.pieces) >= CACHE:
                            self.pieces.clear()
                        known = self.encode_piece(piece)
                        if len(piece) <= 64:
                            self.pieces[piece] = known
                    ids += known
        return ids

    def encode(self, text: str) -> np.ndarray:
        known, stretches = self.known, text.split(" ")
        found = list(map(known.get, stretches))
        if None in found:
            if len(known) >= CACHE:
                known.clear()
            for i, stretch in enumerate(stretches):
                if found[i] is None:
                    ids = known.get(stretch)
                    if ids is None:
                        ids = array("I", self.encode_stretch(stretch)).tobytes()
                        if len(stretch) <= 64:
                            known[stretch] = ids
                    found[i] = ids
        return np.frombuffer(b"".join(found), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Token strings joined by one space."""
        if not len(ids):
            return b""
        starts = self.offsets[ids]
        lengths = self.offsets[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(lengths)
        # where each output byte comes from: steps of one, with a jump where the next token begins
        step = np.ones(ends[-1], np.int64)
        step[0] = starts[0]
        step[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
        return self.table[np.cumsum(step)[:-1]].tobytes()

    def ids_text(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.decimal.__getitem__, ids.tolist()))


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One encoder per Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text as an array column, added or replaced."""
    docs = docs.drop(out) if out != text_col else docs
    columns = docs.columns

    def run(batches):
        bpe = load(path)
        for batch in batches:
            yield {c: batch.column(c) for c in columns} | {"__ids": [bpe.encode(t or "").astype(np.int32) for t in batch.column("__text").to_pylist()]}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs.select("*", F.col(text_col).cast("string").alias("__text")), run, f"{schema}, __ids array<int>").withColumnRenamed("__ids", out)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``tokens`` with the decoded text of an id array column, added or replaced."""
    tokens = tokens.drop(out) if out != ids_col else tokens
    columns = tokens.columns

    def run(batches):
        bpe = load(path)
        for batch in batches:
            yield {c: batch.column(c) for c in columns} | {"__decoded": [bpe.decode(np.array(i or [], np.uint32)).decode() for i in batch.column("__in").to_pylist()]}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return map_batches(tokens.select("*", F.col(ids_col).alias("__in")), run, f"{schema}, __decoded string").withColumnRenamed("__decoded", out)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Ids and decoded text of each row as digests: encoded, then decoded from the ids, in one pass over the texts.

    ``with_ids`` adds the ids themselves.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = load(path)
        for batch in batches:
            n, ids_sha, text_sha, all_ids = [], [], [], []
            for text in batch.column("__text").to_pylist():
                ids = bpe.encode(text or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(bpe.ids_text(ids)).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            yield {"doc_id": batch.column("__id"), "n": n, "i": ids_sha, "d": text_sha} | ({"ids": all_ids} if with_ids else {})

    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return map_batches(source, run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary("word_bpe_49k.json"))
