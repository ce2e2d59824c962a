"""Alignment of two tokenizers against whole texts encoded by the libraries and all pairs of tokens compared."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tessera.llm import alignment
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_force(texts):
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    symbols = {s: i for i, s in enumerate(alignment.byte_symbols())}
    rows, links_of, count = [], [], Counter()
    for text in texts:
        a, b = (a_lib.encode(f" {text}", add_special_tokens=False).ids, b_lib.encode(text)) if text else ([], [])
        a_parts = [bytes(symbols[c] for c in a_lib.id_to_token(i)) for i in a]
        b_parts = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if text and not b"".join(a_parts) == b"".join(b_parts) == f" {text}".encode():
            a, b, a_parts, b_parts = [], [], [], []

        def spans(parts):
            ends = [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
            return list(zip([0, *ends[:-1]], ends, strict=False))

        x, y = spans(a_parts), spans(b_parts)
        links = [(i, j) for p, i in zip(x, a, strict=True) for q, j in zip(y, b, strict=True) if p[0] < q[1] and q[0] < p[1]]
        both = sorted({e for _, e in x} & {e for _, e in y})
        cut = lambda ids, where: [[i for i, (_, e) in zip(ids, where, strict=True) if lo < e <= hi] for lo, hi in zip([0, *both[:-1]], both, strict=False)]  # noqa: E731, B023
        form = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in zip(cut(a, x), cut(b, y), strict=True))
        rows.append([len(a), len(b), len(both), len(links), hashlib.sha256(form.encode()).hexdigest() if a else ""])
        links_of.append(links)
        count.update(links)
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [(*r[:4], sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), r[4]) for r, links in zip(rows, links_of, strict=True)], count


def texts():
    rng = random.Random(3)
    pool = ["the", "quick", "brown,", "naïve", "日本語", "\n", "\t", " ", "  ", "　", "▁", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "it's", "'s", "\x00", "\x1c", "\xa0", "é", "🙂", "A", "12345", "\r\n", "...", "​", "﻿", "word", "\u0085"]
    out = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "the the the", "x" * 3000]
    for _ in range(250):
        out.append(rng.choice(["", " ", "\n"]).join(rng.choice(pool) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(1, 30))))
    return out + out[20:40] + ["the quick brown, word " * 40]


@pytest.mark.parametrize("chunk_chars", [24_000_000, 400])
def test_counts_of_all_links(spark, monkeypatch, chunk_chars):
    monkeypatch.setattr(alignment, "CHUNK_CHARS", chunk_chars)
    monkeypatch.setattr(alignment, "DOCS", 7)
    monkeypatch.setattr(alignment, "BUCKET_PAIRS", 300)
    every = texts()
    docs = spark.createDataFrame([(i if i % 50 else None, t, i) for i, t in enumerate(every)], "doc_id long, text string, chunk long").repartition(3)
    want, count = brute_force(every)
    got = sorted(map(tuple, alignment.alignment_counts(docs, A, B).select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()))
    assert got == sorted(want)
    assert sum(w[0] == 0 for w in want) < len(want) / 2
    assert {(r.a, r.b): r.n for r in alignment.pair_counts(docs, A, B).collect()} == count


def test_groups_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "hello wonderful world"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.align(docs, A, B).collect()}
    assert sum(g.n_a for g in rows[1].groups) == len(rows[1].a) > 0
    assert sum(g.n_b for g in rows[1].groups) == len(rows[1].b) > 0
    assert (rows[2].a, rows[2].b, rows[2].groups) == ([], [], [])
    assert alignment.alignment_counts(docs.limit(0), A, B).count() == 0


def test_runs_and_gaps():
    # A: ab|c|de|f, B: a|bc|d|ef
    first, last = alignment.overlaps(np.array([2, 1, 2, 1]), np.array([1, 2, 1, 2]))
    assert list(zip(first, last, strict=True)) == [(0, 1), (1, 1), (2, 3), (3, 3)]
    assert alignment.group_ends(first, last, 4).tolist() == [False, True, False, True]
