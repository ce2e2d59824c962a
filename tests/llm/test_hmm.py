"""The hidden Markov model against sums over all state paths, and its counts against plain counting."""

import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import hmm


def random_model(rng, states, symbols):
    row = lambda *shape: (x := rng.random(shape) + 0.05) / x.sum(-1, keepdims=True)
    return row(states), row(states, states), row(states, symbols)


def paths(sequence, start, move, emit):
    """(probability, path) of every state path."""
    for path in product(range(len(start)), repeat=len(sequence)):
        p = start[path[0]] * emit[path[0], sequence[0]]
        for t in range(1, len(sequence)):
            p *= move[path[t - 1], path[t]] * emit[path[t], sequence[t]]
        yield p, path


def test_recursion_is_the_sum_over_all_paths():
    rng = np.random.default_rng(5)
    start, move, emit = random_model(rng, 3, 7)
    sequences = [rng.integers(0, 7, n).tolist() for n in (1, 6, 3, 1, 5, 6, 2)]
    sizes = np.array(list(map(len, sequences)))
    steps = hmm.Steps.of(np.concatenate(sequences), sizes)
    scale, *_ = hmm.forward(steps, start, move, emit)
    got = np.bincount(steps.who, np.log10(scale), len(sequences))
    want, starts, moved, emitted = [], np.zeros(3), np.zeros((3, 3)), np.zeros((3, 7))
    for s in sequences:
        each = list(paths(s, start, move, emit))
        whole = sum(p for p, _ in each)
        want.append(math.log10(whole))
        for p, path in each:
            starts[path[0]] += p / whole
            for a, b in zip(path, path[1:], strict=False):
                moved[a, b] += p / whole
            for k, x in zip(path, s, strict=True):
                emitted[k, x] += p / whole
    assert got == pytest.approx(want)
    a, b, c, likelihood = hmm.expected(steps, start, move, emit)
    assert (a, b, c) == (pytest.approx(starts), pytest.approx(moved), pytest.approx(emitted))
    assert likelihood == pytest.approx(sum(want))


def corpus(seed, n=300):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        kind, words = rng.randrange(3), []
        for _ in range(rng.randint(1, 60)):
            words.append(f"{'abc'[kind]}{int(rng.paretovariate(0.7)) % 80}{rng.choice(['en', 'ly', 'Ing'])}")
        docs.append((i, rng.choice([" ", "\n", "\x0b "]).join(words)))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \n"), (None, "a1en zz"), (n + 3, "É\x85x É"), docs[3], (n + 4, "a1en " * 3000)]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("small", [False, True])
def test_counts_and_likelihoods(spark, monkeypatch, small):
    if small:
        for name, value in {"CHUNK_BYTES": 2000, "BUCKET_WORDS": 50, "BATCH_TOKENS": 300, "FAN": 2}.items():
            monkeypatch.setattr(hmm, name, value)
    docs = corpus(1)
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score long").repartition(5)
    chunks = hmm.prepare(frame, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    model = hmm.train(chunks, n_states=3, frequent=20, endings=8, iterations=4)
    split = lambda t: [*(t or "").encode().lower().split(), b""]
    count = Counter(w for i, t in docs if not held(i) for w in split(t))
    n, v = sum(count.values()), len(count)
    assert (model.train_tokens, model.distinct) == (n, v)
    assert all(b >= a - 1e-3 * abs(a) for a, b in zip(model.course, model.course[1:], strict=False))
    # the model's own probability of each text, by hand
    members = {}
    for w, x in count.items():
        members.setdefault(int(model.classes.of([w])[0]), []).append(x)

    def likelihood(words):
        kinds = model.classes.of(words)
        total, alpha = 0.0, None
        for w, k in zip(words, kinds, strict=True):
            mine = members.get(int(k), [])
            share = 1.0 if w in model.classes.frequent else (count[w] + 0.5) / (sum(mine) + 0.5 * (len(mine) + 1))
            alpha = (model.start if alpha is None else alpha @ model.move) * model.emit[:, k]
            total += math.log10(share) + math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        return total

    got = sorted(map(tuple, hmm.score(chunks, model).collect()), key=repr)
    want = []
    for i, t in docs:
        words = split(t)
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want.append((i, held(i), len(words), sum(count[w] > 0 for w in words), n, base, likelihood(words)))
    want.sort(key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [x for g in got for x in g[5:]] == pytest.approx([x for w in want for x in w[5:]])


def test_a_class_and_its_unknown_word_share_all_probability():
    classes = hmm.Classes({b"": 0, b"the": 1}, 2, np.array([5.0, 9.0, 7.0, 0.0]), np.array([1.0, 1.0, 3.0, 0.0]))
    assert sum(classes.share(np.array([2, 2, 2, 2]), np.array([4, 2, 1, 0]))) == pytest.approx(1)
    assert classes.share(np.array([3, 1]), np.array([0, 9])).tolist() == [1, 1]
    assert classes.prior().sum() == pytest.approx(1)


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    chunks = hmm.prepare(spark.createDataFrame(corpus(2, 900), "doc_id long, text string"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    model = hmm.train(chunks, n_states=6, frequent=200, endings=64, iterations=8)
    rows = hmm.score(chunks, model).filter("held_out AND n_tokens > 5 AND n_tokens < 3000").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.2 * sum(r.n_tokens for r in rows)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    chunks = hmm.prepare(docs, F.lit(True))
    rows = hmm.score(chunks, hmm.train(chunks, n_states=2, iterations=2)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in rows} == {(1, 3, 0, 0), (2, 1, 0, 0)}
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    none = hmm.prepare(docs.limit(0), F.lit(False))
    assert hmm.score(none, hmm.train(none, n_states=2, iterations=2)).count() == 0


def test_other_documents_than_those_learnt_from(spark):
    learnt = hmm.prepare(spark.createDataFrame([(1, "a b c a"), (2, "a c")], "doc_id long, text string"), F.lit(False))
    others = hmm.prepare(spark.createDataFrame([(7, "a z"), (8, "c c")], "doc_id long, text string"), F.lit(True))
    rows = {r.doc_id: r for r in hmm.score(others, hmm.train(learnt, n_states=2, iterations=1)).collect()}
    assert (rows[7].n_known, rows[8].n_known, rows[7].train_tokens) == (2, 3, 8)
