"""Ranked search against a plain scorer of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from tessera.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, tf) for i, tf in held if tf]
    n_docs, total = len(held), sum(sum(tf.values()) for _, tf in held)
    df = Counter(t for _, tf in held for t in tf)
    wanted, rows = {}, []
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    for item, mine in wanted.items():
        scored = []
        for i, tf in held:
            m = 10 + (90 * sum(tf.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in mine if t in tf)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        rows += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return rows


def corpus(seed, n=400):
    rng = random.Random(seed)
    word = lambda topic: f"t{topic}x{int(rng.paretovariate(1.0)) % 60}" if rng.random() < 0.6 else f"w{int(rng.paretovariate(0.8)) % 400}"
    docs = [(i, " ".join(word(i % 5) for _ in range(rng.randint(1, 120)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "... !"), (None, "w1 w2 t1x3"), (None, "w1 w2 t1x3"), (n + 3, "É_é W1-w1 日本"), *docs[5:25], *((n + 10 + i, docs[7][1]) for i in range(30))]
    items = [(i, " ".join(word(i % 5) for _ in range(rng.randint(1, 40)))) for i in range(20)]
    items += [(50, None), (51, "nothingthere"), (52, docs[7][1]), (53, "É 日本"), (None, "w1 w2"), (None, "t1x3"), items[0]]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("entries", [200_000, 60])
def test_same_as_scoring_everything(spark, monkeypatch, entries):
    for name, value in {"BLOCK_DOCS": 90, "ENTRIES": entries}.items():
        monkeypatch.setattr(ranked_search, name, value)
    docs, items = corpus(1)
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score long").repartition(3)
    wanted = spark.createDataFrame(items, "item_id long, text string")
    index = ranked_search.build_index(frame, cluster_docs=16)
    got = [tuple(r) for r in ranked_search.search(index, wanted, k=7).collect()]
    assert Counter(got) == Counter(brute_force(docs, items, 7))


def test_stops_before_clusters_that_cannot_matter(spark):
    """Topics in clusters: a search for words of one topic leaves most clusters out."""
    rng = random.Random(2)
    docs = [(i, " ".join(f"t{i % 8}x{rng.randrange(40)}" for _ in range(60)) + " common") for i in range(1600)]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(0, "t3x1 t3x2 common"), (1, "t5x9 common")], "item_id long, text string")
    index = ranked_search.build_index(frame, cluster_docs=50)
    visited = sum(r.visited for r in ranked_search.search(index, items, with_visits=True).collect())
    assert visited <= 2 * index.clusters.count() / 3
    got = Counter(tuple(r) for r in ranked_search.search(index, items).collect())
    assert got == Counter(brute_force(docs, [(0, "t3x1 t3x2 common"), (1, "t5x9 common")], 10))


def test_bisection_parts_topics():
    rng = np.random.default_rng(0)
    topic = rng.permutation(np.arange(256) % 4)
    doc = np.repeat(np.arange(256), 30)
    term = topic[doc] * 50 + rng.integers(0, 50, len(doc))
    found = ranked_search.bisected(doc, term, 256, 64)
    assert sorted(np.concatenate(found).tolist()) == list(range(256))
    assert np.mean([np.bincount(topic[c]).max() / len(c) for c in found]) > 0.9


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(ranked_search.build_index(docs), items).count() == 0
    full = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ranked_search.search(ranked_search.build_index(full), items.limit(0)).count() == 0
    assert ranked_search.search(ranked_search.build_index(full), items).count() == 1


def test_sql_agrees(same):
    same(ranked_search.op12_search, ranked_search.OP12_SQL)
