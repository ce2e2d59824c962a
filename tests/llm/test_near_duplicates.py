"""The pipeline's near-duplicate stage against brute force."""

import random

import corpus_pipeline
import pytest
from tessera.llm import shingle_join


def brute_force(rows, n=5, threshold=0.8):
    """Smallest id of each component of all pairs that reach the similarity, by plain word tuples."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= threshold * len(a | b):
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    return {min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group)}


def texts(seed):
    """Chains of edits, a group of near copies, a passage shared by unlike texts, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage, out = [word() for _ in range(30)], ["", None, " \n", "one", "One", "a b c d", "a b c d e f", "a b c d e g"]
    for _ in range(25):
        now = [word() for _ in range(rng.randint(20, 150))]
        for _ in range(6):
            out.append(" ".join(now))
            now = list(now)
            for _ in range(rng.randint(1, 3)):
                now[rng.randrange(len(now))] = word()
    core = [word() for _ in range(120)]
    for _ in range(40):
        now = list(core)
        now[rng.randrange(len(now))] = word()
        out += [" ".join(now), " ".join(passage + [word() for _ in range(rng.randint(0, 40))])]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("bits", [1 << 28, 1 << 12])
def test_all_pairs_are_found(spark, bits):
    rows = texts(bits)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = shingle_join.near_duplicates(docs, max_filter_bits=bits).collect()
    assert len(found) == len(rows)
    assert {r.component_id for r in found} == brute_force(rows)


def test_all_pairs_are_found_in_rounds(spark, monkeypatch):
    """Few pivots and no pair that is few enough: rounds first, then what they left open."""
    monkeypatch.setattr(shingle_join, "PIVOTS", 2)
    monkeypatch.setattr(shingle_join, "FEW", 0)
    monkeypatch.setattr(shingle_join, "ROUNDS", 2)
    rows = texts(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.component_id for r in shingle_join.near_duplicates(docs).collect()} == brute_force(rows)


def test_stage_of_the_pipeline(spark):
    rows = texts(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == brute_force(rows)
