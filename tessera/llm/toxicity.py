"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and word beginnings. In every sentence of a labelled text that has identity
terms, these are swapped for each of the other terms of their group in turn; beside the log loss the model pays for the
square of every change of the text's logit, so a group's mere mention moves the score little. A swap changes features of identity terms only, of which there are a few hundred, so all swaps of all texts
enter the fit as one matrix of sums over pairs of these features, added up within tasks. Features are chosen by a
chi-square test over the training rows, with shuffled counts; the fit itself is over a bounded
sample (``max_train_rows``) of labelled ids, one row each. The border between the marks is put where the scores of
training rows, each from a fit without it, give the best F measure. Every document is scored over its whole text.

Defined cases: a null or empty text has no words and gets the score of the intercept. Labels with a
null id or null mark teach nothing; of several labels of one id the largest holds. Rows are scored
one by one, so repeated rows and null ids get scores of their own; a null id counts as held out. Without
usable labels, or with labels of one kind only, the score is the smoothed share of toxic rows. An
empty table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, materialise, pack_bits, sliced, unpack_bits

WORD = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"[.!?\n]+")
PREFIXES = (4, 5, 6)
#: Terms that may stand for one another in a neutral mention.
IDENTITY_GROUPS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["girl", "boy"], ["female", "male"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"], ["muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"],
    ["gay", "straight", "lesbian", "bisexual"], ["transgender", "cisgender"], ["black", "white", "asian", "latino"],
    ["african", "american", "european", "mexican", "chinese", "indian", "arab"], ["immigrants", "citizens", "refugees"], ["immigrant", "citizen", "refugee"],
    ["old", "young"], ["deaf", "blind", "disabled"],
    ["frauen", "männer"], ["femmes", "hommes"], ["mujeres", "hombres"],
]
GROUP = {w: (g, i) for g in IDENTITY_GROUPS for i, w in enumerate(g)}
STARTS = {w[: PREFIXES[0]] for w in GROUP}
#: Fits that leave a part of the training rows out, to find the border.
FOLDS = 3
#: Rows of each mark from which on a border is looked for; with fewer it stays at one half.
LEAST_MARKED = 50


def features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    return [xxhash.xxh3_64_intdigest(f"w{word}")] + [xxhash.xxh3_64_intdigest(f"p{word[:n]}") for n in PREFIXES if len(word) >= n]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def partner(word: str, k: int) -> str:
    """The ``k``-th other term of an identity term's group, round and round; any other word itself."""
    if word not in GROUP:
        return word
    group, i = GROUP[word]
    return group[(i + 1 + (k - 1) % (len(group) - 1)) % len(group)]


def swaps(text: str | None) -> list[tuple[set[str], set[str]]]:
    """(words that go, words that come) for the whole text, when the identity terms of one sentence are swapped: all sentences, all partners."""
    sentences = [set(WORD.findall(s)) for s in SENTENCE_END.split((text or "").lower())]
    named = [s for s in sentences if not s.isdisjoint(GROUP)]
    if not named:
        return []
    holds, found = Counter(w for s in sentences for w in s), []
    for sentence in named:
        terms = sentence & GROUP.keys()
        for k in range(1, max(len(GROUP[w][0]) for w in terms)):
            come = {partner(w, k) for w in terms}
            found.append(({w for w in terms - come if holds[w] == 1}, come - holds.keys()))
    return found


def by_start(words: set[str]) -> dict[str, list[str]]:
    """Words by their first letters; only those that begin like an identity term."""
    found: dict[str, list[str]] = {}
    for w in words:
        if (start := w[: PREFIXES[0]]) in STARTS:
            found.setdefault(start, []).append(w)
    return found


def changed_features(words: set[str] | dict[str, list[str]], gone: set[str], come: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the text that the swap takes away, and those it adds; ``words`` are the text's, perhaps by their first letters."""
    begins = words if isinstance(words, dict) else by_start(words)
    shared = {w for start in {g[: PREFIXES[0]] for g in gone | come} for w in begins.get(start, ()) if w not in gone}
    rest = feature_ids(shared)
    return np.setdiff1d(feature_ids(gone), np.union1d(rest, feature_ids(come))), np.setdiff1d(feature_ids(come), np.union1d(rest, feature_ids(gone)))


def feature_ids(words: set[str]) -> np.ndarray:
    return np.unique(np.array([f for w in words for f in features(w)], np.uint64)).astype(np.int64)


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train_rows: int, fold_off: int | None) -> DataFrame:
    """(text, y, fold) of about ``max_train_rows`` labelled ids at most, by a hash of the id; of several texts of an id, the first in order."""
    own = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).dropna().groupBy("__id").agg(F.max("__y").alias("__y"))
    if fold_off is not None:
        own = own.filter(F.crc32(F.col("__id").cast("string").cast("binary")) % 5 != fold_off)
    n = own.count()
    own = own.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int(min(1.0, max_train_rows / max(n, 1)) * (1 << 20)))
    # at most about max_train_rows small rows
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(own), F.col("__doc") == F.col("__id"))
    return materialise(texts.groupBy("__id").agg(F.min("text").alias("text"), F.max("__y").alias("y")).select("text", "y", F.pmod(F.xxhash64("__id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold")), "toxicity-sample")


def select_features(sample: DataFrame, n_features: int, least: int) -> np.ndarray:
    """Ids of the features with the largest chi-square against the label."""

    def count(batches):
        for batch in batches:
            parts = {0: [], 1: []}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                parts[int(y > 0)].append(feature_ids(words_of(text)))
            for y, arrays in parts.items():
                if arrays:
                    ids, n = np.unique(np.concatenate(arrays), return_counts=True)
                    yield {"f": ids, "n": n * (y == 0), "p": n * (y == 1)}

    counted = map_batches(sample.select("text", "y"), count, "f long, n long, p long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    n0, n1 = sample.agg(F.count_if(F.col("y") <= 0), F.count_if(F.col("y") > 0)).first()
    a, b = F.col("p"), F.col("n")
    chi = F.pow(a * F.lit(float(n0)) - b * F.lit(float(n1)), 2) / ((a + b) * F.lit(float(max(n0, 1)) * max(n1, 1)) + 1)
    top = counted.filter(a + b >= least).withColumn("chi", chi).orderBy(F.desc("chi"), "f").limit(n_features).select("f").collect()
    return np.array(sorted(r["f"] for r in top), np.int64)


def places(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each entry of a list of rows."""
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([np.zeros(0, np.int64), *lists])


def fit(rows: list[np.ndarray], swapped: tuple[np.ndarray, np.ndarray], y: np.ndarray, n_features: int, l2: float, counterfactual: float, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept. ``swapped``: features that swaps change, and for each pair of them the sum of the products of their changes; a row's swaps share its weight."""
    r, c = places(rows)
    at, products = swapped
    w, b = np.zeros(n_features), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    # the rarer mark weighs more, by the root of the ratio of the two
    weight = np.where(y > 0, np.sqrt(max(1.0, (len(y) - y.sum()) / max(y.sum(), 1))), 1.0)
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        z = np.bincount(r, w[c], len(rows)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / weight.sum()
        g = np.bincount(c, d[r], n_features) + l2 * w
        g[at] += 2 * counterfactual / len(y) * (products @ w[at])
        g = np.append(g, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def swap_products(text: str | None, words: set[str], place: dict[int, int]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(features by ``place``, their changes, weight) of each distinct swap of a text; the weights of a text's swaps that change something add up to one."""
    begins, found = by_start(words), []
    for (gone, come), n in Counter((frozenset(g), frozenset(c)) for g, c in swaps(text)).items():
        less, more = changed_features(begins, set(gone), set(come))
        signs = {place[f]: s for s, ids in ((-1.0, less), (1.0, more)) for f in ids.tolist() if f in place}
        if signs:
            found.append((np.array(list(signs)), np.array(list(signs.values())), n))
    total = sum(n for *_, n in found)
    return [(at, signs, n / total) for at, signs, n in found]


def border(z: np.ndarray, y: np.ndarray, recall_weight: float) -> float:
    """The logit from which on rows count as toxic, for the best F measure; half-way to the next row below."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    square = recall_weight**2
    f = (1 + square) * hits / (np.arange(1, len(z) + 1) + square * y.sum())
    best = int(f.argmax())
    return float((z[order[best]] + z[order[min(best + 1, len(z) - 1)]]) / 2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train_rows: int = 20_000, n_features: int = 4096, least: int = 4, l2: float = 1e-3, counterfactual: float = 1.0, recall_weight: float = 1.5, fold_off: int | None = 0) -> tuple[dict[int, float], float]:
    """Weights by feature hash, and the intercept. ``fold_off``: rows with this crc32 remainder of 5 are left out."""
    sample = training_sample(docs, labels, id_col, text_col, label_col, max_train_rows, fold_off)
    chosen = select_features(sample, n_features, least)

    at = np.flatnonzero(np.isin(chosen, feature_ids(set(GROUP))))
    place = {int(chosen[i]): k for k, i in enumerate(at)}

    def project(batches):
        products = np.zeros((FOLDS, len(at), len(at)))
        for batch in batches:
            own = []
            for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                words = words_of(text)
                own.append(np.flatnonzero(np.isin(chosen, feature_ids(words))).astype(np.int32).tobytes())
                for mine, signs, weight in swap_products(text, words, place):
                    products[fold][np.ix_(mine, mine)] += weight * np.outer(signs, signs)
            n = len(own)
            yield {"y": batch.column("y"), "fold": batch.column("fold"), "own": own, "products": [None] * n}
        yield {"y": [None], "fold": [None], "own": [None], "products": [pack_bits(products)]}

    # max_train_rows at most, and a matrix of a few hundred features from each task of that bounded sample
    got = map_batches(sample.select("text", "y", "fold"), project, "y int, fold int, own binary, products binary").collect() if len(chosen) else []
    products = sum((unpack_bits(bytes(r["products"]), np.float64).reshape(FOLDS, len(at), len(at)) for r in got if r["products"] is not None), np.zeros((FOLDS, len(at), len(at))))
    got = sorted((bytes(r["own"]), r["y"], r["fold"]) for r in got if r["own"] is not None)
    y = np.array([float(mark > 0) for _, mark, _ in got])
    if not len(y) or y.min() == y.max():
        return {}, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1)))
    rows, fold = [np.frombuffer(own, np.int32) for own, *_ in got], np.array([f for *_, f in got])
    w, b = fit(rows, (at, products.sum(0)), y, len(chosen), l2, counterfactual)
    if min(y.sum(), len(y) - y.sum()) >= LEAST_MARKED:
        z = np.empty(len(y))
        for k in range(FOLDS):
            kept = np.flatnonzero(fold != k)
            part = fit([rows[i] for i in kept], (at, products.sum(0) - products[k]), y[kept], len(chosen), l2, counterfactual)
            for i in np.flatnonzero(fold == k):
                z[i] = part[0][rows[i]].sum() + part[1]
        b -= border(z, y, recall_weight)
    return dict(zip(chosen.tolist(), w.tolist(), strict=True)), b


def score(docs: DataFrame, model: tuple[dict[int, float], float], text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text added (or replaced) as ``out``."""
    weights, intercept = model
    docs = docs.drop(out) if out != text_col else docs
    columns = docs.columns
    limit = 200_000

    def run(batches):
        known: dict[str, tuple] = {}
        for batch in sliced(batches):
            scores = []
            for text in batch.column("__text").to_pylist():
                found: set[int] = set()
                for word in words_of(text):
                    mine = known.get(word)
                    if mine is None:
                        if len(known) >= limit:
                            known.clear()
                        signed = (f - (1 << 64) if f >> 63 else f for f in features(word))
                        mine = known[word] = tuple(f for f in signed if f in weights)
                    if mine:
                        found.update(mine)
                scores.append(intercept + sum(map(weights.__getitem__, sorted(found))))
            z = np.clip(np.array(scores, np.float64), -700, 700)
            yield {c: batch.column(c) for c in columns} | {"__score": 1 / (1 + np.exp(-z))}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    scored = map_batches(docs.select("*", F.col(text_col).cast("string").alias("__text")), run, f"{schema}, __score double")
    return scored.withColumnRenamed("__score", out)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, train(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
