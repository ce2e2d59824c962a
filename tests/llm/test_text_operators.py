"""Brute force, exact round trips and edge cases of the operators over texts."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, components, count_min, decontaminate, golay, license_scan, line_dedup, queries, repeat_filter, simhash, substring_dedup, token_store, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row string, key string, n int, score double"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "the of and alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def hard_texts():
    rng = random.Random(7)
    common = " ".join(rng.choices(WORDS, k=60))
    texts = [None, "", " \t\n", "one", "Two  words\x0b", common, common, f"start {common} end", common.upper(), "line\n" * 12 + "Tail", "É ü x 　 ß", "a" * 5000, "<|endoftext|> x<|startoftext|>"]
    texts += [" ".join(rng.choices(WORDS, k=rng.randint(1, 90))) + "\n Shared LINE \n" + str(i) for i in range(25)]
    texts += [" ".join(f"w{rng.randint(0, 9)}" for _ in range(400)) * 30]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = hard_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, "one"), (None, None), (5, texts[5])]
    return spark.createDataFrame([(*r, "x", "y", 1, 0.5) for r in rows], SCHEMA).repartition(3).cache()


def collected(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(same, name):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup(docs, keep_first):
    rows, where, first = collected(docs), defaultdict(set), {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    for d, t in rows:
        for line in (t or "").split("\n"):
            where[key(line)].add(d)
    hot = {k for k, ids in where.items() if k and len(ids) >= 10}
    assert hot == {"shared line"}
    first = {k: min((i for i in where[k] if i is not None), default=None) for k in hot}
    expected = Counter()
    for d, t in rows:
        kept, seen = [], set()
        for line in (lines := (t or "").split("\n")):
            k = key(line)
            if k not in hot or (keep_first and d == first[k] and k not in seen):
                kept.append(line)
            seen.add(k)
        expected[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    out = line_dedup.dedup_lines(docs, keep_first=keep_first)
    assert set(docs.columns) < set(out.columns)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()) == expected
    # a filter far too small suspects more and changes nothing
    small = line_dedup.dedup_lines(docs, keep_first=keep_first, max_filter_bits=1 << 16)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in small.collect()) == expected


@pytest.mark.parametrize(("size", "gram"), [(35, 20), (5, 3), (3, 3)])
def test_substring_dedup(docs, size, gram):
    rows = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in collected(docs)]
    n = Counter(tuple(w[i : i + size]) for _, w in rows for i in range(len(w) - size + 1))
    expected = Counter()
    for d, w in rows:
        gone = {i + o for i in range(len(w) - size + 1) if n[tuple(w[i : i + size])] > 1 for o in range(size)}
        expected[d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    for cells in (1 << 27, 1 << 16):
        out = substring_dedup.remove_repeats(docs, size=size, gram=gram, max_cells=cells)
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect()) == expected


def test_substring_dedup_of_one_row_key(docs, monkeypatch):
    """Rows that share their key keep apart what is repeated in each."""
    rows = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in collected(docs)]
    n = Counter(tuple(w[i : i + 5]) for _, w in rows for i in range(len(w) - 4))
    expected = Counter((d, sum(any(n[tuple(w[j : j + 5])] > 1 for j in range(max(0, i - 4), min(i, len(w) - 5) + 1)) for i in range(len(w)))) for d, w in rows)
    monkeypatch.setattr(substring_dedup, "row_key", lambda *_: F.lit(7).cast("long"))
    out = substring_dedup.remove_repeats(docs, size=5, gram=3, max_cells=1 << 16)
    assert Counter((r.doc_id, r.n_removed) for r in out.collect()) == expected


def test_count_min_never_underestimates(spark):
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    stream = np.repeat(hashes, rng.zipf(1.6, 4000).clip(1, 400))
    rng.shuffle(stream)
    whole, parts = count_min.Sketch(1 << 12, 2), []
    whole.add(stream)
    for piece in np.array_split(stream, 7):
        parts.append(count_min.Sketch(1 << 12, 2))
        parts[-1].add(piece)
    total = parts[0]
    for part in parts[1:]:
        total.merge(part)
    assert (total.counts == whole.counts).all()
    value, true = np.unique(stream, return_counts=True)
    over = whole.estimate(value).astype(int) - np.minimum(true, count_min.TOP)
    assert (over >= 0).all()
    # the usual bound: an estimate is too high by e * n / cells with a chance of e**-rows at most
    assert (over > np.e * len(stream) / whole.cells).mean() <= np.exp(-2)
    df = spark.createDataFrame([(int(h.view(np.int64)),) for h in stream], "h long").repartition(5)
    of = lambda batch: batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
    bits = count_min.gather_repeated(spark, count_min.build(of, df, 1 << 12, 2), 1 << 12, 2)
    assert (repeat_filter.suspected(bits.value, value) == (whole.estimate(value) > 1)).all()


def test_golay_code():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    near = golay.nearby(words, 23)
    assert ((near >= 0).sum(1) <= 6).all()
    # two words within two bits share a key; a word's own key is among those of any word one bit away
    other = words ^ (1 << rng.integers(0, 23, 2000)) ^ (1 << rng.integers(0, 23, 2000))
    assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(near, golay.nearby(other, 23), strict=True))
    one = words ^ (1 << rng.integers(0, 23, 2000))
    assert all(i in b for i, b in zip(golay.index(words), golay.nearby(one, 23), strict=True))


def test_simhash_links_are_all_pairs(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(60)] + [0]
    for _ in range(4):
        prints += [p ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 4))}) for p in prints[:60]]
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    assert got == {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}


def plain_fingerprint(text, n=3):
    """Shingle by shingle and bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_components(docs):
    rows = collected(docs)
    prints = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    ids = defaultdict(list)
    for (d, _), g in zip(rows, group, strict=True):
        ids[g].append(d)
    smallest = {g: min((i for i in x if i is not None), default=None) for g, x in ids.items()}
    expected = Counter((d, p - (1 << 64) if p >> 63 else p, smallest[g]) for (d, _), p, g in zip(rows, prints, group, strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == expected
    kept = simhash.keep_one(docs, n=3)
    assert {r.doc_id for r in kept.collect()} == set(smallest.values())
    assert kept.columns == docs.columns


def test_a_task_with_many_links_holds_few(spark):
    """One partition of far more links than a task may hold: it gives out parts, and the components are whole."""
    rng = random.Random(8)
    links = [(i, rng.randrange(max(0, i - 40), i)) for i in range(1, 900) if i % 300]
    table = spark.createDataFrame(links, "a long, b long").coalesce(1)
    found = {r.node: r.root for r in components.connected_components(table, 40).collect()}
    assert set(found) == {x for both in links for x in both} and len(set(found.values())) <= 3
    assert all(found[a] == found[b] for a, b in links)
    batch = pa.RecordBatch.from_pydict({"a": [a for a, _ in links], "b": [b for _, b in links]})
    assert max(len(part["a"]) for part in components.stars([batch], 40)) <= 82


def test_fuzzy_keys_meet_seldom_by_chance():
    """Of random fingerprints, hardly any two share a key: keys have 33 bits and more."""
    prints = np.random.default_rng(2).integers(0, 1 << 63, 20_000).astype(np.uint64)
    (row_a, key_a), (row_b, key_b) = simhash.fuzzy_keys(prints)
    left, right = np.unique(key_a, return_counts=True), np.unique(key_b, return_counts=True)
    both, i, j = np.intersect1d(left[0], right[0], return_indices=True)
    met = int((left[1][i] * right[1][j]).sum()) - len(prints) * 7  # each fingerprint meets itself once a kind
    assert met < 0.05 * len(prints)
    assert max(np.bincount(row_a).max(), np.bincount(row_b).max()) <= 72


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    links = spark.createDataFrame([*chain, *star, (5, 5)], "a long, b long").repartition(6)
    # in one task, and over rounds of many
    for local in (components.LOCAL, 60):
        roots = defaultdict(set)
        for r in components.connected_components(links, local).collect():
            roots[r.root].add(r.node)
        assert sorted(map(len, roots.values())) == [200, 301]
    assert components.connected_components(links.limit(0)).count() == 0


def test_bpe_equals_library(docs):
    from tokenizers import Tokenizer

    path = bpe.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    expected = Counter()
    for d, t in collected(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in bpe.digests(docs, path).collect()) == expected
    again = bpe.decode(bpe.encode(docs, path), path)
    assert Counter(sha(r.text) for r in again.collect()) == Counter(e[3] for e in expected.elements())


def test_bpe_backtracks():
    path = bpe.vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    own, library, rng = bpe.load(path), Tokenizer.from_file(path), random.Random(5)
    library.no_padding()
    library.no_truncation()
    for letters in ("abcdeinorstuéß", "aab", "ehtn", "日本語の", "0123456789.,-!"):
        words = ["".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(3000)]
        for word, e in zip(words, library.encode_batch(words, add_special_tokens=False), strict=True):
            assert own.encode(word).tolist() == e.ids


def test_bpe_of_every_code_point():
    """Alone, within a word and in upper-case company: planes 0 to 2 and 14, and the borders of the others."""
    from tokenizers import Tokenizer

    path = bpe.vocabulary("word_bpe_49k.json")
    own, library = bpe.load(path), Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000] + list(range(0xE0000, 0xE0200)) + [0xEFFFF, 0xF0000, 0x10FFFF]
    for at in range(0, len(points), 1000):
        texts = [f"{chr(c)} Ab{chr(c)}C1{chr(c)}" for c in points[at : at + 1000]]
        expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        found = [own.encode_stretch(t) if len(t) > 64 else own.encode(t).tolist() for t in texts]
        assert found == expected
        own.known.clear()
        own.pieces.clear()


def test_token_store_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = bpe.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    store = f"file://{tmp_path}/store"
    token_store.write_tokens(docs, store, path)
    got = sorted(token_store.read_tokens(spark, store).collect(), key=lambda r: r.start)
    expected = [(d, library.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in collected(docs)]
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((d, tuple(i)) for d, i in expected)
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(d for d, _ in expected if d is not None)
    start = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        start += r.n_tokens
    # any range of tokens can be read from the checkpoint before it
    every = [(r.doc_id, i) for r in got for i in r.ids]
    for begin, n in ((0, 1), (0, start), (5, 300), (start - 40, 1000), (start // 2, 129), (start, 5)):
        part = sorted(token_store.read_range(spark, store, begin, n).collect(), key=lambda r: r.start)
        assert [(r.doc_id, i) for r in part for i in r.ids] == every[begin : begin + n]
        assert [r.start for r in part] == [begin + sum(len(q.ids) for q in part[:k]) for k in range(len(part))]


def test_encoder_equals_library(monkeypatch):
    from tokenizers import Tokenizer

    path, rng = bpe.vocabulary("byte_bpe_50k.json"), random.Random(1)
    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    pieces = ["a", "b ", " ", "\n", "\n\n", "word", ".", ",", "é", "ß", "\t", "’", "'s", "12", " \n", "  ", "日", "x.\nY", "<|endoftext|>", "\r\n", "-", "Σ"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(20_000)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    # a memory far too small is forgotten all the time and changes nothing
    for cache in (token_store.CACHE, 50):
        monkeypatch.setattr(token_store, "CACHE", cache)
        own = token_store.Encoder(path)
        assert [np.frombuffer(i, own.dtype).tolist() for i in own.encode(texts, None)] == expected


def test_encoder_looks_up_each_stretch_once_a_batch():
    class Counting(dict):
        n = 0

        def __getitem__(self, key):
            Counting.n += 1
            return super().__getitem__(key)

        def get(self, key, default=None):
            Counting.n += 1
            return super().get(key, default)

    path = bpe.vocabulary("byte_bpe_50k.json")
    own = token_store.Encoder(path)
    own.known = Counting(own.known)
    # equal stretches, bare words before and after the same with marks, odd white space, a special token, empty and null texts
    texts = ["word other word, " * 400 + "end", "Other, other. é é! \nWord\nword, Ünder", " a", "a ", "a\n\n", "a \n b", "a  b", "x<|endoftext|> y", "\u00a0 a \u00a0", "", None]
    got = own.encode(texts * 2, 2)
    assert got == [own.pack([*own.library.encode(t or "", add_special_tokens=False).ids, 2]) for t in texts * 2]
    assert Counting.n < 100


def test_token_store_of_equal_ids(spark, tmp_path):
    """Null ids and one id's rows are dealt to several tasks, in order all the same."""
    from tokenizers import Tokenizer

    path, store = bpe.vocabulary("byte_bpe_50k.json"), f"file://{tmp_path}/equal"
    library = Tokenizer.from_file(path)
    texts = [f"text {i % 50} {'x ' * (i % 7)}" for i in range(400)]
    rows = [(None if i % 3 else 7 if i % 2 else i, t) for i, t in enumerate(texts)]
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), store, path)
    assert spark.read.parquet(f"{store}/blocks").select("part").distinct().count() > 1
    got = sorted(token_store.read_tokens(spark, store).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((d, (*library.encode(t, add_special_tokens=False).ids, 2)) for d, t in rows)


def test_huffman_lengths():
    counts = {i: 2**i for i in range(30)} | {100: 1}
    for bits in (5, 8, 18):
        lengths = token_store.code_lengths(counts, bits)
        assert max(lengths.values()) <= bits
        assert sum(2.0**-n for n in lengths.values()) == 1
    # without a limit that binds, the cost is Huffman's
    import heapq

    heap, cost = sorted(counts.values()), 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    free = token_store.code_lengths(counts, 40)
    assert sum(counts[i] * n for i, n in free.items()) == cost
    assert token_store.code_lengths({7: 3}) == {7: 1} and token_store.code_lengths({}) == {}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def test_decontaminate(spark, docs):
    rng = random.Random(11)
    item = [f"q{rng.randint(0, 10**6)}" for _ in range(40)]
    spoiled = [f"s{i}" if i % 6 == 2 else w for i, w in enumerate(item)]
    half, little = item[:25], item[:9]
    texts = {900: " ".join(["x"] * 7 + item).upper() + "!", 901: "lead, " + ", ".join(spoiled) + " tail", 902: " ".join(half), 903: "a " + " ".join(little) + " b" * 50, 904: " ".join(item[20:] + ["z"] * 30), None: " ".join(item)}
    more = docs.unionByName(spark.createDataFrame([(d, t, "", "", 0, 0.0) for d, t in texts.items()], SCHEMA))
    few = " ".join(little)
    more = more.unionByName(spark.createDataFrame([(905, f"a b {few.upper()}, c", "", "", 0, 0.0), (906, "zq0 " + " ".join(little[:8]), "", "", 0, 0.0)], SCHEMA))
    items = spark.createDataFrame([(1, " ".join(item), "c"), (1, " ".join(item), "c"), (2, None, "c"), (3, "too short", "c"), (4, few, "c"), (5, "zq0", "c")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_overlaps(more, items).collect()}
    # items of few words are found where they stand whole
    assert set(got) == {(900, 1), (901, 1), (902, 1), (904, 1), (None, 1), (900, 4), (902, 4), (903, 4), (905, 4), (None, 4), (906, 5)}
    assert got[905, 4].start_word == 2 and got[905, 4].overlap_words == 9
    assert got[900, 1].start_word == 7 and got[900, 1].similarity == 1.0
    assert got[901, 1].overlap_words == 20 and got[901, 1].similarity >= 0.8
    assert decontaminate.find_overlaps(more.limit(0), items).count() == 0
    assert decontaminate.find_overlaps(more, items.limit(0)).count() == 0


def fewest_spoilers(masks, upto):
    """For each number of words: the fewest substitutions that spoil every placement of every mask, over all placements of them."""
    span = max(m[-1] for m in masks) + 1
    looked_at = [(m[-1], sum(1 << (m[-1] - o) for o in m)) for m in masks]
    states, fewest = {0: 0}, [0]
    for n in range(1, upto + 1):
        after = {}
        for state, cost in states.items():
            for spoiled in (0, 1):
                s = (state << 1 | spoiled) & ((1 << span) - 1)
                if all(n <= last or s & bits for last, bits in looked_at):
                    after[s] = min(after.get(s, n), cost + spoiled)
        states = after
        fewest.append(min(states.values()))
    return fewest


def test_masks_lose_nothing():
    fewest = fewest_spoilers(decontaminate.MASKS, 200)
    assert all(fewest[n] > n // 5 for n in range(13, 201))
    # the same by trying all placements one by one, where they are few
    for n in range(13, 19):
        for gone in itertools.combinations(range(n), n // 5):
            assert any(not any(p + o in gone for o in m) for m in decontaminate.MASKS for p in range(n - m[-1]))


def test_decontaminate_finds_every_placement(spark):
    """The first 15 of 30 distinct words, three of them substituted at places of all kinds."""
    item = [f"w{i}" for i in range(30)]
    spots = [s for s in itertools.combinations(range(15), 3)]
    docs = spark.createDataFrame([(i, " ".join(["x", "y", *(f"s{k}" if k in s else w for k, w in enumerate(item[:15])), "z"])) for i, s in enumerate(spots)], "doc_id long, text string")
    found = decontaminate.find_overlaps(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {r.doc_id for r in found.collect()} == set(range(len(spots)))


def test_decontaminate_of_texts_that_repeat_themselves(spark):
    """Every place of such a text is an alignment; equal stretches are verified once, and the last of equals counts."""
    docs = spark.createDataFrame([(1, "word " * 3000), (2, "a b " * 500), (3, "x " + "word " * 20)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word " * 60), (2, "b a " * 15), (3, "word " * 14)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.overlap_words, r.matched_words) for r in decontaminate.find_overlaps(docs, items).collect()}
    assert got == {(1, 1): (2970, 30, 30), (1, 3): (2987, 13, 13), (2, 2): (985, 15, 15), (3, 3): (8, 13, 13)}


def test_decontaminate_equals_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    tests = {r.item_id: words_of(r.text) for r in items.collect()}
    expected = set()
    for r in docs.collect():
        w = words_of(r.text)
        for i, t in tests.items():
            n = min(len(t), max(13, -(-len(t) // 2)))
            starts = {p - q for p, x in enumerate(w) for q, y in enumerate(t) if x == y}
            for s in starts:
                same = [0 <= s + k < len(w) and w[s + k] == y for k, y in enumerate(t)]
                if any(sum(same[k : k + n]) >= 0.8 * n for k in range(len(t) - n + 1)):
                    expected.add((r.doc_id, i))
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(docs, items).collect()} == expected


def test_license_scan(spark, docs):
    notice = license_scan.TEMPLATES[1][1]
    cut = " ".join(notice.split()[:-2])
    texts = {1: "Released under the MIT License.\nUnder THE mit license", 2: f"intro\n\n{cut}\n\nmore words", 3: notice[: len(notice) // 3], 4: "CC-BY-NC 4.0; Apache License, Version 2.0", 5: None}
    df = spark.createDataFrame([(d, t, "", "", 0, 0.0) for d, t in texts.items()], SCHEMA)
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].score) == (2, 1, 5, "mit", 1.0)
    assert got[2].labels == "isc" and 0.8 <= got[2].score < 1 and got[2].first_word is None
    assert (got[3].labels, got[3].score) == ("", 0.0)
    assert got[4].base_labels == "apache-2,cc-by-nc"
    assert (got[5].n_words, got[5].n_base, got[5].labels) == (0, 0, "")
    assert license_scan.scan_licenses(docs).count() == docs.count()


def test_license_join_is_exact():
    rng = random.Random(2)
    vocabulary = [f"t{i}".encode() for i in range(40)]
    templates = [(f"l{k}", " ".join(w.decode() for w in rng.sample(vocabulary, rng.randint(3, 20)))) for k in range(12)]
    index = license_scan.Index(templates, {w: rng.randint(0, 5) for w in vocabulary}, 0.8)
    for _ in range(400):
        block = set(rng.sample([*vocabulary, b"other"], rng.randint(0, 35)))
        exact = {name: len(set(t.encode().split()) & block) / len(set(t.split())) for name, t in templates}
        assert index.matches(block) == {k: v for k, v in exact.items() if v >= 0.8 - 1e-12}


def toxic_rows(n=600):
    rng, rows = random.Random(4), []
    for i in range(n):
        bad = rng.random() < 0.3
        words = rng.choices(WORDS, k=30) + (["scumbag"] if bad else [])
        # the group is named more often in toxic texts, without being what makes them so
        if rng.random() < (0.8 if bad else 0.1):
            words.append("muslims")
        rng.shuffle(words)
        rows.append((i, " ".join(words), "", "", 0, 0.0, int(bad)))
    return rows


def test_toxicity_is_counterfactually_fair(spark):
    df = spark.createDataFrame(toxic_rows(), SCHEMA + ", toxic int")
    labels = df.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int"))
    probe = spark.createDataFrame([(1, "the of muslims alpha beta"), (2, "the of christians alpha beta"), (3, "you scumbag"), (4, None), (None, "")], "doc_id long, text string")
    gaps = {}
    for penalty in (0.0, 5.0):
        model = toxicity.train(df.drop("toxic"), labels, counterfactual=penalty, l2=1e-3)
        s = {r.doc_id: r.score for r in toxicity.score(probe, model).collect() if r.doc_id}
        gaps[penalty] = abs(np.log(s[1] / (1 - s[1])) - np.log(s[2] / (1 - s[2])))
        assert s[3] > 0.5 > s[4]
    assert gaps[5.0] < 0.5 * gaps[0.0]
    print(f"logit gap of two neutral mentions {gaps}")
    held = toxicity.score(df, model).withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).filter("held")
    assert held.filter((F.col("score") >= 0.5).cast("int") != F.col("toxic")).count() == 0


def test_swaps():
    text = "Women and men agree. The women left!\nOld muslims speak"
    got = toxicity.swaps(text)
    # women stand in two sentences, so swapping one of them takes nothing away
    assert got[0] == (set(), set())
    assert got[1] == (set(), set())
    partners = ["christians", "jews", "hindus", "buddhists", "catholics", "atheists"]
    assert got[2:] == [({"old", "muslims"}, {"young", p}) for p in partners]
    words = toxicity.words_of(text)
    for gone, come in got:
        before, after = (set(toxicity.feature_ids(w).tolist()) for w in (words, words - gone | come))
        assert tuple(set(x.tolist()) for x in toxicity.changed_features(words, gone, come)) == (before - after, after - before)
    assert toxicity.swaps(None) == toxicity.swaps("nobody is named") == []


def test_swaps_of_a_text_add_up():
    """The matrix of a text's swaps is the sum over its swaps one by one, and a very long text takes a moment."""
    import time

    text = "Women and men agree. The women left! Womenfolk stay.\nOld muslims speak. Old muslims speak. The christian church."
    words = toxicity.words_of(text)
    place = {int(f): k for k, f in enumerate(toxicity.feature_ids(set(toxicity.GROUP)))}
    want, n = np.zeros((len(place), len(place))), 0
    for gone, come in toxicity.swaps(text):
        less, more = toxicity.changed_features(words, gone, come)
        d = np.zeros(len(place))
        d[[place[f] for f in less.tolist()]], d[[place[f] for f in more.tolist()]] = -1, 1
        want, n = want + np.outer(d, d), n + bool(d.any())
    got = np.zeros_like(want)
    for at, signs, weight in toxicity.swap_products(text, words, place):
        got[np.ix_(at, at)] += weight * np.outer(signs, signs)
    assert got == pytest.approx(want / n)
    rng = random.Random(1)
    long = " ".join(f"the {rng.choice(['women', 'muslims', 'gay', 'young', 'black'])} of w{i} x{i} said so. And y{i} z{i}." for i in range(2000))
    began = time.process_time()
    assert sum(w for *_, w in toxicity.swap_products(long, toxicity.words_of(long), place)) == pytest.approx(1)
    assert time.process_time() - began < 2


def test_toxicity_scores_by_hand(spark):
    """Scores recomputed from the weights for words of all kinds, on long, empty and null texts."""
    import math

    texts = [None, "", "Alpha beta", "ALPHA, alphabet? betas_9 été", "alpha gamma " * 50_000, "x" * 100_000]
    names = ["walpha", "wbeta", "palph", "palpha", "palphab", "pbetas", "wgamma", "pété", "wété", "p" + "x" * 6]
    weights = {name: 0.1 * (k + 1) * (-1) ** k for k, name in enumerate(names)}
    signed = {h - (1 << 64) if (h := xxhash.xxh3_64_intdigest(n)) >> 63 else h: w for n, w in weights.items()}
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (signed, -0.3)).collect()}
    for i, text in enumerate(texts):
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        held = {f"w{w}" for w in words} | {f"p{w[:n]}" for w in words for n in (4, 5, 6) if len(w) >= n}
        z = -0.3 + sum(w for name, w in weights.items() if name in held)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


def test_toxicity_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    scored = toxicity.op10_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").select("score", "predicted", "y").collect()
    toxic, clean = [r.score for r in scored if r.y], [r.score for r in scored if r.y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    caught, named = sum(r.predicted for r in scored if r.y), sum(r.predicted for r in scored)
    print(f"AUC {auc:.4f}, precision {caught / named:.3f}, recall {caught / len(toxic):.3f} of {len(toxic)} in {len(scored)}")
    assert auc > 0.97 and caught >= 0.9 * len(toxic) and caught >= 0.9 * named


def test_toxicity_takes_one_row_of_an_id(spark):
    rows = [(r[0], r[1]) for r in toxic_rows(100)] + [(3, "again " * k) for k in range(200)]
    labels = spark.createDataFrame([(r[0], r[6]) for r in toxic_rows(100)], "doc_id long, toxic int")
    sample = toxicity.training_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, "doc_id", "text", "toxic", 1000, None)
    assert sample.count() == 100


def test_toxicity_without_labels(spark, docs):
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).filter("score >= 0.5").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_empty_tables(spark, docs, tmp_path):
    none, path = docs.limit(0), bpe.vocabulary("word_bpe_49k.json")
    assert line_dedup.dedup_lines(none).count() == substring_dedup.remove_repeats(none).count() == simhash.near_duplicates(none).count() == 0
    assert bpe.digests(none, path).count() == license_scan.scan_licenses(none).count() == 0
    store = f"file://{tmp_path}/empty"
    token_store.write_tokens(none, store, bpe.vocabulary("byte_bpe_50k.json"))
    assert token_store.read_tokens(spark, store).count() == 0
