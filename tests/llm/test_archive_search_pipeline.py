"""WARC archive, nearest neighbours and the pipeline."""

import hashlib
import math
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import vptree, warc_store

SF = "/root/testdata/sf0.001"


def test_warc_round_trip(spark, tmp_path):
    long = "<html>" + "é" * 80
    rows = [(4, "http://a", long), (2, "http://b", long), (2, "http://b", long), (9, "http://c\r\nX: y", long), (1, None, None), (3, "http://d", "short"), (5, "http://e", "short"), (None, "http://f", long), (None, None, "<p>" + "z" * 200), (6, "u", "x" * 100), (7, "u", "x" * 100), (8, "", ""), (10, "http://a/%0A%25\n%0D", "x" * 3_000_000), (11, "http://a/%0A%25", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/warc"
    warc_store.write_archive(pages, path)
    got = warc_store.read_archive(spark, path).collect()
    assert all(r.verified for r in got)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    first = {}
    for p, _, t in rows:
        if p is not None and len((t or "").encode()) >= 100:
            first[digest(t)] = min(p, first.get(digest(t), p))
    expected = Counter()
    for p, _, t in rows:
        f = first.get(digest(t))
        again = f is not None and p != f
        expected[p, len((t or "").encode()), digest(t), "revisit" if again else "response", f if again else None] += 1
    number = lambda x: None if x is None else int(x)
    assert Counter((number(r.page), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in got) == expected
    # each payload is stored once; a response's record ends with its payload, and its lengths add up
    assert spark.read.parquet(f"{path}/payloads").count() == len({digest(t) for *_, t in rows})
    assert Counter(r.url for r in got) == Counter(u for _, u, _ in rows)
    assert len({r.record_id for r in got}) == len(rows)
    by_record = {r.record_id: r for r in got}
    for r in got:
        assert (r.record_type == "revisit") == (r.refers_to_record is not None)
        if r.refers_to_record:
            assert by_record[r.refers_to_record].page == r.refers_to and by_record[r.refers_to_record].record_type == "response"
            assert f"WARC-Profile: {warc_store.PROFILE}".encode() in bytes(r.record)
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")).split(b": ")[1])
        assert len(rest) == length + 4 and rest.endswith(b"\r\n\r\n")
        if r.record_type == "response":
            assert rest[:-4].endswith(b"\r\n\r\n" + bytes(r.payload))
    warc_store.write_archive(pages.limit(0), f"{path}-none")
    assert warc_store.read_archive(spark, f"{path}-none").count() == 0


def test_warc_of_a_damaged_payload(spark, tmp_path):
    path = f"file://{tmp_path}/damaged"
    warc_store.write_archive(spark.createDataFrame([(1, "u", "a" * 200), (2, "u", "b" * 200), (3, "u", "c" * 200)], "page_id long, url string, html string"), path)
    kept = spark.read.parquet(f"{path}/payloads")
    last = F.col("payload").startswith(F.lit(b"b"))
    # one payload's bytes are other ones now, one is gone
    kept = kept.filter(~F.col("payload").startswith(F.lit(b"c"))).withColumn("payload", F.when(last, F.lit(b"spoiled")).otherwise(F.col("payload")))
    kept.write.parquet(f"{path}-2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-2/headers")
    assert {(r.page, r.verified) for r in warc_store.read_archive(spark, f"{path}-2").collect()} == {("1", True), ("2", False), ("3", False)}
    with pytest.raises(Exception, match="does not have its digest"):
        warc_store.checked(warc_store.read_archive(spark, f"{path}-2")).collect()


def brute(rows, k, asked):
    usable = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 4]
    out = {}
    for q, a in usable:
        if asked(q):
            scored = sorted(((-float(np.cumsum(a * b)[-1]), i) for i, b in usable if i != q))
            out.setdefault(q, [(i, -s) for s, i in scored[:k]])
    return out


def test_vptree_is_exact_at_factor_one(spark):
    rng = random.Random(9)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(4)]) for i in range(700)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)]
    rows += [(2000, None), (2001, [0.0] * 4), (2002, [float("nan"), 1.0, 1.0, 1.0]), (2003, [1.0, None, 1.0, 1.0]), (2004, [float("inf"), 1.0, 1.0, 1.0]), (2005, [1.0, 2.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, id int").repartition(4)
    expected = brute(rows, 20, lambda q: q % 20 == 0)
    for shard_rows in (150, 10_000):
        got = {}
        for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, k=20, shard_rows=shard_rows, block_rows=16).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == expected
    loose = vptree.nearest(df, F.col("vec_id") % 20 == 0, k=20, factor=0.7)
    hits = sum(1 for r in loose.collect() if r.vec_id in {i for i, _ in expected[r.query_id]})
    assert hits >= 0.9 * sum(map(len, expected.values()))
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert vptree.nearest(few, F.lit(True), k=20).count() == 6
    assert vptree.nearest(few.limit(0), F.lit(True)).count() == 0


def test_vptree_of_unlike_vectors_with_equal_scores(spark, monkeypatch):
    """Quantised, sparse vectors: hundreds of different ones tie, and the smaller ids come first."""
    rng = random.Random(4)
    rows = [(i, [1.0, *(float(rng.randrange(-9, 10)) for _ in range(3))]) for i in range(1, 500)]
    rows += [(600 + i, [float(rng.randrange(-1, 2)) for _ in range(4)]) for i in range(300)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0]) for i in (0, 1000, 1020)] + [(1040, [0.125, 0.25, 0.5, 0.0]), (1060, [0.0, 0.0, 2.0**-10, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    expected = brute(rows, 20, lambda q: q % 20 == 0)
    assert [i for i, _ in expected[0]] == list(range(1, 21))
    for shard_rows, together in ((60, 1), (60, 4), (10_000, 32)):
        monkeypatch.setattr(vptree, "SHARDS", together)
        monkeypatch.setattr(vptree, "LEAF", 16)
        got = {}
        for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, k=20, shard_rows=shard_rows, block_rows=8).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == expected


def test_vptree_leaves_out_cells_of_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(0, 0.05, (3000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    asked, wide = np.arange(0, 3000, 20), x.astype(np.float64)
    for factor, least, most in ((1.0, 1.0, 0.5), (0.9, 0.9, 0.5)):
        got = vptree.nearest(df, F.col("vec_id") % 20 == 0, k=10, factor=factor, shard_rows=250, block_rows=64)
        found = {(r.query_id, r.vec_id) for r in got.collect()}
        exact = set()
        for q in asked:
            scores = wide @ wide[q]
            scores[q] = -np.inf
            exact |= {(int(q), int(i)) for i in np.lexsort((np.arange(3000), -scores))[:10]}
        assert len(found & exact) >= least * len(exact)
        visited = vptree.nearest(df, F.col("vec_id") % 20 == 0, k=10, factor=factor, shard_rows=250, block_rows=64, with_visits=True).agg(F.sum("visited")).first()[0]
        assert visited <= most * len(asked) * 3000, visited / len(asked) / 3000


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"file://{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and len(now) >= 0.7 * len(ids)
        ids = now
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in out.select("doc_id").collect()} == ids
    assert corpus_pipeline.run(spark, SF).count() == len(ids)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels.get(i, 0) for i in ids) <= 0.5 * sum(labels.values())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_pipeline_of_hard_rows(spark, tmp_path):
    """Nulls in all columns, repeated rows, ties, a very long text, and columns whose names the operators use."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    item, near = text(40), text(120).split()
    rows = [(i, f"{text(60)}\nThe SAME line\n{text(20)}") for i in range(12)]
    rows += [(20, None), (21, ""), (None, text(30)), (None, None), (22, "x" * 200_000), (23, text(60_000)), (24, f"a {item} b"), (25, " ".join(near)), (26, " ".join([*near[:-1], "other"])), (27, " ".join(near))]
    rows += [rows[3], rows[3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_dropped string, score double, component_id long, ids long, kept binary"
    own = (7, "mine", 0.5, 1, 2, b"k")
    docs = spark.createDataFrame([(i, t, None if k % 2 else "en", None, None if t is None else len(t), *(own if k % 3 else (None,) * 6)) for k, (i, t) in enumerate(rows)], schema)
    sf = str(tmp_path)
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"file://{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(None, 1, 1), (25, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"file://{sf}/labels.parquet")
    sf = f"file://{sf}"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(f"{sf}/out-{name}")
        before, docs = docs, spark.read.parquet(f"{sf}/out-{name}")
        assert docs.dtypes == before.dtypes
        if name == "line_dedup":
            # one of thirteen occurrences stays, and the other columns are as they were
            assert docs.filter("text LIKE '%SAME%'").select("doc_id").distinct().count() == 1
            others = [c for c in docs.columns if c not in ("text", "n_chars")]
            assert Counter(map(tuple, docs.select(others).collect())) == Counter(map(tuple, before.select(others).collect()))
            assert docs.filter("n_chars <> length(text)").count() == 0
    kept = Counter(r.doc_id for r in docs.select("doc_id").collect())
    # of equal and near texts the smallest id stays (rows that repeat it with it, as those of no id), the benchmark's holder goes; empty texts are copies of one another
    assert kept == Counter([*range(12), 3, 3, 20, 22, 23, 25, None, None])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert Counter(r.doc_id for r in out) == kept and all(r.n_tokens == len(r.ids) for r in out)
