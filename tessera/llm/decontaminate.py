"""Benchmark decontamination with spaced seeds, in DataFrame operations only.

A seed hashes the words at a mask's offsets and ignores the words between them, so a substituted
word spoils only the seeds that look at it. Seeds of test items are joined with seeds of all documents; each
hit names an alignment (item, offset of the item in the document), and every alignment is verified word
by word: it counts where some window of ``max(min_words, share * item words)`` aligned words (at most the item) has
at least ``similarity`` of its words equal. Items of fewer than ``min_words`` words count where they stand whole and unchanged; their
seed has all their words.

The two masks of ``MASKS`` lose nothing at the default settings: in 13 words or more, no placement of substitutions that
leaves 0.8 of the words equal spoils all seeds (the tests search all placements).

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased, compared by 64-bit hash.

Defined cases: null or empty texts have no words and match nothing, and items without words are not sought. Rows with the
same document id are judged together (null is an id), and so are items; repeated rows change nothing. Very long texts are read
whole. An empty table gives an empty result. Columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, materialise

#: Offsets that a seed looks at.
MASKS = ((0, 1, 2, 3, 5), (0, 1, 4, 5, 6))
#: Seeds of test items and alignments up to this number are broadcast (32 bytes each, so 64 MB), and words of items up to the same bytes; more are joined by shuffle.
MAX_BROADCAST_SEEDS = 2_000_000


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.translate(text, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def seeds(df: DataFrame, keys: list[str], masks) -> DataFrame:
    """``keys``, ``__at`` (first word) and ``__seed`` for each mask at each word of ``__words``.

    One exploded row per word carries the words ahead of it; only longs are copied, never the array.
    """
    offsets = sorted({o for m in masks for o in m})
    n = F.greatest(F.size("__words") - min(max(m) for m in masks), F.lit(0))
    shifted = [F.slice("__words", o + 1, n).alias(f"h{o}") for o in offsets]
    rows = df.filter(F.size("__words") >= min(max(m) for m in masks) + 1).select(*keys, F.inline(F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("__at"), *shifted)))
    rows = rows.toDF(*keys, "__at", *(f"__h{o}" for o in offsets))
    # a mask that reaches past the end of the text has a null under it and no seed
    each = [F.when(F.col(f"__h{m[-1]}").isNotNull(), F.xxhash64(F.lit("-".join(map(str, m))), *(F.col(f"__h{o}") for o in m))) for m in masks]
    return rows.select(*keys, "__at", F.explode(F.array(*each)).alias("__seed")).filter(F.col("__seed").isNotNull())


def find_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_words: int = 13, share: float = 0.5, similarity: float = 0.8, masks=MASKS) -> DataFrame:
    """(doc_id, item_id, start_word, overlap_words, matched_words, similarity): the best overlap of each contaminated document with each item."""
    tests = items.select(F.col(item_id_col).alias("__item"), word_hashes(F.col(item_text_col)).alias("__words")).distinct()
    lengths = tests.select(F.size("__words").alias("n")).filter(f"n BETWEEN 1 AND {min_words - 1}").distinct().orderBy("n").collect()  # fewer than min_words rows
    whole = {r["n"]: tuple(range(r["n"])) for r in lengths}
    test_seeds = seeds(tests.filter(F.size("__words") >= min_words), ["__item"], masks)
    for n, mask in whole.items():
        test_seeds = test_seeds.unionByName(seeds(tests.filter(F.size("__words") == n), ["__item"], [mask]))
    test_seeds = test_seeds.select("__item", F.col("__at").alias("__item_at"), "__seed")
    if test_seeds.count() <= MAX_BROADCAST_SEEDS:
        test_seeds = F.broadcast(test_seeds)
    # texts are told apart by id and hash, so that many rows of one id (or of none) are no group
    source = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__hash"))
    hits = seeds(source.select("__doc", "__hash", word_hashes(F.col("__text")).alias("__words")), ["__doc", "__hash"], [*masks, *whole.values()]).join(test_seeds, "__seed")
    places = materialise(hits.select("__doc", "__hash", "__item", (F.col("__at") - F.col("__item_at")).alias("__shift")).distinct(), "alignments")

    test_words = tests.select(F.col("__item").alias("__test"), F.col("__words").alias("__test_words"))
    # 8 bytes a word and 64 a row
    if (test_words.agg(F.sum(F.size("__test_words") * 8 + 64)).first()[0] or 0) <= MAX_BROADCAST_SEEDS * 32:
        test_words = F.broadcast(test_words)
    sized = places.join(test_words, F.col("__item").eqNullSafe(F.col("__test"))).select("__doc", "__hash", F.struct("__item", "__shift", F.size("__test_words").alias("n")).alias("place"))
    per_doc = sized.groupBy(F.col("__doc").alias("__key"), F.col("__hash").alias("__key_hash")).agg(F.collect_set("place").alias("__places"))
    if places.count() <= MAX_BROADCAST_SEEDS:
        per_doc = F.broadcast(per_doc)
    # only texts with an alignment are read into words again, and none of the others moves
    found = source.join(per_doc, F.col("__doc").eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__key_hash"))).select("__doc", word_hashes(F.col("__text")).alias("__words"), "__places")
    # the stretch of the document under each alignment is cut out before the rows are multiplied
    cut = found.select(
        "__doc",
        F.explode(
            F.transform(
                "__places",
                lambda p: F.struct(p["__item"].alias("__item"), p["__shift"].alias("__shift"), F.slice("__words", F.greatest(p["__shift"], F.lit(0)) + 1, p["n"] + F.least(p["__shift"], F.lit(0))).alias("piece")),
            )
        ).alias("p"),
    ).select("__doc", "p.*")
    # where a document repeats itself, stretches that are equal are verified once, for the last of them, which is the one that counts among equals
    lead = F.greatest(-F.col("__shift"), F.lit(0))
    alike = cut.groupBy("__doc", "__item", lead.alias("__lead"), F.xxhash64("piece").alias("__piece_hash")).agg(F.max(F.struct("__shift", "piece")).alias("m"))
    aligned = alike.select("__doc", "__item", "m.*").join(test_words, F.col("__item").eqNullSafe(F.col("__test")))
    n = F.size("__test_words")
    length = F.least(n, F.greatest(F.lit(min_words), F.ceil(n * F.lit(share)).cast("int")))
    least = F.when(n < min_words, F.lit(1.0)).otherwise(F.lit(float(similarity)))
    equal = F.transform(F.col("__test_words"), lambda w, i: F.coalesce((F.get("piece", i - lead) == w).cast("int"), F.lit(0)))
    # counts of equal words up to each place, so that every window is one difference
    sums = F.aggregate("equal", F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    running = F.transform(F.sequence(F.lit(0), n - F.col("length")), lambda s: F.struct((F.get("sums", s + F.col("length")) - F.get("sums", s)).alias("matched"), (-s).alias("minus_start")))
    # the sum over all words bounds every window
    enough = F.aggregate("equal", F.lit(0), lambda a, x: a + x) >= F.col("least") * F.col("length")
    best = aligned.withColumn("length", length).withColumn("least", least).withColumn("equal", equal).filter(enough).withColumn("sums", sums).withColumn("best", F.array_max(running))
    overlaps = best.select(
        F.col("__doc").alias("doc_id"),
        F.col("__item").alias("item_id"),
        "least",
        F.struct((F.col("best.matched") / F.col("length")).alias("similarity"), F.col("best.matched").alias("matched_words"), F.col("length").alias("overlap_words"), (F.col("__shift") - F.col("best.minus_start")).alias("start_word")).alias("b"),
    ).filter(F.col("b.similarity") >= F.col("least"))
    return overlaps.groupBy("doc_id", "item_id").agg(F.max("b").alias("b")).select("doc_id", "item_id", *(F.col(f"b.{c}").cast("long").alias(c) for c in ("start_word", "overlap_words", "matched_words")), "b.similarity")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: All alignments of all words, without seeds.
OP8_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS dw FROM documents
), items AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS tw FROM benchmark
), t AS (
  SELECT row_number() OVER () AS item, *, len(tw) AS n, least(len(tw), greatest(13, CAST(ceil(len(tw) * 0.5) AS BIGINT))) AS length, CASE WHEN len(tw) < 13 THEN 1.0 ELSE 0.8 END AS least FROM items
), dp AS (
  SELECT row, unnest(dw) AS w, generate_subscripts(dw, 1) AS i FROM d
), tp AS (
  SELECT item, length, least, unnest(tw) AS w, generate_subscripts(tw, 1) AS i FROM t
), places AS (
  SELECT row, item, dp.i - tp.i AS shift FROM dp JOIN tp USING (w) GROUP BY row, item, shift HAVING count(*) >= any_value(least * length)
), aligned AS (
  SELECT doc_id, item_id, shift, n, length, least,
         list_transform(range(1, n + 1), lambda j: CASE WHEN j + shift >= 1 AND dw[j + shift] = tw[j] THEN 1 ELSE 0 END) AS equal
  FROM places JOIN t USING (item) JOIN d USING (row)
), windows AS (
  SELECT doc_id, item_id, shift + s AS start_word, length AS overlap_words, least, CAST(list_sum(list_slice(equal, s + 1, s + length)) AS BIGINT) AS matched_words,
         row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY list_sum(list_slice(equal, s + 1, s + length)) DESC, s) AS r
  FROM aligned, LATERAL (SELECT unnest(range(0, n - length + 1)) AS s)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched_words::DOUBLE / overlap_words DESC, matched_words DESC, overlap_words DESC, start_word DESC) AS place
  FROM windows WHERE r = 1 AND matched_words::DOUBLE / overlap_words >= least
)
SELECT doc_id, item_id, start_word, overlap_words, matched_words, matched_words::DOUBLE / overlap_words AS similarity FROM best WHERE place = 1
"""
