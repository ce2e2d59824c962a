"""Corpus preparation: toxicity, line dedup, near-dedup, decontamination, tokens.

Each stage takes all documents that the stage before kept and returns what it keeps, with the columns of
``documents``; the last returns the tokens. Stages are written and read again between one another, so a
lost executor costs the tasks of one stage. ``n_chars`` follows a rewritten text.

Defined cases are those of the operators: a null text counts as empty, rows with equal ids are judged
as each operator says, and an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, line_dedup, shingle_join, toxicity
from tessera.llm.common import work_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows among ``docs``."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, out="__toxicity").filter(F.col("__toxicity") < 0.5).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line found in ten documents or more, the first occurrence stays."""
    # columns of documents that have the names of the operator's counts step aside
    aside = {c: f"__own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(aside), min_docs=10, keep_first=True).drop("n_lines", "n_dropped")
    out = out.withColumnsRenamed({v: k for k, v in aside.items()})
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of smallest id: SimHash links by Golay keys, completed to all pairs whose sets of five-word shingles have similarity 0.8."""
    return shingle_join.keep_one(docs, n=5, threshold=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = decontaminate.find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["__hit"]), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document that is left."""
    return bpe.digests(docs, bpe.vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: Models, fingerprints and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
