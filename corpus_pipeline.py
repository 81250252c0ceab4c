"""Cleaning of a document corpus: each stage is one operator of millrace.llm, written and reread as Parquet.

Every stage takes the whole of what the one before has kept and returns the columns of ``documents`` (doc_id,
text, lang, source, n_chars); the last one returns ids. Null texts count as empty. Rows of one id and text are
one document: they stay or go together, except in near-dedup, where one row of a group stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, line_dedup, quality, simhash
from millrace.session import fresh_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives 0.3 or more; it learns from the labels of four in five."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = quality.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return quality.accepted(docs.select(*COLUMNS), net, "text", 0.3)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand in an earlier document within an edit for each 40 characters, three at most; n_chars is counted anew."""
    got = line_dedup.dedup_lines(docs, "doc_id", "text")
    return got.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id: shingles of five words, similarity of 0.8 or more."""
    groups = simhash.similar_documents(docs, F.col("doc_id"), F.col("text"), 5)
    later = groups.where(~(F.struct("key", "rank") == F.col("component"))).select("rank").distinct()
    kept = docs.withColumn("rank", F.xxhash64("doc_id", F.coalesce("text", F.lit("")))).join(later, "rank", "left_anti")
    # rows that repeat an id and a text are copies of one another; no two others share this hash of both
    return kept.dropDuplicates(["rank"]).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.withColumn("rank", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    leaking = decontaminate.leaks(keyed, benchmark, "rank", "text", "item_id", "text").select("rank").distinct()
    return keyed.join(leaking, "rank", "left_anti").select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and the decoded text of what is kept."""
    import public_tokenizers

    got = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), F.col("doc_id"), F.col("text"))
    return got.select(F.col("key").alias("doc_id"), "ids", "decoded")


STAGES = [
    ("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage), ("bpe", encoding_stage),
]
#: The classifier and the fingerprints are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
