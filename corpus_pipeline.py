"""A training corpus from ``documents``: quality, line dedup, near-dedup, decontamination, packing.

In every stage null and empty texts are documents without words: the classifier scores them like others, they
have one empty line, are nobody's near-duplicates and never contaminated, and pack as their end id alone.  Rows that share a
doc_id are one document to near-dedup, which keeps one of them, and each a row elsewhere.  Empty tables of
documents, labels or test items give empty or unchanged results; texts of any length are whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm import decontam, linededup, minhash, packing, quality, queries, storage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
ORACLE_SQL = None  # the classifier's scores have no SQL form


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    storage.small_batches(spark)
    scored = quality.score(docs, queries.quality_model(spark, docs, sf_dir))
    return scored.where(F.col("_score") >= queries.LEAST_SCORE).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that others hold too; n_chars follows the text."""
    storage.small_batches(spark)
    out = linededup.drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    storage.small_batches(spark)
    return minhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with test items."""
    storage.small_batches(spark)
    found = decontam.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~decontam.is_contaminated()).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of one size."""
    storage.small_batches(spark)
    return packing.pack(docs, queries._tokenizer("word_bpe_49k.json"), 2)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again, and goes when the next is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with storage.temporary() as made:
        for name, stage in STAGES[:-1]:
            docs = storage.cut(stage(spark, docs, sf_dir), name)
        made.keep(STAGES[-2][0])
    return STAGES[-1][1](spark, docs, sf_dir)
