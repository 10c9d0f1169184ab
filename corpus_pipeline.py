"""A training corpus from ``documents``: language, toxicity, near duplicates, benchmark, tokens.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before it kept.  The first four return the columns of ``docs``, fewer rows; the
last returns a row for each document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import bpe, decontam, langid, similar, toxicity
from strandline.llm.common import fresh_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, and those whose score says that they are in no learned language."""
    return langid.known_language(docs, langid.train(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity score of 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.not_toxic(docs, toxicity.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (runs of five words, a similarity of 0.8) the document with the least id."""
    return similar.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which a window of a benchmark item occurs."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the bytes decoded from them."""
    return bpe.digests(docs)


STAGES = [
    ("language_id", language),
    ("toxicity", toxic),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("byte_level_bpe", tokens),
]

#: Trained models and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
