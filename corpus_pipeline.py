"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Every stage takes null ids and texts, empty and very long texts, repeated rows, empty tables and further columns, whatever
their names; the first four return the columns of their input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfrank.llm import exact_dedup, langid, packing, quality, simhash
from shelfrank.llm.common import bounded_batches, release, shared_dir, written

#: Learned stages can't be written in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts are judged like others, by counts of zero."""
    bounded_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one language has half of the letters. Null texts and those without letters have no language and go."""
    bounded_batches(spark)
    return langid.keep_identified(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the smallest id, null ids last, then the first.

    Null, empty and wordless texts are copies of each other, so one of all such rows stays.
    """
    bounded_batches(spark)
    return simhash.drop_near_copies(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that stand earlier in the corpus; those of which nothing is left go, null and empty texts stay."""
    bounded_batches(spark)
    return exact_dedup.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences. A null or empty text is its closing token alone."""
    bounded_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_copies", near_copies_stage),
    ("repeats", repeats_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``. What a stage wrote for itself is removed when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        before = written()
        stage(spark, docs, sf_dir).write.parquet(path := f"{base}/{i}_{name}")
        release(spark, before)
        docs = spark.read.parquet(path)
    return docs
