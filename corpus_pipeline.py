"""Documents to encoded training data, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``.  Rows with nulls, repeated rows and empty tables
are treated as the called operator says; an empty table passes through every stage.

Stages that read texts in Python workers set the session to batches of 1,000 rows, so that
the workers that Spark keeps from stage to stage stay small.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parlance.llm.byte_bpe import round_trip
from parlance.llm.exact_dup import drop_exact_duplicates
from parlance.llm.mixing import mixed_documents
from parlance.llm.near_dup import drop_near_duplicates
from parlance.llm.toxicity import drop_toxic
from parlance.session import pinned


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7, learned from the ``labels`` table.
    A null or empty text has the score of a text without hits and stays; repeated rows stay."""
    _small_batches(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"), threshold=0.7)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group equal up to white space, the longest, then the least id;
    null and empty texts are one group."""
    _small_batches(spark)
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.75 or more over five-word shingles, that of
    the least id; texts without words all stay."""
    _small_batches(spark)
    return drop_near_duplicates(docs, words=5, percent=75)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source at its target weight; a document stands as often as it is taken.  A null
    source is a source; texts without words have no size and follow their hash."""
    return mixed_documents(docs, weights=(5, 2, 1), most=3.0)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of the ids and of the decoded bytes; a null text is empty."""
    _small_batches(spark)
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("byte_bpe", byte_bpe)]
ORACLE_SQL = None  # neither learned scores nor token ids can be written as SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
