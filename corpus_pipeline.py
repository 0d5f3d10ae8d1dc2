"""A training corpus from raw documents: identify, deduplicate, decontaminate, mix, write as token ids.

Each stage takes the session, the documents its predecessor kept, and the folder of the tables; what it returns is
written as Parquet and read again as the documents of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import decontaminate, jaccard_join, language_id, mixing, token_files
from loomery.llm.storage import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is predicted with a score of one half or more."""
    return language_id.keep_identified(docs, language_id.train(docs, ~language_id.held_out(F.col("doc_id"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each class of near duplicates."""
    return jaccard_join.keep_one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a part of a benchmark item."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources have their target sizes."""
    return mixing.mixed(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write all documents as token ids; the result is what the files hold."""
    return token_files.read_digests(spark, token_files.write_tokens(docs, token_files.byte_bpe))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

#: Tokenising can't be put in SQL; tests hold the rows against a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
