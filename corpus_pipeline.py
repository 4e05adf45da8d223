"""From raw documents to packed token sequences, in five stages.

STAGES lists (name, function). A function takes (spark, docs, sf_dir), with docs the whole output of the stage before (the
first takes the table documents), and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's result as Parquet in the shared folder and reads it again for the next; the tables that the stage itself wrote are
deleted then. Tables of other queries, in this session or another, are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gazette.llm import neardup, packing, quality, suffix_dedup, toxicity
from gazette.llm.common import clear, scope, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host is rejected, go."""
    return quality.keep_documents(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go; the model is fitted to the labelled rows that are left."""
    return toxicity.keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group stays."""
    return neardup.keep_documents(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that occur earlier in the corpus are cut out of the texts."""
    return suffix_dedup.shorten_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", pack_sequences),
]

#: SQL can't express the merges of the tokenizer, the segment search or the minhashes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scope() as folders:
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
            clear(spark, folders, keep=docs)
        return STAGES[-1][1](spark, docs, sf_dir)
