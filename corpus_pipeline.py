"""A corpus pipeline: stages over the documents table, each written to the shared folder and read again.

Every stage works on all rows that the one before kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from colloquy.llm import bpe, jaccard, mixing, quality, suffix
from colloquy.llm.queries import tokenizer
from colloquy.llm.shared import stored
from pyspark.sql import DataFrame, SparkSession


#: 51 words of 3.9 letters and the spaces between them: passages of over 50 words are caught, unless their words are shorter.
PASSAGE_BYTES = 250


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, a similarity of 0.75 or more."""
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE_BYTES that start anywhere else go; n_chars follows the text."""
    return suffix.without_repeats(docs, PASSAGE_BYTES)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix."""
    return bpe.encode_documents(docs, *tokenizer(), digests=False, columns=("lang", "source"))


STAGES = [("quality rules", keep_good), ("near copies", drop_near_copies), ("repeated strings", cut_repeats), ("mix", mix), ("tokens", encode)]

#: SQL can express neither the knapsack nor the tokens; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
