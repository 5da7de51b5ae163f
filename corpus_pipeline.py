"""The corpus pipeline: quality filter, exact dedup, near-dedup, mixing, tokenising."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curafold.llm.bagminhash import near_deduplicated
from curafold.llm.bpe import encode_documents
from curafold.llm.catalog import TOKENIZER
from curafold.llm.common import table
from curafold.llm.exact_dedup import drop_duplicates
from curafold.llm.mixing import mixed_documents
from curafold.llm.quality import good_documents
from curafold.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels of ``sf_dir`` for rows in ``docs``."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with the digest of what they decode to."""
    return encode_documents(docs, TOKENIZER, keep=("doc_id", "lang", "source"), full=True).drop("decoded")


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("bpe", tokens)]

#: The classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each writes its result to the shared folder, where the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
