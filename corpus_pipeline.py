"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkvoice.cluster import ship
from sparkvoice.llm import bpe, mixing, neardup, quality, toxicity
from sparkvoice.llm.common import Scratch, short_batches, table


def prepare(spark: SparkSession) -> None:
    """What every stage needs of its session: the code on executors, and Arrow batches that leave them memory."""
    ship(spark)
    short_batches(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host passes them."""
    prepare(spark)
    return quality.apply_rules(spark, docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    prepare(spark)
    return toxicity.reject(spark, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    prepare(spark)
    return neardup.keep_one(spark, docs, width=5, limit=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for every round in which words of it are taken, cut to those words."""
    prepare(spark)
    return mixing.mixed_documents(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    prepare(spark)
    return bpe.digests(spark, docs, bpe.tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The toxicity stage and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
