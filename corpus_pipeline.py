"""The corpus pipeline: toxic documents go, then copies, then near copies, then repeated passages; the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkchirp.llm.common import load
from sparkchirp.llm.exact_dedup import exact_dedup
from sparkchirp.llm.neardup import near_dedup
from sparkchirp.llm.packing import pack, tokenise
from sparkchirp.llm.queries import TEMPER, vocabulary
from sparkchirp.llm.substrings import without_repeats
from sparkchirp.llm.toxicity import drop_toxic, train
from sparkchirp.plans.shipping import clear_scratch, scratch_paths, shared_path, ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, finds at least as likely toxic as not are dropped."""
    ship(spark)
    model = train(docs, load(spark, sf_dir, "labels"), F.col("toxic"))
    return drop_toxic(docs, model)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the smallest id."""
    ship(spark)
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the smallest id."""
    ship(spark)
    return near_dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 35 words that occur more than once are taken out of the texts; every document stays."""
    ship(spark)
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 2048 tokens, sources mixed by the square root of their tokens."""
    ship(spark)
    tokens = tokenise(docs, vocabulary("word_bpe_49k.json"), 1, remember=250_000, block_chars=1 << 21)
    return pack(tokens, temper=TEMPER).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", copies),
    ("near-duplicate dedup", near_copies),
    ("substring dedup", repeated_passages),
    ("packing", packing),
]

#: The stages are a fitted model, probabilistic candidates and a tokenizer: SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.  What a stage left in the shared folder goes once its result is
    written, and that result once the next one is; the last stage's tables stay for the reader of its lazy result."""
    docs, others = load(spark, sf_dir, "documents"), scratch_paths(spark)
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        clear_scratch(spark, keep=[*others, path])
    return STAGES[-1][1](spark, docs, sf_dir)
