"""Documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept, whole, and its decisions take
effect: rejected documents go, one document of each group of near copies stays,
benchmark passages and secrets leave the texts.  All stages but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common, decontaminate, jaccard, packing, quality, secrets, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of the rows it may use."""
    docs = docs.select(*COLUMNS)
    return quality.select_good(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component of similar documents."""
    return jaccard.one_of_each(docs.select(*COLUMNS))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; a document that is mostly benchmark goes."""
    return decontaminate.remove(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of each secret."""
    return secrets.redact(docs.select(*COLUMNS), secrets.Ledger(spark, common.fresh_path(spark, "ledger")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids, with their ids."""
    return packing.pieces(packing.pack(docs, tokens.default_path()))


STAGES = [("quality", keep_good), ("near_copies", drop_near_copies), ("benchmark", drop_benchmark), ("secrets", mask_secrets), ("packing", pack)]
ORACLE_SQL = None  # a trained classifier cannot be written as SQL; tests/llm checks the stages by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
