"""A corpus pipeline over ``documents``: five stages, each of them one of the operators of ``tidemark.llm``."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, pii, simhash, toxicity
from tidemark.llm.common import checkpoint_folder, table
from tidemark.llm.queries import VOCABULARY


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind, and terms that disclose it are generalised or removed."""
    return _counted(pii.sanitise(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their targets: a row for each use of a document, in the order of training."""
    return _counted(mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every use, packed as little-endian unsigned 32-bit integers, and whether they decode to the text."""
    both = bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    same = F.col("decoded").eqNullSafe(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return both.select("doc_id", "source", bpe.count_ids().alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", toxic),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("byte_bpe", tokens),
]

#: The trees of the first stage can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
