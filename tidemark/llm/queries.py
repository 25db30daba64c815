"""The operators applied to the tables of a data folder, one query each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, fim, licenses, lm, mixing, pii, quality, secrets, simhash, suffixes, toxicity, whitening
from tidemark.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(table(spark, folder, "documents"))


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digest(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op4_ann(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.digest(table(spark, folder, "documents"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"))


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digest(table(spark, folder, "documents"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.assign(table(spark, folder, "documents"))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(table(spark, folder, "documents"))


def op11_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.digest(table(spark, folder, "documents"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.digest(table(spark, folder, "embeddings"))


def op13_fim(spark: SparkSession, folder: str) -> DataFrame:
    return fim.digest(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_pii": op2_pii,
        "op3_bpe": op3_bpe,
        "op4_ann": op4_ann,
        "op5_lm": op5_lm,
        "op6_quality": op6_quality,
        "op7_licenses": op7_licenses,
        "op8_toxicity": op8_toxicity,
        "op9_mixing": op9_mixing,
        "op10_secrets": op10_secrets,
        "op11_suffixes": op11_suffixes,
        "op12_whitening": op12_whitening,
        "op13_fim": op13_fim,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_pii": pii.digest_sql(),
        "op6_quality": quality.JUDGE_SQL,
        "op7_licenses": licenses.digest_sql(),
        "op9_mixing": mixing.ASSIGN_SQL,
        "op10_secrets": secrets.digest_sql(),
        "op13_fim": fim.digest_sql(),
    }
