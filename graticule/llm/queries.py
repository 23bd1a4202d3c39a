"""Registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.llm import ann, fingerprint, langid, licenses, mixing, ngram_join, packing, quality, rowpattern, sentencepieces, sharding, spelling, tokencount
from graticule.llm.common import table, tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(packing.VOCABULARY))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(tokencount.VOCABULARY))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op11_rowpattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowpattern.match_digests(table(spark, sf_dir, "clicks"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encoded_digests(table(spark, sf_dir, "documents"), tokenizer_path(sentencepieces.MODEL))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_quality": op2_quality,
        "op3_sharding": op3_sharding,
        "op4_packing": op4_packing,
        "op5_ngram_join": op5_ngram_join,
        "op6_tokens": op6_tokens,
        "op7_mixing": op7_mixing,
        "op8_licenses": op8_licenses,
        "op9_language": op9_language,
        "op10_nearest": op10_nearest,
        "op11_rowpattern": op11_rowpattern,
        "op12_sentencepiece": op12_sentencepiece,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": mixing.ORACLE, "op10_nearest": ann.ORACLE, "op11_rowpattern": rowpattern.ORACLE}
