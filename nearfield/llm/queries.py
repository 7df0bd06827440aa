"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, html, langid, media, mixing, parity_join, quality, token_counts, toxicity, winnow
from .common import read

RANKS = "byte_bpe_50k.tiktoken"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_histogram(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), quality=read(spark, sf_dir, "labels"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.join(read(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_with_edited(read(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(read(spark, sf_dir, "documents"))


def queries() -> dict:
    ops = (op1_html_extraction, op2_token_counts, op3_mix_sources, op4_ngram_jaccard_join, op5_bpe, op6_language_id, op7_toxicity, op8_quality, op9_winnowing, op10_media_columns)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": mixing.ORACLE.format(documents="documents")}
