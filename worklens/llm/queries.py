"""Registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from worklens.llm import byte_bpe, collision_ann, column_bwt_dedup, conversation_repair, lexical_lemp, license_scan, pii_surrogates, quality_indexing, secret_cnn, simhash_vptree, toxicity_cnn, warc_revisits, wu_manber


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vptree.digest(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_cnn.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_indexing.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.digest(_table(spark, sf_dir, "documents"))


def op5_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisits.digest(_table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_cnn.digest(_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.digest(_table(spark, sf_dir, "documents"), byte_bpe.Vocabulary(ranks, public_tokenizers.PATTERN))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return collision_ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_bwt_dedup.digest(_table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wu_manber.contaminated_words(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return wu_manber.digest(found)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digest(_table(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_lemp.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_near_dedup, op2_toxicity, op3_quality, op4_pii_surrogates, op5_revisit_resolution, op6_secret_scan, op7_byte_bpe, op8_nearest_neighbours, op9_suffix_dedup, op10_benchmark_decontamination, op11_conversation_repair, op12_license_scan, op13_lexical_search)
}
ORACLE: dict[str, str] = {
    "op5_revisit_resolution": warc_revisits.ORACLE,
    "op12_license_scan": license_scan.ORACLE,
    "op13_lexical_search": lexical_lemp.ORACLE,
}
