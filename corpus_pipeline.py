"""From a document table to token ids: five stages, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm import byte_bpe, quality_indexing, secret_cnn, simhash_vptree, wu_manber
from worklens.llm.staging import staged


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    inner = _apart(docs, {"score"})
    model = quality_indexing.fit(inner, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _back(quality_indexing.scored(inner, model).where("score >= 0.5"), inner, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_vptree.one_of_each(docs, shingle=3, radius=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    inner = _apart(docs, {f.name for f in wu_manber.FIELDS})
    found = wu_manber.contaminated_words(inner, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _back(found.where(F.size("hits") == 0), inner, docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark, and ``n_chars`` to match."""
    inner = _apart(docs, {"secrets", "clean_text"})
    clean = secret_cnn.redacted(inner, secret_cnn.fit(inner)).withColumn("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return _back(clean, inner, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    vocabulary = byte_bpe.Vocabulary(ranks, public_tokenizers.PATTERN)
    found = byte_bpe.encoded(docs, vocabulary)
    whole = vocabulary.decoded(F.col("ids")) == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("round_trip"))


def _apart(docs: DataFrame, taken: set[str]) -> DataFrame:
    """The documents with columns that have a name of the operator's own renamed."""
    return docs.withColumnsRenamed({c: f"input {i} {c}" for i, c in enumerate(docs.columns) if c in taken})


def _back(out: DataFrame, inner: DataFrame, docs: DataFrame) -> DataFrame:
    """The input's columns of an operator's result, under the input's names."""
    return out.select(*[f"`{c}`" for c in inner.columns]).toDF(*docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("byte-level BPE encoding and decoding", encode),
]

#: The stages that learn or compare by similarity have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
