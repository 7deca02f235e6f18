"""Stored tables and the golden retrieval set."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from worklens import schemas


def read_golden_set(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """Retrieval test set: a JSON array file, or JSON lines for sets worth splitting.

    A path that does not exist gives an empty set.
    """
    reader = spark.read.schema(schemas.GOLDEN_SET)
    try:
        return reader.json(path, multiLine=not json_lines)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.GOLDEN_SET)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table of :data:`worklens.schemas.TABLES`; empty when nothing is stored yet."""
    schema = schemas.TABLES[name]
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
