"""JSON-lines logs: application / server statements and vector searches.

Rows go through VARIANT, so a missing field, an explicit null and a value of the wrong
type are told apart as the row validation of the log format needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens import fixed, schemas
from worklens.functions.text import let, spaced_json, strip
from worklens.functions.timestamps import iso_timestamp, json_timestamp
from worklens.functions.variants import Field, document, facts, first_failure, shape_error
from worklens.sources.stderr_log import lines

REJECT = "reject_reason"
STATEMENT_FIELDS = (
    "timestamp", "time", "ts", "query", "duration_ms", "latency_ms", "success",
    "rows_returned", "rows_scanned", "error", "database", "user",
)
VECTOR_FIELDS = (
    "timestamp", "collection", "top_k", "filter", "latency_ms", "results_count", "status", "error",
)


def _documents(log_lines: DataFrame) -> DataFrame:
    """Non-blank lines."""
    text = strip(F.col("value"))
    return log_lines.withColumn("value", text).filter(F.col("value") != "")


def _parsed(names: tuple[str, ...], build: Callable[[Column, Column], Column]) -> Column:
    """``build(doc, facts)`` over the row's JSON, which is parsed once."""
    return let(
        document(F.col("value"), names),
        lambda doc: let(facts({n: doc[n] for n in names}), lambda known: build(doc, known)),
    )


def _rows(log_lines: DataFrame, parsed: Column, source: str, source_ord: int) -> DataFrame:
    return (
        _documents(log_lines)
        .withColumn("row", parsed)
        .select(
            "row.*",
            F.lit(source).alias("source"),
            F.struct(F.lit(source_ord).alias("source_ord"), "file", "block", "line").alias("seq"),
            F.col("value").alias("raw"),
        )
    )


def parse_json_rows(
    log_lines: DataFrame,
    now: Column,
    source: str = fixed.SOURCE_APPLICATION,
    source_ord: int = 0,
    on_bad_ts: str = "now",
) -> DataFrame:
    """Every non-blank line: ``query_log`` columns, the raw line, and a reject reason.

    ``on_bad_ts='now'`` gives rows without a readable timestamp the time ``now``;
    ``'reject'`` turns them into rejects.
    """
    if on_bad_ts not in ("now", "reject"):
        raise ValueError("on_bad_ts must be 'now' or 'reject'")

    def build(doc: Column, known: Column) -> Column:
        stamp = F.lit(None).cast("timestamp_ntz")
        for name in ("ts", "time", "timestamp"):
            f = Field(known, name)
            stamp = F.when(f.truthy(), F.when(f.is_text, json_timestamp(f.text))).otherwise(stamp)
        query, query_ok = Field(known, "query").text_or("")
        duration, latency = Field(known, "duration_ms"), Field(known, "latency_ms")
        ms = (
            F.when(duration.truthy(), duration.as_double())
            .when(latency.missing, 0.0)
            .otherwise(latency.as_double())
        )
        success, success_ok = Field(known, "success").bool_or(True)
        returned, returned_ok = Field(known, "rows_returned").optional_long()
        scanned, scanned_ok = Field(known, "rows_scanned").optional_long()
        error, error_ok = Field(known, "error").optional_text()
        database, database_ok = Field(known, "database").optional_text()
        user, user_ok = Field(known, "user").optional_text()
        checks = {
            "query": query_ok, "execution time": ms.isNotNull(), "success": success_ok,
            "rows_returned": returned_ok, "rows_scanned": scanned_ok, "error": error_ok,
            "database": database_ok, "user": user_ok,
        }
        if on_bad_ts == "reject":
            checks["timestamp"] = stamp.isNotNull()
        return F.struct(
            F.coalesce(stamp, now.cast("timestamp_ntz")).alias("ts"),
            query.alias("query"),
            F.lit(None).cast("string").alias("query_type"),
            ms.alias("execution_time_ms"),
            returned.alias("rows_returned"),
            scanned.alias("rows_scanned"),
            success.alias("success"),
            error.alias("error_message"),
            database.alias("database"),
            user.alias("user"),
            F.coalesce(shape_error(F.col("value"), doc), first_failure(checks)).alias(REJECT),
        )

    return _rows(log_lines, _parsed(STATEMENT_FIELDS, build), source, source_ord)


def _vector_query(doc: Column, known: Column) -> Column:
    """Canonical text of a vector search; the vector itself is left out."""

    def json(name: str) -> Column:
        return F.coalesce(F.to_json(doc[name]), F.lit("null"))

    # Nested filters keep their key order only as text; a VARIANT sorts keys.
    nested = F.when(
        Field(known, "filter").is_nested, F.get_json_object("value", "$.filter")
    ).otherwise(json("filter"))
    return F.concat(
        F.lit('{"collection": '), spaced_json(json("collection")),
        F.lit(', "query_vector": "[...]", "top_k": '), spaced_json(json("top_k")),
        F.lit(', "filter": '), spaced_json(nested), F.lit("}"),
    )


def parse_vector_rows(log_lines: DataFrame, now: Column, source_ord: int = 0) -> DataFrame:
    """Vector-search log lines in the same form as :func:`parse_json_rows`."""

    def build(doc: Column, known: Column) -> Column:
        ts = Field(known, "timestamp")
        stamp = F.when(~ts.truthy(), now.cast("timestamp_ntz")).when(
            ts.is_text, iso_timestamp(ts.text)
        )
        latency, status = Field(known, "latency_ms"), Field(known, "status")
        ms = F.when(latency.missing, 0.0).otherwise(latency.as_double())
        returned, returned_ok = Field(known, "results_count").optional_long()
        error, error_ok = Field(known, "error").optional_text()
        checks = {
            "timestamp": stamp.isNotNull(), "execution time": ms.isNotNull(),
            "results_count": returned_ok, "error": error_ok,
        }
        return F.struct(
            stamp.alias("ts"),
            _vector_query(doc, known).alias("query"),
            F.lit(fixed.VECTOR_TYPE).alias("query_type"),
            ms.alias("execution_time_ms"),
            returned.alias("rows_returned"),
            F.coalesce(status.is_text & (status.text == "success"), F.lit(False)).alias("success"),
            error.alias("error_message"),
            F.coalesce(shape_error(F.col("value"), doc), first_failure(checks)).alias(REJECT),
        )

    return _rows(log_lines, _parsed(VECTOR_FIELDS, build), fixed.SOURCE_VECTOR, source_ord)


def accepted(rows: DataFrame) -> DataFrame:
    return schemas.conform(rows.filter(F.col(REJECT).isNull()), schemas.QUERY_LOG)


def rejects(rows: DataFrame) -> DataFrame:
    """Lines that were left out, with the reason."""
    return rows.filter(F.col(REJECT).isNotNull()).select("seq", "source", "raw", REJECT)


def read_json_log(
    spark: SparkSession,
    path: str | list[str],
    now: Column,
    source: str = fixed.SOURCE_APPLICATION,
    source_ord: int = 0,
    on_bad_ts: str = "now",
) -> DataFrame:
    return accepted(parse_json_rows(lines(spark, path), now, source, source_ord, on_bad_ts))


def read_vector_log(
    spark: SparkSession, path: str | list[str], now: Column, source_ord: int = 0
) -> DataFrame:
    return accepted(parse_vector_rows(lines(spark, path), now, source_ord))
