"""Workload snapshots from a query log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens import schemas
from worklens.functions import sqltext
from worklens.operators.ranks import nearest_ranks

QUANTILES = {"p50_latency_ms": 0.50, "p95_latency_ms": 0.95, "p99_latency_ms": 0.99}
RESOURCES = ("rows_returned", "rows_scanned", "buffer_hits", "buffer_misses")
COLUMNS = [f.name for f in schemas.WORKLOAD_SNAPSHOT.fields]


def trailing_window(log: DataFrame, minutes: float = 60) -> DataFrame:
    """Rows of the last ``minutes`` before the newest row, both ends included.

    The newest timestamp is a scalar subquery, so the bound reaches the Parquet scan as a
    filter; no join is involved.
    """
    newest = log.agg(F.max("ts")).scalar()
    return log.filter(F.col("ts") >= newest - _minutes(minutes))


def _minutes(minutes: float) -> Column:
    return F.make_dt_interval(mins=F.lit(0), secs=F.lit(round(minutes * 60, 6)))


def with_fingerprint(log: DataFrame, **flags: bool) -> DataFrame:
    """Add ``query_fingerprint`` (kept when already there) and fill a missing query type.

    Store a log in this form when it is profiled more than once: the two passes of
    :func:`workload_snapshots` then read short columns instead of normalising twice.
    """
    fp = sqltext.fingerprint(F.col("query"), **flags)
    if "query_fingerprint" in log.columns:
        fp = F.coalesce("query_fingerprint", fp)
    kind = F.coalesce(F.nullif("query_type", F.lit("")), sqltext.query_type(F.col("query")))
    return log.withColumns({"query_fingerprint": fp, "query_type": kind})


def _snapshot_rows(rows: DataFrame, keys: list[str], min_query_count: int) -> DataFrame:
    """Totals and percentiles per (keys, fingerprint).

    Counts, sums and the first row are combined on the map side. In the rank search a
    digest stands in for the pattern text, so its shuffles carry fixed-width keys.
    """
    digest = F.coalesce(F.unhex(F.sha2("query_fingerprint", 256)), F.lit(b""))
    first = F.min_by(
        F.struct(
            "query_type",
            F.col("source").alias("query_source"),
            F.col("query").alias("example_query"),
        ),
        "seq",
    )
    ms = F.col("execution_time_ms")
    totals = (
        rows.groupBy(*keys, "query_fingerprint")
        .agg(
            first.alias("_first"),
            F.count(F.lit(1)).alias("execution_count"),
            F.sum(ms).alias("total_execution_time_ms"),
            F.avg(ms).alias("avg_execution_time_ms"),
            F.max(ms).alias("max_latency_ms"),
            F.min(ms).alias("min_latency_ms"),
            *[F.avg(c).alias(f"avg_{c}") for c in RESOURCES],
            F.count_if(~F.col("success")).alias("error_count"),
        )
        .filter(F.col("execution_count") >= min_query_count)
        .withColumn("_fp", digest)
    )
    timed = rows.select(*keys, digest.alias("_fp"), "execution_time_ms")
    ranks = nearest_ranks(timed, [*keys, "_fp"], "execution_time_ms", QUANTILES, min_query_count)
    return (
        totals.join(ranks, [*keys, "_fp"])
        .withColumns(
            {
                "error_rate": F.col("error_count") / F.col("execution_count"),
                "impact_score": impact_score(
                    F.col("execution_count"), F.col("avg_execution_time_ms")
                ),
            }
        )
        .select("*", "_first.*")
    )


def workload_snapshots(
    log: DataFrame,
    snapshot_timestamp: datetime | Column,
    window_minutes: float = 60,
    min_query_count: int = 5,
    **flags: bool,
) -> DataFrame:
    """One row per fingerprint of the trailing window.

    Grouping ignores the source; type, source and example come from the row that is first
    in input order (``seq``). Rows come unordered, see :func:`by_impact`.
    """
    newest = log.agg(F.max("ts")).scalar()
    rows = with_fingerprint(trailing_window(log, window_minutes), **flags)
    stamp = (
        snapshot_timestamp
        if isinstance(snapshot_timestamp, Column)
        else F.lit(snapshot_timestamp)
    )
    return (
        _snapshot_rows(rows, [], min_query_count)
        .withColumns(
            {
                "snapshot_timestamp": stamp.cast("timestamp_ntz"),
                "window_start": newest - _minutes(window_minutes),
                "window_end": newest,
            }
        )
        .select(*COLUMNS)
    )


def daily_snapshots(log: DataFrame, min_query_count: int = 5, **flags: bool) -> DataFrame:
    """Snapshots of every calendar day of a log at once, stamped with the day.

    What one run per day would store, as one job over the whole history.
    """
    rows = with_fingerprint(log, **flags).withColumn(
        "snapshot_timestamp", F.to_date("ts").cast("timestamp_ntz")
    )
    return (
        _snapshot_rows(rows, ["snapshot_timestamp"], min_query_count)
        .withColumns(
            {
                "window_start": F.col("snapshot_timestamp"),
                "window_end": F.col("snapshot_timestamp") + F.make_dt_interval(F.lit(1)),
            }
        )
        .select(*COLUMNS)
    )


def impact_score(executions: Column, avg_ms: Column) -> Column:
    return executions * avg_ms


def by_impact(snapshots: DataFrame) -> DataFrame:
    """Highest impact first; equal impact by fingerprint."""
    return snapshots.orderBy(F.desc("impact_score"), "query_fingerprint")
