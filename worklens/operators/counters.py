"""Cumulative statement counters: deltas between captures, pooled statistics, history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens import fixed, schemas
from worklens.functions import sqltext
from worklens.operators.workload import impact_score

# Identity of a statement across captures: the ids, or the text where there is no queryid.
KEY = ("queryid", "_text", "dbid", "userid")


def with_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_text", F.when(F.col("queryid").isNull(), F.col("query")))


def one_per_key(rows: DataFrame, *more: str) -> DataFrame:
    """One row per statement key (and ``more``): of duplicates the one a capture stores last.

    Captures are stored highest mean time first, so that is the lowest mean.
    """
    keyed = with_key(rows)
    values = [c for c in keyed.columns if c not in (*KEY, *more)]
    rank = F.struct(
        "mean_exec_time_ms", "calls", "total_exec_time_ms", "query", "stddev_exec_time_ms"
    )
    return (
        keyed.groupBy(*more, *KEY)
        .agg(F.min_by(F.struct(*values), rank).alias("_row"))
        .select(*more, *KEY, "_row.*")
    )


def load_capture(history: DataFrame, captured_at: datetime | Column) -> DataFrame:
    """One capture, one row per statement key."""
    stamp = captured_at if isinstance(captured_at, Column) else F.lit(captured_at)
    rows = history.filter(F.col("captured_at") == stamp.cast("timestamp_ntz"))
    return one_per_key(rows).drop("_text")


def latest_capture(history: DataFrame, before: Column | None = None) -> Column:
    """Scalar: the newest capture time, strictly before ``before`` when given."""
    rows = history if before is None else history.filter(F.col("captured_at") < before)
    return rows.agg(F.max("captured_at")).scalar()


def _sum_squares(calls: Column, mean: Column, sd: Column) -> Column:
    return calls * (sd * sd + mean * mean)


def _deltas(joined: DataFrame, keep: list[str]) -> DataFrame:
    """Per-window rows from current columns and the earlier ones under ``p``.

    No earlier row, or counters that went backwards: taken as they are. No new calls:
    dropped. Min and max are cumulative and stay; the other counters never go below 0.
    """
    now = {c: F.col(c) for c in schemas.STATEMENT_STATS.names}
    old = {c: F.col(f"p.{c}") for c in schemas.STATEMENT_STATS.names}
    fresh = (
        F.col("p").isNull()
        | (now["calls"] < old["calls"])
        | (now["total_exec_time_ms"] < old["total_exec_time_ms"])
    )
    calls = now["calls"] - old["calls"]
    total = now["total_exec_time_ms"] - old["total_exec_time_ms"]
    mean = total / F.nullif(calls, F.lit(0))
    squares = _sum_squares(
        now["calls"], now["mean_exec_time_ms"], now["stddev_exec_time_ms"]
    ) - _sum_squares(old["calls"], old["mean_exec_time_ms"], old["stddev_exec_time_ms"])
    spread = F.sqrt(F.greatest(squares / F.nullif(calls, F.lit(0)) - mean * mean, F.lit(0.0)))
    changed = {
        "calls": calls,
        "total_exec_time_ms": total,
        "mean_exec_time_ms": mean,
        "stddev_exec_time_ms": spread,
        **{
            c: F.greatest(now[c] - old[c], F.lit(0))
            for c in ("rows", "shared_blks_hit", "shared_blks_read")
        },
    }
    out = [
        F.when(fresh, now[c]).otherwise(changed[c]).alias(c) if c in changed else now[c]
        for c in schemas.STATEMENT_STATS.names
    ]
    return joined.select(*keep, *out).filter(F.col("calls") > 0)


def delta_rows(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Cumulative rows of one capture as rows of the window since the previous capture."""
    rows = current.select(*schemas.STATEMENT_STATS.names)
    if previous is None:
        return rows.filter(F.col("calls") > 0)
    earlier = one_per_key(previous.select(*schemas.STATEMENT_STATS.names))
    packed = earlier.select(*[F.col(k).alias(f"_p_{k}") for k in KEY], _packed().alias("p"))
    match = [F.col(k).eqNullSafe(F.col(f"_p_{k}")) for k in KEY]
    return _deltas(with_key(rows).join(packed, match, "left"), [])


def _packed() -> Column:
    return F.struct(*schemas.STATEMENT_STATS.names)


def capture_times(history: DataFrame) -> DataFrame:
    """Each capture time with the one before it.

    Distinct times are ordered within their day; only one row per calendar day takes part
    in the window that has no partition.
    """
    times = history.select("captured_at").distinct().withColumn("_day", F.to_date("captured_at"))
    days = (
        times.groupBy("_day")
        .agg(F.max("captured_at").alias("_last"))
        .select("_day", F.lag("_last").over(Window.orderBy("_day")).alias("_before"))
    )
    in_day = F.lag("captured_at").over(Window.partitionBy("_day").orderBy("captured_at"))
    return times.join(days, "_day").select(
        "captured_at", F.coalesce(in_day, F.col("_before")).alias("previous_at")
    )


def history_deltas(history: DataFrame) -> DataFrame:
    """Deltas of every capture against the capture just before it, as one job.

    A statement absent from the capture just before counts as new even if older captures
    have it, so this is a join on the previous capture time, not a lag over the key. The
    join key has the capture time in it, which spreads a busy statement over all tasks;
    the earlier side has one row per key and capture.
    """
    columns = ["captured_at", *schemas.STATEMENT_STATS.names]
    rows = history.select(*columns)
    # Plain equality on the time lets the small list of captures be matched by hash.
    current = with_key(rows.join(capture_times(history), "captured_at"))
    earlier = one_per_key(rows, "captured_at")
    packed = earlier.select(
        F.col("captured_at").alias("_p_at"),
        *[F.col(k).alias(f"_p_{k}") for k in KEY],
        _packed().alias("p"),
    )
    match = [F.col("previous_at") == F.col("_p_at")] + [
        F.col(k).eqNullSafe(F.col(f"_p_{k}")) for k in KEY
    ]
    return _deltas(current.join(packed, match, "left"), ["captured_at", "previous_at"])


def estimated_percentiles(mean: Column, spread: Column, highest: Column) -> dict[str, Column]:
    """Normal estimates from mean and deviation, capped at the maximum when there is one."""
    cap = F.when(highest > 0, highest).otherwise(F.lit(float("inf")))
    return {
        "p50_latency_ms": F.least(mean, cap),
        "p95_latency_ms": F.least(mean + fixed.Z_P95 * spread, cap),
        "p99_latency_ms": F.least(mean + fixed.Z_P99 * spread, cap),
    }


def pooled_snapshots(
    rows: DataFrame,
    snapshot_timestamp: Column,
    window_start: Column,
    window_end: Column,
    min_calls: int = 1,
    by: tuple[str, ...] = (),
    **flags: bool,
) -> DataFrame:
    """Workload snapshots from statement rows, pooled per fingerprint (and ``by``).

    All sums are algebraic, so partial results are combined on the map side. The example
    is the statement with most calls; of equal ones the one with the highest mean.
    """
    calls, mean, sd = F.col("calls"), F.col("mean_exec_time_ms"), F.col("stddev_exec_time_ms")
    pooled = (
        rows.filter(calls > 0)
        .withColumn("query_fingerprint", sqltext.fingerprint(F.col("query"), **flags))
        .groupBy(*by, "query_fingerprint")
        .agg(
            F.max_by("query", F.struct("calls", "mean_exec_time_ms", "query")).alias("example_query"),
            F.sum(calls).alias("execution_count"),
            F.sum("total_exec_time_ms").alias("total_execution_time_ms"),
            F.sum(_sum_squares(calls, mean, sd)).alias("_squares"),
            F.max("max_exec_time_ms").alias("max_latency_ms"),
            F.min("min_exec_time_ms").alias("min_latency_ms"),
            F.sum("rows").alias("_rows"),
            F.sum("shared_blks_hit").alias("_hits"),
            F.sum("shared_blks_read").alias("_reads"),
        )
        .filter(F.col("execution_count") >= max(min_calls, 1))
    )
    n = F.col("execution_count")
    pooled = pooled.withColumn("avg_execution_time_ms", F.col("total_execution_time_ms") / n)
    average = F.col("avg_execution_time_ms")
    spread = F.sqrt(F.greatest(F.col("_squares") / n - average * average, F.lit(0.0)))
    return pooled.select(
        *by,
        snapshot_timestamp.cast("timestamp_ntz").alias("snapshot_timestamp"),
        window_start.cast("timestamp_ntz").alias("window_start"),
        window_end.cast("timestamp_ntz").alias("window_end"),
        "query_fingerprint",
        sqltext.query_type(F.col("example_query")).alias("query_type"),
        F.lit(fixed.SOURCE_POSTGRES).alias("query_source"),
        "example_query",
        n,
        "total_execution_time_ms",
        average,
        *[c.alias(k) for k, c in estimated_percentiles(average, spread, F.col("max_latency_ms")).items()],
        "max_latency_ms",
        "min_latency_ms",
        (F.col("_rows") / n).alias("avg_rows_returned"),
        F.lit(None).cast("double").alias("avg_rows_scanned"),
        (F.col("_hits") / n).alias("avg_buffer_hits"),
        (F.col("_reads") / n).alias("avg_buffer_misses"),
        F.lit(0).cast("bigint").alias("error_count"),
        F.lit(0.0).alias("error_rate"),
        impact_score(n, average).alias("impact_score"),
    )


def captures(history: DataFrame, limit: int = 50) -> DataFrame:
    """Statements and total calls per capture, newest first."""
    return (
        history.groupBy("captured_at")
        .agg(
            F.count(F.lit(1)).alias("statements"),
            F.coalesce(F.sum("calls"), F.lit(0)).alias("total_calls"),
        )
        .orderBy(F.desc("captured_at"))
        .limit(limit)
    )


def as_capture(rows: DataFrame, captured_at: Column, **flags: bool) -> DataFrame:
    """Statement rows in stored form, with fingerprint and type."""
    query = F.col("query")
    stored = rows.withColumns(
        {
            "captured_at": captured_at.cast("timestamp_ntz"),
            "query_fingerprint": sqltext.fingerprint(query, **flags),
            "query_type": sqltext.query_type(query),
        }
    )
    return schemas.conform(stored, schemas.STAT_CAPTURE)


def export_rows(
    history: DataFrame, since: datetime | None = None, until: datetime | None = None
) -> DataFrame:
    """Captures of a time range (both ends included), oldest first, in column order."""
    rows = history
    if since is not None:
        rows = rows.filter(F.col("captured_at") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        rows = rows.filter(F.col("captured_at") <= F.lit(until).cast("timestamp_ntz"))
    return rows.select(*schemas.STAT_CAPTURE.names).orderBy(
        "captured_at", F.col("queryid").asc_nulls_last(), "query_fingerprint"
    )


def retained(history: DataFrame, before: Column) -> DataFrame:
    """Rows that a retention run keeps."""
    return history.filter(F.col("captured_at") >= before.cast("timestamp_ntz"))


def retention_bound(
    now: datetime | Column, retention_days: float | None = None, before: datetime | None = None
) -> Column | None:
    """Time before which captures are removed; None when nothing is to be removed."""
    if before is not None:
        return F.lit(before).cast("timestamp_ntz")
    if retention_days is None or retention_days <= 0:
        return None
    stamp = now if isinstance(now, Column) else F.lit(now)
    seconds = F.lit(round(retention_days * 86400, 6))
    return stamp.cast("timestamp_ntz") - F.make_dt_interval(secs=seconds)
