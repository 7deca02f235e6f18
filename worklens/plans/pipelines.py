"""The end-to-end jobs: profile, capture, evaluate, recommend, and all of them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens import schemas
from worklens.operators import counters, evaluation, recommend, review, sinks, workload
from worklens.session import scratch_path, staged
from worklens.sources.registry import collect_logs, store_logs
from worklens.sources.statements import scan_statements
from worklens.sources.tables import read_table


def profile_logs(
    spark: SparkSession,
    sources: dict[str, dict],
    now: Column,
    window_minutes: float = 60,
    min_query_count: int = 5,
    log_path: str | None = None,
    **flags: bool,
) -> DataFrame:
    """Snapshots from all configured log sources.

    Parsing and fingerprinting raw logs is the costly part and the profile reads its input
    three times (newest time, totals, ranks), so the parsed log is written once, with its
    fingerprints, and the profile reads short columns of that table.
    """
    # A folder of this run: a second profile into the same log_path reads its own entries only.
    path = f"{log_path.rstrip('/')}/run-{uuid.uuid4().hex[:12]}" if log_path else scratch_path(spark, "query-log")
    parsed = workload.with_fingerprint(collect_logs(spark, sources, now), **flags)
    parsed.write.parquet(path)
    log = spark.read.schema(parsed.schema).parquet(path)
    return workload.by_impact(
        workload.workload_snapshots(log, now, window_minutes, min_query_count)
    )


def profile_statements(
    view: DataFrame,
    history: DataFrame,
    captured_at: Column,
    min_calls: int = 1,
    dbid: int | Column | None = None,
    limit: int | None = None,
    use_deltas: bool = True,
    stats_reset_at: Column | None = None,
    **flags: bool,
) -> DataFrame:
    """Snapshots from the live statistics view, as changes since the latest stored capture.

    The window starts at the previous capture, else at the last counter reset, else now.
    An empty history gives the cumulative counters. ``dbid`` may be a scalar subquery
    (``statements.database_id``), and so may ``stats_reset_at`` (``statements.reset_time``).
    """
    rows = scan_statements(view, min_calls, dbid, limit)
    return _profiled(rows, history, captured_at, min_calls, use_deltas, stats_reset_at, **flags)


def _profiled(
    rows: DataFrame,
    history: DataFrame,
    captured_at: Column,
    min_calls: int = 1,
    use_deltas: bool = True,
    stats_reset_at: Column | None = None,
    **flags: bool,
) -> DataFrame:
    now = captured_at.cast("timestamp_ntz")
    start = now if stats_reset_at is None else F.coalesce(stats_reset_at.cast("timestamp_ntz"), now)
    if use_deltas:
        previous_at = counters.latest_capture(history, before=now)
        start = F.coalesce(previous_at, start)
        previous = history.filter(F.col("captured_at") == previous_at)
        rows = counters.delta_rows(rows, previous)
    return counters.pooled_snapshots(rows, now, F.least(start, now), now, min_calls, **flags)


def store_statement_profile(
    spark: SparkSession,
    view: DataFrame,
    captured_at: Column,
    snapshot_path: str,
    history_path: str,
    retention_days: float | None = 30,
    min_calls: int = 1,
    dbid: int | Column | None = None,
    limit: int | None = None,
    stats_reset_at: Column | None = None,
) -> int:
    """Profile, store snapshots, then the capture, then prune; returns rows pruned.

    The view is read once: the counters that the changes were taken from are the counters
    that the next profile starts from. An idle window (no snapshots) stores no capture either.
    """
    rows = staged(scan_statements(view, min_calls, dbid, limit), "statements")
    history = read_table(spark, history_path, "stat_snapshots")
    fresh = _profiled(rows, history, captured_at, min_calls, stats_reset_at=stats_reset_at)
    snapshots = staged(schemas.conform(fresh, schemas.WORKLOAD_SNAPSHOT), "snapshots")
    if snapshots.isEmpty():
        return 0
    sinks.save_snapshots(spark, snapshots, snapshot_path)
    return _captured(spark, rows, captured_at, history_path, retention_days)


def capture_only(
    spark: SparkSession,
    view: DataFrame,
    captured_at: Column,
    history_path: str,
    retention_days: float | None = 30,
    min_calls: int = 1,
    dbid: int | Column | None = None,
    limit: int | None = None,
) -> int:
    """Store one capture without snapshots and prune; returns rows pruned."""
    rows = scan_statements(view, min_calls, dbid, limit)
    return _captured(spark, rows, captured_at, history_path, retention_days)


def _captured(
    spark: SparkSession, rows: DataFrame, captured_at: Column, history_path: str, retention_days: float | None
) -> int:
    sinks.save_capture(rows, captured_at, history_path)
    bound = counters.retention_bound(captured_at, retention_days)
    return sinks.prune_captures(spark, history_path, bound)


def evaluate(
    golden: DataFrame | None, snapshots: DataFrame, as_of: Column, result_path: str | None = None,
    settings: dict[str, dict[str, float]] | None = None,
) -> DataFrame:
    """Results of all evaluators, appended to ``result_path`` where one is given."""
    results = evaluation.evaluate_all(golden, snapshots, as_of, settings)
    if result_path is not None:
        sinks.save_result(results, result_path)
    return results


def recommend_and_queue(
    snapshots: DataFrame, as_of: Column, recommender: str = "heuristic",
    recommendation_path: str | None = None, event_path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Recommendations and the review events that queue their SQL, stored where paths are given."""
    recommendations = recommend.recommend(snapshots, as_of, recommender)
    events = review.enqueue(recommendations)
    if recommendation_path is not None:
        sinks.save_recommendations(recommendations, recommendation_path)
    if event_path is not None:
        sinks.save_events(events, event_path)
    return recommendations, events


def store_log_profile(
    spark: SparkSession, sources: dict[str, dict], now: Column, snapshot_path: str,
    window_minutes: float = 60, min_query_count: int = 5, **flags: bool,
) -> None:
    """Profile the configured logs and upsert the snapshots; a repeated run changes nothing."""
    sinks.save_snapshots(spark, profile_logs(spark, sources, now, window_minutes, min_query_count, **flags), snapshot_path)


def run_all(log: DataFrame, golden: DataFrame, as_of: Column, window_minutes: float = 60) -> DataFrame:
    """Profile, evaluate and recommend over one log: a row per step result.

    Snapshots are written once to the shared scratch folder and read by both later steps.
    """
    fresh = workload.workload_snapshots(log, as_of, window_minutes)
    snapshots = staged(schemas.conform(fresh, schemas.WORKLOAD_SNAPSHOT), "snapshots")
    results = evaluation.evaluate_all(golden, snapshots, as_of)
    recommendations, queued = recommend_and_queue(snapshots, as_of)
    steps = [
        snapshots.select(
            F.lit("profile").alias("step"), F.col("query_fingerprint").alias("item"),
            F.col("impact_score").cast("double").alias("score"),
        ),
        results.select(
            F.lit("evaluate").alias("step"), F.col("eval_type").alias("item"),
            F.coalesce(F.col("overall_score"), F.col("p95_latency_ms")).cast("double").alias("score"),
        ),
        queued.select(
            F.lit("recommend").alias("step"), F.col("sql").alias("item"),
            F.col("confidence").cast("double").alias("score"),
        ),
    ]
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


def run_and_store(
    spark: SparkSession, sources: dict[str, dict], golden: DataFrame, as_of: Column, folder: str,
    window_minutes: float = 60, min_query_count: int = 5,
) -> dict[str, str]:
    """Profile the configured logs, evaluate and recommend, and store what each step gives.

    Returns the paths of the tables under ``folder``: snapshots, results, recommendations,
    review events, and the status of every source. Later steps read the stored snapshots.
    """
    names = ("workload_snapshots", "eval_results", "recommendations", "review_events", "source_status")
    paths = {n: f"{folder.rstrip('/')}/{n}" for n in names}
    rows, status = store_logs(spark, sources, as_of, scratch_path(spark, "source-logs"))
    status.write.mode("append").parquet(paths["source_status"])
    log = staged(workload.with_fingerprint(rows), "query-log")
    fresh = workload.workload_snapshots(log, as_of, window_minutes, min_query_count)
    sinks.save_snapshots(spark, fresh, paths["workload_snapshots"])
    stored = read_table(spark, paths["workload_snapshots"], "workload_snapshots")
    snapshots = stored.filter(F.col("snapshot_timestamp") == as_of.cast("timestamp_ntz"))
    evaluate(golden, snapshots, as_of, paths["eval_results"])
    recommend_and_queue(snapshots, as_of, recommendation_path=paths["recommendations"], event_path=paths["review_events"])
    return paths
