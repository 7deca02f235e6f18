"""Ranked and recent listings over the stored tables, and table counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_impact_latest(snapshots: DataFrame, limit: int = 50) -> DataFrame:
    """Highest impact within the newest snapshot.

    The newest timestamp is a scalar subquery, so it reaches the scan as a filter.
    """
    latest = snapshots.agg(F.max("snapshot_timestamp")).scalar()
    return (
        snapshots.filter(F.col("snapshot_timestamp") == latest)
        .select(
            "query_fingerprint", "query_type", "query_source", "execution_count",
            "p95_latency_ms", "impact_score", "example_query",
        )
        .orderBy(F.desc("impact_score"), "query_fingerprint", "query_source")
        .limit(limit)
    )


def top_impact(snapshots: DataFrame, limit: int = 50) -> DataFrame:
    """Highest impact over all stored snapshots."""
    return snapshots.orderBy(
        F.desc("impact_score"), "query_fingerprint", "snapshot_timestamp"
    ).limit(limit)


def recent_recommendations(recommendations: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Recommendations of the last ``days``, newest first."""
    bound = as_of.cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return (
        recommendations.filter(F.col("recommendation_timestamp") >= bound)
        .select(
            "recommendation_id", "recommendation_timestamp", "status", "priority",
            "recommendation_type", "title", "expected_latency_improvement_percent",
            "risk_level", "confidence_score",
        )
        .orderBy(F.desc("recommendation_timestamp"), "recommendation_id")
    )


def latest_recommendations(recommendations: DataFrame, limit: int = 10) -> DataFrame:
    return (
        recommendations.select(
            "recommendation_id", "recommendation_timestamp", "status", "priority",
            "recommendation_type", "title", "expected_latency_improvement_percent", "risk_level",
        )
        .orderBy(F.desc("recommendation_timestamp"), "recommendation_id")
        .limit(limit)
    )


def latest_results(results: DataFrame, limit: int = 10) -> DataFrame:
    """Newest evaluation results. A score of 0 stays 0."""
    return results.orderBy(F.desc("eval_timestamp"), "eval_type").limit(limit)


def status_counts(
    snapshots: DataFrame, results: DataFrame, recommendations: DataFrame
) -> DataFrame:
    """One row with the size of each table and the number of pending recommendations."""
    count = F.count(F.lit(1))
    return recommendations.agg(
        count.alias("recommendations"),
        F.count_if(F.col("status") == "pending").alias("pending_recommendations"),
    ).select(
        snapshots.agg(count).scalar().alias("workload_snapshots"),
        results.agg(count).scalar().alias("eval_results"),
        "recommendations",
        "pending_recommendations",
    )


def unique_key_violations(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; rows with a NULL in the key never conflict."""
    return (
        table.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )


def proposal_violations(state: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Proposal rows that break a table constraint, with the name of the constraint."""
    reason = F.col("reason")
    broken = F.when(~F.col("status").isin(*statuses), "status").when(
        (F.col("status") == "rejected") & (reason.isNull() | (reason == "")), "reject reason"
    )
    return state.withColumn("violation", broken).filter(F.col("violation").isNotNull())


def numbered(rows: DataFrame) -> DataFrame:
    """Rows in the order of ``at`` with their place from 1: counts per stretch of ``at``, then places within.

    ``at`` is a number that grows with the order and names the task in its upper bits
    (``monotonically_increasing_id``), so a stretch is what one task wrote.
    """
    part = F.shiftright("at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = rows.withColumn("_part", part).join(starts, "_part")
    return placed.withColumn("place", F.col("at") - F.shiftleft(F.col("_part"), 33) + F.col("_start") + 1).drop("at", "_part", "_start")
