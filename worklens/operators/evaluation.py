"""Retrieval quality, service-level checks and evaluation-result rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens import fixed
from worklens.functions import retrieval

K = 10


def scored(golden: DataFrame, k: int = K) -> DataFrame:
    """Golden set with reciprocal rank, precision@k and recall@k per row."""
    got, want = F.col("retrieved"), F.col("relevant")
    return golden.withColumns(
        {
            "reciprocal_rank": retrieval.reciprocal_rank(got, want),
            "precision_at_k": retrieval.precision_at_k(got, want, k),
            "recall_at_k": retrieval.recall_at_k(got, want, k),
        }
    )


def rag_metrics(golden: DataFrame, k: int = K) -> DataFrame:
    """One row: mean reciprocal rank, mean P@k, mean R@k (rows with relevant ids), count."""
    return scored(golden, k).agg(
        F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg("precision_at_k"), F.lit(0.0)).alias("precision_at_10"),
        F.coalesce(F.avg("recall_at_k"), F.lit(0.0)).alias("recall_at_10"),
        F.count(F.lit(1)).alias("test_count"),
    )


def scored_long(retrieved: DataFrame, relevant: DataFrame, key: str, k: int = K) -> DataFrame:
    """The same measures for golden data in long form, for sets too wide for arrays.

    ``retrieved`` has (key, item, rank) with rank from 1; ``relevant`` has (key, item).
    The rows of both sides are counted together by (key, item), so one query with very many
    items is spread over all tasks, and no side is sorted or held beside the other. A null
    key or item matches nothing: there the sides are counted apart.
    """
    number = F.lit(1).cast("bigint")
    got = retrieved.select(key, "item", "rank", F.lit(None).cast("bigint").alias("_copy"))
    want = relevant.select(key, "item", F.lit(None).alias("rank"), number.alias("_copy"))
    side = F.when(F.col(key).isNull() | F.col("item").isNull(), F.col("_copy").isNull())
    both = (
        got.unionByName(want).groupBy(key, "item", side.alias("_side"))
        .agg(
            F.sum("_copy").alias("_copies"),
            F.min("rank").alias("_first"),
            F.count_if(F.col("_copy").isNull() & (F.col("rank") <= k)).alias("_n_top"),
        )
    )
    hit = F.col("_copies").isNotNull() & F.col("_first").isNotNull()
    per_key = both.groupBy(key).agg(
        F.min(F.when(hit, F.col("_first"))).alias("_best"),
        F.count_if(hit & (F.col("_n_top") > 0)).alias("_hits"),
        F.coalesce(F.sum("_n_top"), F.lit(0)).alias("_top"),
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("_relevant"),
    )
    hits, top, total = F.col("_hits"), F.col("_top"), F.col("_relevant")
    return per_key.select(
        key,
        F.coalesce(F.lit(1.0) / F.col("_best"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(top > 0, hits / top).otherwise(F.lit(0.0)).alias("precision_at_k"),
        F.when(total > 0, hits / total).alias("recall_at_k"),
    )


def recent_workload_metrics(snapshots: DataFrame, as_of: Column, hours: float = 1) -> DataFrame:
    """One row of unweighted averages over the snapshots of the last hour; no data gives 0."""
    bound = as_of.cast("timestamp_ntz") - F.make_dt_interval(
        secs=F.lit(round(hours * 3600, 6))
    )
    zero = F.lit(0.0)
    return snapshots.filter(F.col("snapshot_timestamp") >= bound).agg(
        F.coalesce(F.avg(F.col("p95_latency_ms").cast("double")), zero).alias("avg_p95_latency"),
        F.coalesce(F.avg(F.col("p99_latency_ms").cast("double")), zero).alias("avg_p99_latency"),
        F.coalesce(F.avg(F.col("error_rate").cast("double")), zero).alias("avg_error_rate"),
        F.coalesce(F.sum("execution_count"), F.lit(0)).alias("total_queries"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("total_errors"),
    )


def slo_check(
    metrics: DataFrame,
    p95_ms: float = fixed.SLO_P95_MS,
    p99_ms: float = fixed.SLO_P99_MS,
    error_rate: float = fixed.SLO_ERROR_RATE,
) -> DataFrame:
    """Pass flag and a map of violations; only values above a threshold violate it."""
    limits = {
        "p95_latency": (F.col("avg_p95_latency"), p95_ms),
        "p99_latency": (F.col("avg_p99_latency"), p99_ms),
        "error_rate": (F.col("avg_error_rate"), error_rate),
    }
    pairs = []
    for name, (actual, threshold) in limits.items():
        entry = F.struct(
            actual.alias("actual"), F.lit(float(threshold)).alias("threshold")
        )
        pairs += [F.lit(name), entry]
    violations = F.map_filter(F.create_map(*pairs), lambda _, v: v["actual"] > v["threshold"])
    return metrics.select(
        (F.size(violations) == 0).alias("slo_passed"),
        violations.alias("violations"),
        F.col("avg_p95_latency").alias("p95_latency_ms"),
        F.col("avg_p99_latency").alias("p99_latency_ms"),
        F.col("avg_error_rate").alias("error_rate"),
        "total_queries",
        "total_errors",
    )


def slo_limits(
    p95_latency_ms: float = 500.0, p99_latency_ms: float = 1000.0, error_rate_percent: float = 0.1
) -> dict[str, float]:
    """Arguments of :func:`slo_check` from configured thresholds; the error rate is in percent."""
    return {
        "p95_ms": p95_latency_ms, "p99_ms": p99_latency_ms, "error_rate": error_rate_percent / 100,
    }


def rag_result(golden: DataFrame, as_of: Column) -> DataFrame:
    """Evaluation-result row of a retrieval test; the pass flag stays false here."""
    m = rag_metrics(golden)
    present = F.col("test_count") > 0
    return m.select(
        as_of.cast("timestamp_ntz").alias("eval_timestamp"),
        F.lit("rag_accuracy").alias("eval_type"),
        F.lit("production").alias("environment"),
        F.to_json(
            F.struct(
                F.when(~present, "No dataset available").alias("error"),
                "mrr", "precision_at_10", "recall_at_10",
                F.when(present, F.col("test_count")).alias("test_count"),
            )
        ).alias("metrics"),
        F.col("mrr").alias("overall_score"),
        F.lit(None).cast("double").alias("p95_latency_ms"),
        F.lit(None).cast("double").alias("p99_latency_ms"),
        F.lit(None).cast("double").alias("error_rate"),
        F.col("mrr").alias("rag_mrr"),
        F.col("precision_at_10").alias("rag_precision_at_k"),
        F.col("recall_at_10").alias("rag_recall_at_k"),
        F.lit(False).alias("slo_passed"),
        F.lit("{}").alias("slo_violations"),
        F.when(present, F.col("test_count")).alias("test_count"),
    )


def slo_result(snapshots: DataFrame, as_of: Column, **limits: float) -> DataFrame:
    """Evaluation-result row of a service-level check."""
    checked = slo_check(recent_workload_metrics(snapshots, as_of), **limits)
    return checked.select(
        as_of.cast("timestamp_ntz").alias("eval_timestamp"),
        F.lit("slo_check").alias("eval_type"),
        F.lit("production").alias("environment"),
        F.to_json(F.struct(*checked.columns)).alias("metrics"),
        F.lit(None).cast("double").alias("overall_score"),
        "p95_latency_ms",
        "p99_latency_ms",
        "error_rate",
        *[
            F.lit(None).cast("double").alias(c)
            for c in ("rag_mrr", "rag_precision_at_k", "rag_recall_at_k")
        ],
        "slo_passed",
        F.to_json("violations").alias("slo_violations"),
        F.lit(None).cast("bigint").alias("test_count"),
    )


#: An evaluator takes (golden set or None, snapshots, as_of, settings) and returns result rows, or None.
Evaluator = Callable[[DataFrame | None, DataFrame, Column, dict[str, float]], DataFrame | None]

_EVALUATORS: dict[str, Evaluator] = {
    "rag_accuracy": lambda golden, _, as_of, __: None if golden is None else rag_result(golden, as_of),
    "slo_check": lambda _, snapshots, as_of, settings: slo_result(snapshots, as_of, **slo_limits(**settings)),
}


def register_evaluator(name: str, evaluator: Evaluator) -> None:
    """Add an evaluator, or put another in the place of one."""
    _EVALUATORS[name] = evaluator


def evaluate_all(
    golden: DataFrame | None, snapshots: DataFrame, as_of: Column, settings: dict[str, dict[str, float]] | None = None
) -> DataFrame:
    """Results of all registered evaluators, each with its own settings.

    The retrieval test runs only where a set is configured; SLO thresholds are those of
    :func:`slo_limits`.
    """
    given = settings or {}
    results = [run(golden, snapshots, as_of, given.get(name, {})) for name, run in _EVALUATORS.items()]
    return reduce(DataFrame.unionByName, [r for r in results if r is not None])


def slo_compliance(results: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Pass rate, mean p95 and mean error rate per day and evaluation type."""
    bound = as_of.cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return (
        results.filter(F.col("eval_timestamp") >= bound)
        .groupBy(F.to_date("eval_timestamp").cast("timestamp_ntz").alias("eval_date"), "eval_type")
        .agg(
            F.avg(F.when(F.col("slo_passed"), 1.0).otherwise(0.0)).alias("pass_rate"),
            F.avg(F.col("p95_latency_ms").cast("double")).alias("avg_p95_latency"),
            F.avg(F.col("error_rate").cast("double")).alias("avg_error_rate"),
        )
        .orderBy(F.desc("eval_date"), "eval_type")
    )
