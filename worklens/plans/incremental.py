"""Registered queries over streams, sketches, panes, clause order and stored runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens import schemas
from worklens.functions import sqltext
from worklens.operators import counters, dayfilters, listings, panes, report, review, sketch, workload
from worklens.plans import bridges, pipelines, render
from worklens.plans.queries import (
    WEEK, comparable, eval_results, golden, history, now, proposed, query_log, register, review_events, rounded,
)
from worklens.session import scratch_path, staged
from worklens.sources import registry, statements, tables
from worklens.streaming import hourly, json_tail, ledger

#: Percentiles that are shown of a sketch.
SHOWN = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}


def _percentiles(rows: DataFrame) -> DataFrame:
    return rounded(rows.withColumns({n: sketch.quantile(F.col("sketch"), q) for n, q in SHOWN.items()}), *SHOWN)


def _taken_in(spark: SparkSession, log: str, folder: str, delay: str = "1 hour") -> None:
    """One run of the stream over the files that are new in ``log``."""
    json_tail.append_new_entries(
        spark, log, f"{folder}/log", f"{folder}/state", now(), rejects=f"{folder}/rejects", late=f"{folder}/late", delay=delay
    ).awaitTermination()


@register
def a1_streamed_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Closed hours of the streamed log, from two runs over files in the order of time."""
    folder, log = scratch_path(spark, "stream"), scratch_path(spark, "log")
    for part in ("ts < timestamp'2024-01-15'", "ts >= timestamp'2024-01-15'"):
        render.log_files(spark, sf, render.JSON, part, log)
        _taken_in(spark, log, folder)
        hourly.append_closed_hours(spark, f"{folder}/log", f"{folder}/hours", f"{folder}/hour-state").awaitTermination()
    rows = _percentiles(hourly.hours(spark.read.parquet(f"{folder}/hours"))).drop("sketch", "batch")
    return rounded(rows.withColumn("total_ms", F.col("total_ms").cast("double")), "total_ms", "min_ms", "max_ms", places=3)


@register
def a1_streamed_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Late rows by hour, where the newer files come first."""
    folder, log = scratch_path(spark, "stream"), scratch_path(spark, "log")
    for part in ("ts >= timestamp'2024-01-15'", "ts < timestamp'2024-01-15'"):
        render.log_files(spark, sf, render.JSON, part, log)
        _taken_in(spark, log, folder, "2 days")
    late = spark.read.parquet(f"{folder}/late").groupBy("hour").agg(F.sum("late_rows").alias("rows"), F.count(F.lit(1)).alias("patterns"))
    kept = spark.read.parquet(f"{folder}/log").groupBy(json_tail.hour(F.col("ts")).alias("hour")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("query_fingerprint").alias("patterns"))
    return late.withColumn("outcome", F.lit("late")).unionByName(kept.withColumn("outcome", F.lit("stored")))


@register
def p7_streamed_rejects(spark: SparkSession, sf: str) -> DataFrame:
    folder, log = scratch_path(spark, "stream"), scratch_path(spark, "log")
    for part in ("k < 50", "k >= 50"):
        render.log_files(spark, sf, render.JSON, part, log)
        json_tail.append_new_entries(spark, log, f"{folder}/log", f"{folder}/state", now(), rejects=f"{folder}/rejects").awaitTermination()
    refused = spark.read.parquet(f"{folder}/rejects").groupBy("reject_reason").agg(F.count(F.lit(1)).alias("lines"))
    stored = spark.read.parquet(f"{folder}/log").agg(F.lit("none").alias("reject_reason"), F.count(F.lit(1)).alias("lines"))
    return refused.unionByName(stored)


@register
def a1_sketch_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of days, from sketches of hours."""
    log = workload.with_fingerprint(query_log(spark, sf)).withColumn("hour", json_tail.hour(F.col("ts")))
    hours = sketch.sketches(log, ["hour", "query_fingerprint"], "execution_time_ms")
    days = sketch.merged(hours.withColumn("day", F.to_date("hour").cast("timestamp_ntz")), ["day", "query_fingerprint"])
    return _percentiles(days.withColumn("executions", sketch.count(F.col("sketch")))).drop("sketch")


@register
def p1_sliding_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """A day that slides by the hour, over the whole log."""
    return comparable(panes.sliding_snapshots(query_log(spark, sf), 60, 24)).select(
        "window_start", "window_end", "query_fingerprint", "query_type", "query_source", "execution_count", "error_count",
        "p50_latency_ms", "p95_latency_ms", "p99_latency_ms", "avg_rows_returned", "impact_score",
    )


def _streamed_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of three runs of the stateful ledger, each over the events of a further stretch of time."""
    folder = scratch_path(spark, "ledger")
    events = schemas.conform(review_events(spark, sf), schemas.REVIEW_EVENT)
    for part in ("ts < timestamp'1999-01-01'", "ts >= timestamp'1999-01-01' and ts < timestamp'2024-01-12'", "ts >= timestamp'2024-01-12'"):
        events.where(part).write.mode("append").parquet(f"{folder}/events")
        ledger.append_verdicts(spark, f"{folder}/events", f"{folder}/verdicts", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/verdicts")


@register
def r5_streamed_audit(spark: SparkSession, sf: str) -> DataFrame:
    return review.audit_rows(_streamed_verdicts(spark, sf)).select("ts", "seq", "proposal_id", "action", "actor", "reason")


@register
def r1_streamed_state(spark: SparkSession, sf: str) -> DataFrame:
    state = ledger.state_from_verdicts(_streamed_verdicts(spark, sf), review_events(spark, sf))
    return state.select("proposal_id", "status", "reviewed_by", "reviewed_at", "reason", "applied_by", "applied_at", "apply_error")


@register
def p9_second_check(spark: SparkSession, sf: str) -> DataFrame:
    """Applications that carry the SQL about to run, some of which no longer parses."""
    carried = F.when(F.col("seq") % 3 == 0, "SELEC * FRM users").when(F.col("seq") % 3 == 1, "SELECT 1")
    events = review_events(spark, sf).withColumn("sql", F.when(F.col("action") == "apply", carried).otherwise(F.col("sql")))
    tries = review.verdicts(events).filter("action = 'apply'")
    return tries.select("seq", "proposal_id", "status_before", F.col("refusal").alias("blocked_reason"))


@register
def f17_clause_order(spark: SparkSession, sf: str) -> DataFrame:
    told = review.clause_changes(proposed(spark, sf))
    return told.select("proposal_id", *[F.size(f"{n}_clauses").alias(n) for n in ("kept", "moved", "removed", "added")])


@register
def s5_source_status(spark: SparkSession, sf: str) -> DataFrame:
    sources = {
        "nowhere_logs": {"enabled": True, "log_path": "/nowhere"},
        "postgres_logs": {"enabled": True, "log_path": render.log_files(spark, sf, render.STDERR)},
        "vector_logs": {"enabled": True, "log_path": "/nowhere"},
        "application_logs": {"enabled": True, "log_path": render.log_files(spark, sf, render.JSON)},
        "other_logs": {"enabled": True},
    }
    rows, status = registry.store_logs(spark, sources, now(), scratch_path(spark, "sources"))
    read = rows.groupBy(F.col("seq.source_ord").alias("source_ord")).agg(F.count(F.lit(1)).alias("read_back"))
    return status.join(read, "source_ord", "left").select("source", "source_ord", "status", "rows", F.coalesce("read_back", F.lit(0)).alias("read_back"))


@register
def o6_run_and_store(spark: SparkSession, sf: str) -> DataFrame:
    """All steps over rendered log files, from the four tables that they stored."""
    sources = {
        "vector_logs": {"enabled": True, "log_path": "/nowhere"},
        "postgres_logs": {"enabled": True, "log_path": render.log_files(spark, sf, render.STDERR)},
    }
    paths = pipelines.run_and_store(spark, sources, golden(spark, sf), now(), scratch_path(spark, "run"), WEEK)
    read = lambda name: tables.read_table(spark, paths[name], name)
    steps = [
        read("workload_snapshots").select(F.lit("snapshot").alias("step"), F.col("query_fingerprint").alias("item"), F.col("impact_score").cast("double").alias("score")),
        read("eval_results").select(F.lit("result"), "eval_type", F.coalesce("overall_score", "p95_latency_ms").cast("double")),
        read("recommendations").select(F.lit("recommendation"), "title", F.col("confidence_score").cast("double")),
        read("review_events").select(F.lit("event"), "sql", F.col("confidence").cast("double")),
        spark.read.parquet(paths["source_status"]).select(F.lit("source"), F.concat_ws(" ", "source", "status"), F.lit(0.0)),
    ]
    out = steps[0]
    for step in steps[1:]:
        out = out.union(step)
    return rounded(out, "score", places=1)


@register
def f20_analysis_report(spark: SparkSession, sf: str) -> DataFrame:
    """The whole report of the day with most patterns, as one text."""
    days = schemas.conform(workload.daily_snapshots(query_log(spark, sf)), schemas.WORKLOAD_SNAPSHOT)
    day = days.where("snapshot_timestamp = timestamp_ntz'2024-01-10 00:00:00'")
    results = eval_results(spark, sf).withColumns({"rag_mrr": F.lit(None).cast("double"), "p99_latency_ms": F.lit(None).cast("double"), "slo_violations": F.lit(None).cast("string")}).withColumn("eval_type", F.concat_ws("/", "eval_type", "config_version"))
    kinds = query_log(spark, sf).groupBy("event_type").agg(F.max("k").alias("k"))
    columns = F.array(F.struct(F.lit("id").alias("name"), F.lit("bigint").alias("type")))
    schema = kinds.agg(
        F.array_sort(F.collect_list(F.struct(F.col("event_type").alias("name"), columns.alias("columns")))).alias("tables"),
        F.array_sort(F.collect_list(F.struct(F.concat(F.lit("ix_"), "event_type").alias("name"), F.col("event_type").alias("table")))).alias("indexes"),
    )
    settings = kinds.select(F.col("event_type").alias("name"), F.col("k").cast("string").alias("value"))
    return report.analysis_report(day, results, now(), ["Latency", "Cost"], 5, schema, settings)


@register
def r7_audit_of_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """All audit rows of the proposal that has most events, and its state by its id."""
    events = review_events(spark, sf)
    most = events.where("proposal_id <> 'gone'").groupBy("proposal_id").count().orderBy(F.desc("count"), "proposal_id").first()[0]
    fold = review.folded(events)  # once for both
    audit = review.audit_listing(review.audit_log(events, fold=fold), most, limit=None).select("proposal_id", "seq", "action")
    state = review.proposal(review.proposal_state(events, fold=fold), most).select("proposal_id", F.lit(0).cast("bigint").alias("seq"), F.col("status").alias("action"))
    return audit.unionByName(state)


@register
def t6_all_proposals(spark: SparkSession, sf: str) -> DataFrame:
    state = review.proposal_state(review_events(spark, sf))
    return review.proposal_listing(state, "approved", None).select("proposal_id", "title", "flags", "created_at")


@register
def s6c_reset_window(spark: SparkSession, sf: str) -> DataFrame:
    """A first profile, whose window starts at the counters' last reset, for one database by name."""
    view = bridges.view(spark, sf, bridges.STAT_VIEW)
    info = query_log(spark, sf).agg(F.min("ts").alias("stats_reset"))
    databases = query_log(spark, sf).groupBy("user_id").agg(F.min("k").alias("k")).select((F.col("user_id") % 2).alias("oid"), F.concat(F.lit("db"), (F.col("user_id") % 2).cast("string")).alias("datname")).distinct()
    none = spark.createDataFrame([], schemas.STAT_CAPTURE)
    snapshots = pipelines.profile_statements(
        view, none, now(), dbid=statements.database_id(databases, "db1"), stats_reset_at=statements.reset_time(info)
    )
    return comparable(snapshots).select("window_start", "window_end", "query_fingerprint", "execution_count", "avg_execution_time_ms", "impact_score")


@register
def t12_export_order(spark: SparkSession, sf: str) -> DataFrame:
    """Exported captures with their place in the file."""
    captures = history(spark, sf).withColumn("query_fingerprint", sqltext.fingerprint(F.col("query")))
    rows = counters.export_rows(schemas.conform(captures, schemas.STAT_CAPTURE)).withColumn("at", F.monotonically_increasing_id())
    return listings.numbered(staged(rows, "export")).select("place", "captured_at", "queryid", "query_fingerprint")


@register
def v1_uniqueness_by_day_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of some days sent again, checked against filters of all days; with the number of days read."""
    keys = ["snapshot_timestamp", "query_fingerprint", "query_source"]
    stored = staged(workload.daily_snapshots(query_log(spark, sf)).select(*keys).withColumn("day", F.to_date("snapshot_timestamp")), "stored")
    filters = staged(dayfilters.day_filters(stored, "day", keys), "filters")
    again = stored.where("day in (date'2024-01-05', date'2024-01-20')").unionByName(stored.withColumn("snapshot_timestamp", F.col("snapshot_timestamp") + F.expr("interval 90 days")))
    found, days = dayfilters.new_violations(again, stored, filters, "day", keys)
    return found.withColumn("days_read", F.lit(len(days)))
