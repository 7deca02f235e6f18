"""Registered queries: every operator run over the whole given tables.

Each entry takes (spark, sf_dir) and returns a DataFrame. Doubles are rounded for
comparison only; a tiny offset keeps exact ties from depending on the order of a sum.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens import fixed, schemas
from worklens.functions import sqlcheck, sqltext, timestamps
from worklens.operators import (
    counters, evaluation, listings, recommend, report, review, sinks, workload,
)
from worklens.plans import bridges, pipelines, render
from worklens.session import scratch_path, staged
from worklens.sources import json_log, registry, statements, stderr_log, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = "timestamp_ntz'2024-02-01 00:00:00'"
WEEK = 7 * 24 * 60


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def now() -> Column:
    return F.expr(NOW)


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + F.lit(1e-9), places) for n in names})


def joined(array: Column) -> Column:
    return F.array_join(array, "|")


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    return bridges.view(spark, sf, bridges.QUERY_LOG)


def history(spark: SparkSession, sf: str) -> DataFrame:
    return bridges.view(spark, sf, bridges.STAT_HISTORY)


def golden(spark: SparkSession, sf: str) -> DataFrame:
    return bridges.view(spark, sf, bridges.SPARK_GOLDEN)


def eval_results(spark: SparkSession, sf: str) -> DataFrame:
    return bridges.view(spark, sf, bridges.EVAL_RESULTS)


def review_events(spark: SparkSession, sf: str) -> DataFrame:
    return bridges.view(spark, sf, bridges.REVIEW_EVENTS)


def proposed(spark: SparkSession, sf: str) -> DataFrame:
    return review_events(spark, sf).filter("action = 'propose'")


def day_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return workload.daily_snapshots(query_log(spark, sf))


MEASURES = (
    "total_execution_time_ms", "avg_execution_time_ms", "p50_latency_ms", "p95_latency_ms",
    "p99_latency_ms", "max_latency_ms", "min_latency_ms", "avg_rows_returned",
    "avg_rows_scanned", "avg_buffer_hits", "avg_buffer_misses", "error_rate",
)


def comparable(snapshots: DataFrame) -> DataFrame:
    return rounded(rounded(snapshots, *MEASURES), "impact_score", places=3)


# --- sources ---------------------------------------------------------------------------


@register
def s1_stderr_log_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = render.log_files(spark, sf, render.STDERR)
    return stderr_log.read_stderr_log(spark, path).select(
        "ts", "query", "execution_time_ms", "success", "source"
    )


JSON_COLUMNS = (
    "ts", "query", "execution_time_ms", "rows_returned", "success", "error_message", "source",
    "database",
)


@register
def s2_json_log_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = render.log_files(spark, sf, render.JSON)
    return json_log.read_json_log(spark, path, now()).select(*JSON_COLUMNS)


@register
def p7_json_log_rejects(spark: SparkSession, sf: str) -> DataFrame:
    path = render.log_files(spark, sf, render.JSON)
    rows = json_log.parse_json_rows(stderr_log.lines(spark, path), now())
    return json_log.rejects(rows).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("lines"))


@register
def s3_vector_log_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = render.log_files(spark, sf, render.VECTOR)
    return json_log.read_vector_log(spark, path, now()).select(
        "ts", "query", "query_type", "execution_time_ms", "rows_returned", "success", "source"
    )


@register
def s4_source_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    path = render.log_files(spark, sf, render.JSON)
    reader = registry.reader_for("postgres_logs", "json")
    return (
        reader(spark, path, now(), 3)
        .groupBy("source", F.col("seq.source_ord").alias("source_ord"))
        .agg(F.count(F.lit(1)).alias("entries"))
    )


@register
def s4_csv_log_scan(spark: SparkSession, sf: str) -> DataFrame:
    reader = registry.reader_for("postgres_logs", "csv")
    return reader(spark, render.csv_files(spark, sf), now(), 0).select(
        "ts", "query", "execution_time_ms", "success", "source"
    )


def _three_sources(spark: SparkSession, sf: str) -> dict[str, dict]:
    return {
        "postgres_logs": {"enabled": True, "log_path": render.log_files(spark, sf, render.STDERR)},
        "vector_logs": {"enabled": True, "log_path": render.log_files(spark, sf, render.VECTOR)},
        "application_logs": {
            "enabled": True, "log_path": render.log_files(spark, sf, render.JSON), "log_format": "json",
        },
        "nowhere_logs": {"enabled": True, "log_path": "/nowhere"},
    }


@register
def s5_multi_source_collect(spark: SparkSession, sf: str) -> DataFrame:
    logs = registry.collect_logs(spark, _three_sources(spark, sf), now())
    out = logs.groupBy("source", F.col("seq.source_ord").alias("source_ord"), "query_type").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("execution_time_ms").alias("total_ms")
    )
    return rounded(out, "total_ms", places=3)


@register
def s6_statement_scan(spark: SparkSession, sf: str) -> DataFrame:
    view = bridges.view(spark, sf, bridges.STAT_VIEW)
    return statements.scan_statements(view, min_calls=2, dbid=1)


@register
def t10_statement_limit(spark: SparkSession, sf: str) -> DataFrame:
    view = bridges.view(spark, sf, bridges.STAT_VIEW)
    return statements.scan_statements(view, min_calls=2, dbid=1, limit=100)


@register
def s7_golden_set_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "golden")
    golden(spark, sf).select("query", "retrieved", "relevant").write.json(path)
    return tables.read_golden_set(spark, path, json_lines=True).select(
        F.md5("query").alias("query_md5"),
        F.size("retrieved").alias("retrieved"),
        F.size("relevant").alias("relevant"),
    )


@register
def s9_load_capture(spark: SparkSession, sf: str) -> DataFrame:
    h = history(spark, sf)
    latest = counters.latest_capture(h)
    return rounded(
        counters.load_capture(h, latest).select(
            "queryid", "dbid", "userid", "query", "calls", "total_exec_time_ms", "mean_exec_time_ms"
        ),
        "total_exec_time_ms", "mean_exec_time_ms",
    )


# --- scalar functions --------------------------------------------------------------------


@register
def f1_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return query_log(spark, sf).select(
        "seq", sqltext.fingerprint(F.col("query")).alias("query_fingerprint")
    )


@register
def f1_fingerprint_flags(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("query")
    return query_log(spark, sf).select(
        "seq",
        sqltext.fingerprint(q, normalize_literals=False).alias("keep_literals"),
        sqltext.fingerprint(q, normalize_whitespace=False).alias("keep_whitespace"),
        sqltext.fingerprint(q, case_insensitive=False).alias("keep_case"),
    )


@register
def f2_query_hash(spark: SparkSession, sf: str) -> DataFrame:
    return query_log(spark, sf).select("seq", sqltext.query_hash(F.col("query")).alias("query_hash"))


@register
def f3_query_type(spark: SparkSession, sf: str) -> DataFrame:
    return query_log(spark, sf).select("seq", sqltext.query_type(F.col("query")).alias("query_type"))


@register
def f4_table_names(spark: SparkSession, sf: str) -> DataFrame:
    return query_log(spark, sf).select("seq", joined(sqltext.tables(F.col("query"))).alias("tables"))


@register
def f5_timestamp_coercion(spark: SparkSession, sf: str) -> DataFrame:
    form = F.expr(
        """CASE k % 7 WHEN 0 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        WHEN 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') WHEN 2 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
        WHEN 3 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") WHEN 4 THEN date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")
        WHEN 5 THEN date_format(ts, "yyyy-13-dd HH:mm:ss") ELSE 'yesterday' END"""
    )
    text = F.col("text")
    return query_log(spark, sf).select("seq", form.alias("text")).select(
        "seq",
        timestamps.log_timestamp(F.when(text.rlike(r"\.\d{3}$"), text)).alias("log_ts"),
        timestamps.json_timestamp(text).alias("json_ts"),
        timestamps.iso_timestamp(text).alias("iso_ts"),
    )


@register
def f6_zone_tag(spark: SparkSession, sf: str) -> DataFrame:
    zone = F.expr("CASE k % 3 WHEN 0 THEN 'UTC' WHEN 1 THEN 'utc' ELSE 'EST' END")
    return query_log(spark, sf).select("seq", sqltext.zone_tagged(F.col("query"), zone).alias("query"))


@register
def f8_counter_coercion(spark: SparkSession, sf: str) -> DataFrame:
    view = statements.current_names(bridges.view(spark, sf, bridges.STAT_VIEW))
    return statements.coerced(view).select(
        "queryid", "calls", "rows", "mean_exec_time_ms", "stddev_exec_time_ms"
    )


@register
def f10_estimated_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    estimates = counters.estimated_percentiles(
        F.col("mean_exec_time_ms"), F.col("stddev_exec_time_ms"), F.col("max_exec_time_ms")
    )
    rows = history(spark, sf).select(
        "captured_at", "queryid", "userid", "query", *[c.alias(n) for n, c in estimates.items()]
    )
    return rounded(rows, *estimates)


@register
def f12_f14_retrieval_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = ("reciprocal_rank", "precision_at_k", "recall_at_k")
    return rounded(evaluation.scored(golden(spark, sf)).select("doc_id", *scores), *scores)


@register
def f15_destructive_flags(spark: SparkSession, sf: str) -> DataFrame:
    reasons = sqlcheck.destructive_reasons(sqlcheck.statements(F.col("sql")))
    return proposed(spark, sf).select("proposal_id", joined(reasons).alias("destructive"))


#: Statements whose flags need depth, literal forms or nested comments to be right.
DEEP_STATEMENTS = (
    "DELETE FROM t{} USING (SELECT id FROM u WHERE " + "f(" * 10 + "1" + ")" * 10 + ") s",
    "UPDATE t{} SET a = (SELECT max(b) FROM u WHERE " + "(" * 40 + "1" + ")" * 40 + " = 1)",
    "DELETE FROM t{} WHERE a IN (SELECT " + "(" * 40 + "1" + ")" * 40 + ")",
    "CREATE FUNCTION f{}() RETURNS int AS $body$ BEGIN DELETE FROM t; RETURN 1; END; $body$ LANGUAGE plpgsql",
    "SELECT E'it\\'s; DROP TABLE t{}'",
    "/* a /* b; */ c */ DROP TABLE t{}",
    "SELECT $$ a ; DROP TABLE t{} $$; TRUNCATE u",
)


@register
def f15_deep_statements(spark: SparkSession, sf: str) -> DataFrame:
    orders = bridges.table(spark, sf, "orders")
    forms = F.array(*[F.lit(text) for text in DEEP_STATEMENTS])
    form = F.get(forms, (F.col("o_orderkey") % len(DEEP_STATEMENTS)).cast("int"))
    rows = orders.select("o_orderkey", F.replace(form, F.lit("{}"), F.col("o_custkey").cast("string")).alias("sql"))
    check = sqlcheck.check(F.col("sql"))
    return rows.withColumn("c", check).select(
        "o_orderkey", F.col("c.parse_error"), joined(F.col("c.destructive")).alias("destructive"),
        joined(F.col("c.statement_types")).alias("statement_types"),
    )


@register
def f16_statement_types(spark: SparkSession, sf: str) -> DataFrame:
    parsed = proposed(spark, sf).withColumn("parsed", sqlcheck.statements(F.col("sql")))
    return parsed.select(
        "proposal_id",
        joined(sqlcheck.statement_types(F.col("parsed"))).alias("statement_types"),
        sqlcheck.parse_error(F.col("sql"), F.col("parsed")).alias("parse_error"),
    )


@register
def f17_change_check(spark: SparkSession, sf: str) -> DataFrame:
    return review.changes(proposed(spark, sf)).select(
        "proposal_id", "changed",
        joined(F.col("removed_clauses")).alias("removed"),
        joined(F.col("added_clauses")).alias("added"),
    )


@register
def f18_proposal_sql(spark: SparkSession, sf: str) -> DataFrame:
    return query_log(spark, sf).select(
        "seq", recommend.explain_sql(F.col("query"), sqltext.query_type(F.col("query"))).alias("sql")
    )


@register
def f19_response_parsing(spark: SparkSession, sf: str) -> DataFrame:
    responses = bridges.view(spark, sf, bridges.RESPONSES)
    parsed = recommend.parse_responses(responses, now(), "model", "v1")
    return parsed.filter("reject_reason IS NULL").select(
        "doc_id",
        F.when(F.col("recommendation_id").startswith("rec-"), "generated")
        .otherwise(F.col("recommendation_id")).alias("recommendation_id"),
        "priority", "recommendation_type", "title", "config_patch",
        "expected_latency_improvement_percent", "risk_level", "migration_sql", "confidence_score",
    )


@register
def f19_response_rejects(spark: SparkSession, sf: str) -> DataFrame:
    responses = bridges.view(spark, sf, bridges.RESPONSES)
    parsed = recommend.parse_responses(responses, now(), "model", "v1")
    return (
        parsed.filter("reject_reason IS NOT NULL")
        .groupBy("reject_reason").agg(F.count(F.lit(1)).alias("responses"))
    )


@register
def f20_workload_report(spark: SparkSession, sf: str) -> DataFrame:
    by = ("snapshot_timestamp",)
    stored = schemas.conform(day_snapshots(spark, sf), schemas.WORKLOAD_SNAPSHOT)
    return report.workload_summary(stored, by, limit=5)


@register
def f20_eval_report(spark: SparkSession, sf: str) -> DataFrame:
    results = eval_results(spark, sf).withColumns(
        {
            "rag_mrr": F.lit(None).cast("double"),
            "p99_latency_ms": F.col("p95_latency_ms") * 2,
            "slo_violations": F.when(
                F.col("p95_latency_ms") > 100, '{"p95_latency":{"actual":1}}'
            ).otherwise("{}"),
            "eval_type": F.concat_ws("/", "eval_type", "config_version"),
        }
    )
    return report.eval_summary(results, limit=5)


@register
def f20b_schema_config_sections(spark: SparkSession, sf: str) -> DataFrame:
    columns = F.expr(
        "transform(sequence(1, 1 + k % 8), i -> named_struct('name', concat('c', i), 'type', 'int'))"
    )
    tabs = F.array(F.struct(F.col("event_type").alias("name"), columns.alias("columns")))
    indexes = F.expr(
        "transform(sequence(1, 1 + k % 30), i -> named_struct('name', concat('i', i), 'table', event_type))"
    )
    settings = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("work_mem"), F.concat(F.col("k").cast("string"), F.lit("MB"))))
    return query_log(spark, sf).select(
        "seq",
        F.md5(report.schema_summary(tabs, indexes)).alias("schema_md5"),
        report.config_summary(settings).alias("config"),
    )


@register
def f22_numeric_rounding(spark: SparkSession, sf: str) -> DataFrame:
    stored = schemas.conform(day_snapshots(spark, sf), schemas.WORKLOAD_SNAPSHOT)
    return stored.select(
        "snapshot_timestamp", "query_fingerprint",
        F.col("p95_latency_ms").cast("string").alias("p95_latency_ms"),
        F.col("error_rate").cast("string").alias("error_rate"),
    )


# --- filters, windows, aggregation ----------------------------------------------------------


@register
def p1_trailing_window(spark: SparkSession, sf: str) -> DataFrame:
    return workload.trailing_window(query_log(spark, sf), WEEK).select("seq", "ts", "query")


@register
def p9_apply_gate(spark: SparkSession, sf: str) -> DataFrame:
    tries = review.verdicts(review_events(spark, sf)).filter("action = 'apply'")
    return tries.select("seq", "proposal_id", "status_before", F.col("refusal").alias("blocked_reason"))


@register
def p9_apply_gate_mode_off(spark: SparkSession, sf: str) -> DataFrame:
    tries = review.verdicts(review_events(spark, sf), mode_on=False).filter("action = 'apply'")
    return tries.select("seq", "proposal_id", "status_before", F.col("refusal").alias("blocked_reason"))


@register
def a1_workload_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(workload.workload_snapshots(query_log(spark, sf), now(), WEEK))


@register
def a1_daily_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(day_snapshots(spark, sf)).select(
        "snapshot_timestamp", "query_fingerprint", "query_type", "query_source", "execution_count",
        "p50_latency_ms", "p95_latency_ms", "p99_latency_ms", "impact_score",
    )


STAT_COLUMNS = (
    "queryid", "dbid", "userid", "query", "calls", "total_exec_time_ms", "mean_exec_time_ms",
    "stddev_exec_time_ms", "min_exec_time_ms", "max_exec_time_ms", "rows", "shared_blks_hit",
    "shared_blks_read",
)


def comparable_stats(rows: DataFrame) -> DataFrame:
    out = rounded(rows, "total_exec_time_ms", "mean_exec_time_ms")
    return rounded(out, "stddev_exec_time_ms", places=3)


@register
def j1_history_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return comparable_stats(counters.history_deltas(history(spark, sf)))


@register
def j1_capture_delta(spark: SparkSession, sf: str) -> DataFrame:
    h = history(spark, sf)
    latest = counters.latest_capture(h)
    previous = counters.latest_capture(h, before=latest)
    rows = counters.delta_rows(
        h.filter(F.col("captured_at") == latest), h.filter(F.col("captured_at") == previous)
    )
    return comparable_stats(rows)


@register
def j2_previous_capture(spark: SparkSession, sf: str) -> DataFrame:
    return counters.capture_times(history(spark, sf))


@register
def j4_long_retrieval_scores(spark: SparkSession, sf: str) -> DataFrame:
    lines = bridges.table(spark, sf, "lineitem")
    item = F.col("l_partkey").alias("item")
    retrieved = lines.select("l_orderkey", item, F.col("l_linenumber").alias("rank"))
    relevant = lines.filter("l_returnflag = 'R'").select("l_orderkey", item)
    out = evaluation.scored_long(retrieved, relevant, "l_orderkey", k=3)
    return rounded(out, "reciprocal_rank", "precision_at_k", "recall_at_k")


@register
def a2_pooled_statements(spark: SparkSession, sf: str) -> DataFrame:
    pooled = counters.pooled_snapshots(
        history(spark, sf).withColumn("day", F.col("captured_at")), now(), now(), now(),
        min_calls=5, by=("day",),
    )
    return comparable(pooled)


@register
def a3_capture_summary(spark: SparkSession, sf: str) -> DataFrame:
    return counters.captures(history(spark, sf), limit=20)


@register
def a4_recent_slo_metrics(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.expr("timestamp_ntz'2024-01-20 00:30:00'")
    metrics = evaluation.recent_workload_metrics(day_snapshots(spark, sf), as_of)
    return rounded(metrics, "avg_p95_latency", "avg_p99_latency", "avg_error_rate")


@register
def a5_slo_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.expr("timestamp_ntz'2024-01-20 00:30:00'")
    metrics = evaluation.recent_workload_metrics(day_snapshots(spark, sf), as_of)
    checked = evaluation.slo_check(metrics, p95_ms=20.0, p99_ms=1000.0, error_rate=0.001)
    return rounded(
        checked.select(
            "slo_passed", joined(F.map_keys("violations")).alias("violated"),
            F.col("violations")["p95_latency"]["threshold"].alias("p95_threshold"),
            "p95_latency_ms", "p99_latency_ms", "error_rate", "total_queries", "total_errors",
        ),
        "p95_latency_ms", "p99_latency_ms", "error_rate",
    )


@register
def a6_rag_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        evaluation.rag_metrics(golden(spark, sf)), "mrr", "precision_at_10", "recall_at_10"
    )


@register
def a7_slo_compliance(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.slo_compliance(eval_results(spark, sf), now(), days=20)
    return rounded(out, "pass_rate", "avg_p95_latency", "avg_error_rate")


@register
def a8_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    stored = day_snapshots(spark, sf)
    recommendations = recommend.heuristic(stored, now(), by=("query_source",))
    return listings.status_counts(stored, eval_results(spark, sf), recommendations)


# --- ranked listings ---------------------------------------------------------------------------


@register
def t2_top_impact_latest(spark: SparkSession, sf: str) -> DataFrame:
    top = listings.top_impact_latest(day_snapshots(spark, sf))
    return rounded(rounded(top, "p95_latency_ms"), "impact_score", places=3)


@register
def t3_top_impact_all(spark: SparkSession, sf: str) -> DataFrame:
    top = listings.top_impact(day_snapshots(spark, sf)).select(
        "snapshot_timestamp", "query_fingerprint", "execution_count", "impact_score"
    )
    return rounded(top, "impact_score", places=3)


def _recommendations(spark: SparkSession, sf: str) -> DataFrame:
    responses = bridges.view(spark, sf, bridges.RESPONSES)
    parsed = recommend.parse_responses(responses, now(), "model", "v1").filter("reject_reason IS NULL")
    return parsed.withColumn(
        "recommendation_timestamp",
        F.col("recommendation_timestamp") - F.make_dt_interval((F.col("doc_id") % 60).cast("int")),
    ).withColumn("recommendation_id", F.concat(F.lit("r"), F.col("doc_id").cast("string")))


@register
def t4_recent_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return listings.recent_recommendations(_recommendations(spark, sf), now())


@register
def t4_latest_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return listings.latest_recommendations(_recommendations(spark, sf))


@register
def t6_proposal_listing(spark: SparkSession, sf: str) -> DataFrame:
    state = review.proposal_state(review_events(spark, sf))
    return review.proposal_listing(state, "rejected", 50).select(
        "proposal_id", "status", "title", "flags", "created_at"
    )


@register
def t7_latest_results(spark: SparkSession, sf: str) -> DataFrame:
    results = eval_results(spark, sf).withColumn(
        "eval_type", F.concat_ws("/", "eval_type", "config_version")
    )
    out = listings.latest_results(results).select(
        "eval_timestamp", "eval_type", "overall_score", "p95_latency_ms", "error_rate", "slo_passed"
    )
    return rounded(out, "overall_score", "p95_latency_ms", "error_rate")


@register
def t8_top_query(spark: SparkSession, sf: str) -> DataFrame:
    top = recommend.top_by_impact(day_snapshots(spark, sf), ("snapshot_timestamp", "query_source"))
    return rounded(
        top.select("snapshot_timestamp", "query_source", "query_fingerprint", "impact_score"),
        "impact_score", places=3,
    )


@register
def t9_top_entries(spark: SparkSession, sf: str) -> DataFrame:
    top = report.top_entries(day_snapshots(spark, sf), ("snapshot_timestamp",), 10)
    return top.select("snapshot_timestamp", "rank", "query_fingerprint", "execution_count")


@register
def t11_first_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    first = workload.by_impact(
        workload.workload_snapshots(query_log(spark, sf), now(), WEEK)
    ).limit(5)
    return rounded(
        rounded(first.select("query_type", "execution_count", "p95_latency_ms", "impact_score"), "p95_latency_ms"),
        "impact_score", places=3,
    )


# --- sinks -----------------------------------------------------------------------------------------


@register
def k1_snapshot_upsert(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "snapshots")
    daily = day_snapshots(spark, sf)
    sinks.save_snapshots(spark, daily, path)
    rerun = daily.filter("day(snapshot_timestamp) BETWEEN 18 AND 22").withColumns(
        {
            "execution_count": F.col("execution_count") + 1000,
            "p50_latency_ms": F.lit(-1.0),
            "p95_latency_ms": F.lit(-2.0),
        }
    )
    # Each key twice, of which the higher count stays, and a day from another source.
    lower = rerun.withColumn("execution_count", F.col("execution_count") - 500)
    added = rerun.filter("day(snapshot_timestamp) = 22").withColumn("query_source", F.lit("rerun"))
    sinks.save_snapshots(spark, lower.unionByName(rerun).unionByName(added), path)
    return tables.read_table(spark, path, "workload_snapshots").select(
        "snapshot_timestamp", "query_fingerprint", "query_source", "execution_count",
        F.col("p50_latency_ms").cast("double").alias("p50_latency_ms"),
        F.col("p95_latency_ms").cast("double").alias("p95_latency_ms"),
        F.col("max_latency_ms").cast("double").alias("max_latency_ms"),
    )


def _stored_history(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "captures")
    sinks.save_capture(history(spark, sf), F.col("captured_at"), path)
    return path


@register
def k2_capture_append(spark: SparkSession, sf: str) -> DataFrame:
    stored = tables.read_table(spark, _stored_history(spark, sf), "stat_snapshots")
    return rounded(
        stored.select(
            "captured_at", "queryid", "userid", "query_fingerprint", "query_type", "query", "calls",
            "total_exec_time_ms",
        ),
        "total_exec_time_ms",
    )


@register
def k3_retention(spark: SparkSession, sf: str) -> DataFrame:
    path = _stored_history(spark, sf)
    bound = counters.retention_bound(now(), retention_days=20)
    removed = sinks.prune_captures(spark, path, bound)
    kept = tables.read_table(spark, path, "stat_snapshots")
    return kept.groupBy("captured_at").agg(
        F.count(F.lit(1)).alias("statements"), F.lit(removed).cast("bigint").alias("removed")
    )


@register
def k4_capture_export(spark: SparkSession, sf: str) -> DataFrame:
    stored = counters.as_capture(history(spark, sf), F.col("captured_at"))
    path = scratch_path(spark, "export")
    sinks.export_csv(
        counters.export_rows(stored, datetime(2024, 1, 10), datetime(2024, 1, 20)), path
    )
    return spark.read.csv(path, header=True, escape='"').select(
        "captured_at", "queryid", "userid", "query_fingerprint", "calls", "rows"
    )


@register
def k5_result_append(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "results")
    sinks.save_result(evaluation.rag_result(golden(spark, sf), now()), path)
    sinks.save_result(eval_results(spark, sf), path)
    return tables.read_table(spark, path, "eval_results").select(
        "eval_timestamp", "eval_type", "config_version",
        F.col("overall_score").cast("string").alias("overall_score"),
        F.col("p95_latency_ms").cast("string").alias("p95_latency_ms"),
        "slo_passed", "test_count",
    )


@register
def k6_recommendation_append(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "recommendations")
    sinks.save_recommendations(_recommendations(spark, sf), path)
    return tables.read_table(spark, path, "recommendations").select(
        "recommendation_id", "recommendation_timestamp", "recommendation_type", "title",
        F.col("confidence_score").cast("string").alias("confidence_score"),
    )


@register
def k7_review_event_append(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "ledger")
    sinks.save_events(review_events(spark, sf), path)
    return (
        tables.read_table(spark, path, "review_events")
        .groupBy("action").agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("newest"))
    )


@register
def v1_constraint_violations(spark: SparkSession, sf: str) -> DataFrame:
    log = workload.with_fingerprint(query_log(spark, sf)).withColumn(
        "snapshot_timestamp", F.to_date("ts").cast("timestamp_ntz")
    )
    return listings.unique_key_violations(
        log.withColumnRenamed("source", "query_source"), sinks.SNAPSHOT_KEY
    )


@register
def v1_proposal_constraints(spark: SparkSession, sf: str) -> DataFrame:
    rows = review_events(spark, sf).select(
        "seq",
        F.when(F.col("seq") % 3 == 0, "rejected").when(F.col("seq") % 3 == 1, "open")
        .otherwise("pending").alias("status"),
        F.when(F.col("seq") % 2 == 0, F.lit("")).otherwise(F.col("reason")).alias("reason"),
    )
    return listings.proposal_violations(rows, fixed.STATUSES).select("seq", "violation")


# --- review ledger --------------------------------------------------------------------------------


def _state_columns(state: DataFrame) -> DataFrame:
    return state.select(
        "proposal_id", "status", "reviewed_by", "reviewed_at", "reason", "applied_by", "applied_at",
        "apply_error",
    )


@register
def r1_proposal_state(spark: SparkSession, sf: str) -> DataFrame:
    return _state_columns(review.proposal_state(review_events(spark, sf)))


@register
def r1_proposal_state_mode_off(spark: SparkSession, sf: str) -> DataFrame:
    return _state_columns(review.proposal_state(review_events(spark, sf), mode_on=False))


@register
def r2_propose_check(spark: SparkSession, sf: str) -> DataFrame:
    return review.checked(proposed(spark, sf)).select(
        "proposal_id", "parse_ok", "parse_error", joined(F.col("destructive")).alias("destructive")
    )


@register
def r5_audit_log(spark: SparkSession, sf: str) -> DataFrame:
    return review.audit_log(review_events(spark, sf)).select(
        "ts", "seq", "proposal_id", "action", "actor", "reason"
    )


@register
def r7_audit_listing(spark: SparkSession, sf: str) -> DataFrame:
    return review.audit_listing(review.audit_log(review_events(spark, sf)), limit=100).select(
        "seq", "proposal_id", "action"
    )


@register
def r9_enqueue(spark: SparkSession, sf: str) -> DataFrame:
    return review.enqueue(schemas.conform(_recommendations(spark, sf), schemas.RECOMMENDATION)).select(
        "ts", "proposal_id", "action", "sql", "title", "source", "recommendation_id", "target_db"
    )


@register
def r10_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = review.checked(proposed(spark, sf))
    return rows.select(
        "proposal_id", sqlcheck.flags(F.col("parse_ok"), F.col("destructive")).alias("flags")
    )


# --- end-to-end jobs ---------------------------------------------------------------------------------


@register
def o1_profile_logs(spark: SparkSession, sf: str) -> DataFrame:
    snapshots = pipelines.profile_logs(
        spark, {"postgres_logs": {"enabled": True, "log_path": render.log_files(spark, sf, render.STDERR)}},
        now(), WEEK,
    )
    return comparable(snapshots).select(
        "snapshot_timestamp", "query_fingerprint", "query_type", "query_source", "execution_count",
        "p50_latency_ms", "p95_latency_ms", "p99_latency_ms", "impact_score",
    )


@register
def o1_profile_and_store(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "snapshots")
    sources = {"postgres_logs": {"enabled": True, "log_path": render.log_files(spark, sf, render.STDERR)}}
    for _ in range(2):
        pipelines.store_log_profile(spark, sources, now(), path, WEEK)
    return comparable(tables.read_table(spark, path, "workload_snapshots")).select(
        "snapshot_timestamp", "query_fingerprint", "query_type", "query_source", "execution_count",
        "p50_latency_ms", "p95_latency_ms", "p99_latency_ms", "impact_score",
    )


@register
def o2_profile_and_store(spark: SparkSession, sf: str) -> DataFrame:
    """Two profiles in a row: the last stored capture again, which is idle, then changed counters."""
    path, kept = _stored_history(spark, sf), scratch_path(spark, "snapshots")
    latest = counters.latest_capture(history(spark, sf))
    live = staged(history(spark, sf).filter(F.col("captured_at") == latest), "live")
    later = live.withColumns({"calls": F.col("calls") + 7, "total_exec_time_ms": F.col("total_exec_time_ms") + 70})
    for view, at in ((live, "00:00:00"), (later, "01:00:00")):
        stamp = F.expr(f"timestamp_ntz'2024-02-01 {at}'")
        pipelines.store_statement_profile(spark, view, stamp, kept, path, retention_days=None)
    stored = tables.read_table(spark, path, "stat_snapshots").filter(F.col("captured_at") >= now())
    captures = stored.groupBy("captured_at").agg(F.count("*").alias("rows"), F.sum("calls").alias("calls"))
    snapshots = tables.read_table(spark, kept, "workload_snapshots")
    new = snapshots.groupBy(F.col("snapshot_timestamp").alias("captured_at")).agg(F.sum("execution_count").alias("new_calls"))
    return captures.join(new, "captured_at", "left")


@register
def o5_recommend_and_store(spark: SparkSession, sf: str) -> DataFrame:
    kept, ledger = scratch_path(spark, "recommendations"), scratch_path(spark, "events")
    pipelines.recommend_and_queue(
        listings.top_impact(day_snapshots(spark, sf)), now(), recommendation_path=kept, event_path=ledger
    )
    events = tables.read_table(spark, ledger, "review_events").select(
        "recommendation_id", F.col("sql").alias("queued_sql")
    )
    return tables.read_table(spark, kept, "recommendations").join(events, "recommendation_id").select(
        "recommendation_timestamp", "status", "priority", "recommendation_type", "title", "rationale",
        "risk_level", "queued_sql", "rollback_sql", "model_name",
    )


@register
def o2_profile_statements(spark: SparkSession, sf: str) -> DataFrame:
    h = history(spark, sf)
    latest = counters.latest_capture(h)
    live = h.filter(F.col("captured_at") == latest)
    earlier = h.filter(F.col("captured_at") < latest)
    snapshots = pipelines.profile_statements(live, earlier, latest, limit=None)
    return comparable(snapshots).select(
        "window_start", "window_end", "query_fingerprint", "example_query", "execution_count",
        "avg_execution_time_ms", "min_latency_ms", "max_latency_ms", "avg_rows_returned", "impact_score",
    )


@register
def o3_capture_only(spark: SparkSession, sf: str) -> DataFrame:
    path = _stored_history(spark, sf)
    view = bridges.view(spark, sf, bridges.STAT_VIEW)
    pipelines.capture_only(spark, view, now(), path, retention_days=10, dbid=1)
    return counters.captures(tables.read_table(spark, path, "stat_snapshots"))


@register
def o4_evaluate_all(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.expr("timestamp_ntz'2024-01-20 00:30:00'")
    results = pipelines.evaluate(golden(spark, sf), day_snapshots(spark, sf), as_of)
    return rounded(
        results.select(
            "eval_timestamp", "eval_type", "overall_score", "p95_latency_ms", "error_rate",
            "rag_recall_at_k", "slo_passed", "test_count",
        ),
        "overall_score", "p95_latency_ms", "error_rate", "rag_recall_at_k",
    )


@register
def o5_recommend(spark: SparkSession, sf: str) -> DataFrame:
    recommendations, queued = pipelines.recommend_and_queue(
        listings.top_impact(day_snapshots(spark, sf)), now()
    )
    return recommendations.join(
        queued.select("recommendation_id", F.col("sql").alias("queued_sql")), "recommendation_id"
    ).select(
        "recommendation_timestamp", "status", "priority", "recommendation_type", "title", "rationale",
        "risk_level", "queued_sql", "rollback_sql", "model_name",
    )


@register
def o6_run_all(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        pipelines.run_all(query_log(spark, sf), golden(spark, sf), now(), WEEK), "score", places=3
    )


# Registers the queries over streams, panes and stored runs.
from worklens.plans import incremental  # noqa: E402, F401
