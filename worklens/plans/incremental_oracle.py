"""DuckDB SQL for the queries of :mod:`worklens.plans.incremental`."""

from __future__ import annotations

import math


def statements() -> dict[str, str]:
    from worklens.plans import oracle as o

    r = o.r
    width = math.log(1.01 / 0.99)

    def slotted(value: str) -> str:
        """The value that stands for the slot of a positive value."""
        return f"2e-6 / (exp({width!r}) + 1) * exp({width!r} * ceil(ln({value} / 1e-6) / {width!r}))"

    def shown(values: str) -> str:
        return ", ".join(f"{r(slotted(o.percentile(values, q)))} AS {n}" for n, q in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99)))

    # Rows with a time of their own; the last hours stay open.
    timed = f"SELECT *, date_trunc('hour', ts) AS hour, {o.fingerprint('query')} AS fp FROM ({_with_times(o)})"
    out = {
        "a1_streamed_hours": f"""
SELECT hour, fp AS query_fingerprint, count(*) AS executions, {r('sum(execution_time_ms)', 3)} AS total_ms,
  {r('min(execution_time_ms)', 3)} AS min_ms, {r('max(execution_time_ms)', 3)} AS max_ms,
  CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS bigint) AS errors, {shown('list_sort(list(execution_time_ms))')}
FROM ({timed}) WHERE hour + INTERVAL 2 HOUR <= (SELECT max(ts) FROM ({timed})) GROUP BY hour, fp""",
        "a1_streamed_late_rows": f"""
SELECT hour, count(*) AS rows, count(DISTINCT fp) AS patterns, CASE WHEN late THEN 'late' ELSE 'stored' END AS outcome
FROM (SELECT *, original < TIMESTAMP '2024-01-15' AND hour + INTERVAL 1 HOUR + INTERVAL 2 DAY <= (SELECT max(ts) FROM ({timed})) AS late FROM ({timed}))
GROUP BY hour, late""",
        "p7_streamed_rejects": f"""
SELECT coalesce(reject_reason, 'none') AS reject_reason, count(*) AS lines FROM ({o.JSON_ROWS}) GROUP BY 1""",
        "a1_sketch_percentiles": f"""
SELECT day, fp AS query_fingerprint, count(*) AS executions, {shown('list_sort(list(execution_time_ms))')}
FROM ({o.FINGERPRINTED}) GROUP BY day, fp""",
        "p1_sliding_snapshots": f"""
SELECT window_end - INTERVAL 24 HOUR AS window_start, window_end, query_fingerprint, query_type, query_source, execution_count, error_count,
  {', '.join(f'{r(n)} AS {n}' for n in ('p50_latency_ms', 'p95_latency_ms', 'p99_latency_ms', 'avg_rows_returned'))}, {r('impact_score', 3)} AS impact_score
FROM ({o.snapshots(f"SELECT *, unnest(generate_series(date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS window_end FROM ({o.FINGERPRINTED})", 'window_end')})""",
        "r5_streamed_audit": o.ORACLE["r5_audit_log"],
        "r1_streamed_state": o.ORACLE["r1_proposal_state"],
        "p9_second_check": o.gate(True, "ev.seq % 3 <> 0"),
        "f17_clause_order": _clause_order(o),
        "s5_source_status": f"""
SELECT 'nowhere_logs' AS source, 0 AS source_ord, 'failed' AS status, 0::bigint AS rows, 0::bigint AS read_back
UNION ALL SELECT 'postgres_logs', 1, 'stored', count(*), count(*) FROM ({o.STDERR_ROWS})
UNION ALL SELECT 'vector_logs', 2, 'failed', 0, 0
UNION ALL SELECT 'application_logs', 3, 'stored', count(*), count(*) FROM ({o.JSON_ACCEPTED})
UNION ALL SELECT 'other_logs', 4, 'skipped', 0, 0""",
        "o6_run_and_store": f"""
WITH s AS MATERIALIZED ({o.snapshots(o._LOGGED_WEEK)}),
top AS (SELECT * FROM s ORDER BY impact_score DESC, query_fingerprint LIMIT 1)
SELECT 'snapshot' AS step, query_fingerprint AS item, {r('impact_score', 1)} AS score FROM s
UNION ALL SELECT 'result', 'rag_accuracy', {r('mrr', 1)} FROM ({o.RAG})
UNION ALL SELECT 'result', 'slo_check', {r('avg(p95_latency_ms)', 1)} FROM s
UNION ALL SELECT 'recommendation', concat('Explain high-impact query (', query_type, ')'), {r('0.4::double', 1)} FROM top
UNION ALL SELECT 'event', concat(CASE WHEN query_type = 'SELECT' THEN 'EXPLAIN (ANALYZE, BUFFERS) ' ELSE 'EXPLAIN ' END,
  rtrim(trim(example_query), ';'), ';'), {r('0.4::double', 1)} FROM top
UNION ALL SELECT 'source', 'vector_logs failed', {r('0.0::double', 1)}
UNION ALL SELECT 'source', 'postgres_logs stored', {r('0.0::double', 1)}""",
        "f20_analysis_report": _report(o),
        "r7_audit_of_proposals": f"""
WITH most AS (SELECT proposal_id FROM ({o.EVENTS}) WHERE proposal_id <> 'gone' GROUP BY 1 ORDER BY count(*) DESC, proposal_id LIMIT 1)
SELECT proposal_id, seq, action FROM ({o.AUDIT}) WHERE proposal_id = (SELECT proposal_id FROM most)
UNION ALL SELECT proposal_id, 0, status FROM ({o.state(True)}) WHERE proposal_id = (SELECT proposal_id FROM most)""",
        "t6_all_proposals": f"""
SELECT proposal_id, title, CASE WHEN parse_error IS NULL THEN replace(all_reasons, '|', ', ') ELSE 'PARSE FAILED' END AS flags,
  p.ts AS created_at
FROM ({o.state(True)}) s JOIN ({o.PROPOSED}) p USING (proposal_id) JOIN ({o.CHECKED}) c USING (proposal_id)
WHERE status = 'approved'""",
        "s6c_reset_window": f"""
SELECT (SELECT min(ts) FROM ({o.LOG})) AS window_start, {o.NOW} AS window_end, query_fingerprint, execution_count,
  {r('avg_execution_time_ms')} AS avg_execution_time_ms, {r('execution_count * avg_execution_time_ms', 3)} AS impact_score
FROM ({o.pooled(_live(o), 'captured_at, previous_at', 1)})""",
        "v1_uniqueness_by_day_filters": f"""
WITH again AS (SELECT * FROM ({o.DAILY}) WHERE snapshot_timestamp IN (TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-20'))
SELECT snapshot_timestamp, query_fingerprint, query_source, 2::bigint AS copies,
  CAST((SELECT count(DISTINCT snapshot_timestamp) FROM again) AS int) AS days_read FROM again""",
        "t12_export_order": f"""
SELECT row_number() OVER (ORDER BY captured_at, queryid NULLS LAST, query_fingerprint) AS place, captured_at, queryid, query_fingerprint
FROM (SELECT *, {o.fingerprint('query')} AS query_fingerprint FROM ({o.HISTORY}))""",
    }
    return out


def _with_times(o) -> str:
    """Accepted JSON rows that have a readable time."""
    return f"""
SELECT ts AS original, CASE WHEN k % 3 = 0 THEN ts ELSE date_trunc('second', ts) END AS ts, CASE WHEN k % 29 = 5 THEN '' ELSE query END AS query,
  execution_time_ms, CASE k % 31 WHEN 8 THEN false WHEN 9 THEN true ELSE success END AS success
FROM ({o.JSON_ROWS}) WHERE reject_reason IS NULL AND k % 19 <> 18"""


def _live(o) -> str:
    """The scan of the statement view for one database, in the form that pooling takes."""
    return f"""
SELECT {o.NOW} AS captured_at, NULL::timestamp AS previous_at, * FROM ({o.ORACLE["s6_statement_scan"].replace("calls >= 2", "calls >= 1")})"""


def _clause_order(o) -> str:
    """Numbers of kept, moved, removed and added clauses; the longest common subsequence by trying all parts of the old side."""
    new_line = "chr(10) || chr(92) || '1'"
    cut = f"regexp_replace({{0}}, {o.quoted(o._CUT)}, {new_line}, 'g')"
    return f"""
WITH n AS (SELECT proposal_id, coalesce({o._clauses('current_sql')}, '') AS old, {o._clauses('sql')} AS new FROM ({o.PROPOSED})),
c AS (SELECT proposal_id, CASE WHEN old = '' THEN [] ELSE string_split({cut.format('old')}, chr(10)) END AS olds,
  CASE WHEN new = '' THEN [] ELSE string_split({cut.format('new')}, chr(10)) END AS news FROM n),
part AS (SELECT proposal_id, olds, news, unnest(range(CAST(pow(2, len(olds)) AS bigint))) AS mask FROM c),
tried AS (SELECT proposal_id, bit_count(mask) AS size, '.*' || array_to_string(list_transform(list_filter(range(len(olds)), lambda i: (mask >> i) & 1 = 1), lambda i: md5(olds[i + 1])), '.*') AS wanted,
  array_to_string(list_transform(news, lambda x: md5(x)), ' ') AS given FROM part),
longest AS (SELECT proposal_id, max(size) AS kept FROM tried WHERE regexp_matches(given, wanted) GROUP BY 1),
common AS (SELECT proposal_id, sum(least(a.n, b.n)) AS shared FROM
    (SELECT proposal_id, x, count(*) AS n FROM (SELECT proposal_id, unnest(olds) AS x FROM c) GROUP BY ALL) a
    JOIN (SELECT proposal_id, x, count(*) AS n FROM (SELECT proposal_id, unnest(news) AS x FROM c) GROUP BY ALL) b USING (proposal_id, x) GROUP BY 1)
SELECT proposal_id, CAST(kept AS int) AS kept, CAST(coalesce(shared, 0) - kept AS int) AS moved,
  CAST(len(olds) - coalesce(shared, 0) AS int) AS removed, CAST(len(news) - coalesce(shared, 0) AS int) AS added
FROM c JOIN longest USING (proposal_id) LEFT JOIN common USING (proposal_id)"""


def _report(o) -> str:
    nl = "chr(10)"
    workload = f"SELECT workload_summary FROM ({o.ORACLE['f20_workload_report']}) WHERE snapshot_timestamp = TIMESTAMP '2024-01-10 00:00:00'"
    results = o.ORACLE["f20_eval_report"]
    p99 = f"""'- P99 Latency: ', printf('%.2f', p95_latency_ms * 2), 'ms', chr(10)"""
    violations = """CASE WHEN p95_latency_ms > 100 THEN concat('- SLO Violations: [', chr(39), 'p95_latency', chr(39), ']', chr(10)) ELSE '' END,"""
    results = results.replace(", chr(10),\n    " + p99 + ")", ", chr(10))").replace(violations, "")
    kinds = f"(SELECT event_type, max(k) AS k FROM ({o.LOG}) GROUP BY 1)"
    return f"""
SELECT concat('# Database Performance Analysis Request', {nl}, {nl}, 'Date: 2024-02-01T00:00:00', {nl}, {nl}, ({workload}), (SELECT eval_summary FROM ({results})),
  '## Database Schema', {nl}, {nl}, '### Tables', {nl}, (SELECT string_agg(concat('- ', event_type, {nl}, '  - id: bigint', {nl}), '' ORDER BY event_type) FROM {kinds}), {nl},
  '### Existing Indexes', {nl}, (SELECT string_agg(concat('- ix_', event_type, ' on ', event_type, {nl}), '' ORDER BY event_type) FROM {kinds}), {nl},
  '## Current Configuration', {nl}, {nl}, '```yaml', {nl}, (SELECT string_agg(concat(event_type, ': ', k, {nl}), '' ORDER BY event_type) FROM {kinds}), '```', {nl}, {nl},
  '## Focus Areas', {nl}, {nl}, '- Latency', {nl}, '- Cost', {nl}, {nl}) AS report"""
