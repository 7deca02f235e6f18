"""DuckDB SQL for the registered queries: an independent statement of each result.

Logic is written the direct way (lists per group, recursive replay of the ledger), not
the way the Spark operators do it.
"""

from __future__ import annotations

from worklens.plans import bridges
from worklens.plans.bridges import duck

NOW = "TIMESTAMP '2024-02-01 00:00:00'"
LOG = duck(bridges.QUERY_LOG)
HISTORY = duck(bridges.STAT_HISTORY)
VIEW = duck(bridges.STAT_VIEW)
RESULTS = duck(bridges.EVAL_RESULTS)
EVENTS = duck(bridges.REVIEW_EVENTS)
RESPONSES = duck(bridges.RESPONSES)
GOLDEN = bridges.DUCK_GOLDEN


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replaced(expr: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({expr}, {quoted(pattern)}, {quoted(replacement)}, 'g')"


def r(expr: str, places: int = 6) -> str:
    return f"round({expr} + 1e-9, {places})"


def fingerprint(query: str, literals: bool = True, whitespace: bool = True, case: bool = True) -> str:
    out = f"upper({query})" if case else query
    if literals:
        for pattern, replacement in (
            (r"/\*\s*,\s*\.\.\.\s*\*/", ""), (r"\$\d+\b", "?"), (r"'([^']|'')*'", "?"),
            (r"\b\d+\.\d+\b", "?"), (r"\b\d+\b", "?"), (r"\([\s?,]*\)", "(?)"),
        ):
            out = replaced(out, pattern, replacement)
    if whitespace:
        out = f"trim({replaced(out, chr(92) + 's+', ' ')})"
    return out


def query_type(query: str) -> str:
    kinds = "SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|TRUNCATE|BEGIN|COMMIT|ROLLBACK|WITH"
    found = f"regexp_extract(upper({query}), '^\\s*({kinds})', 1)"
    return f"coalesce(nullif({found}, ''), 'OTHER')"


def percentile(values: str, q: float) -> str:
    """0-based index int(n * q) of an ascending list; lists count from 1 here."""
    return f"{values}[CAST(floor(len({values}) * CAST({q} AS double)) AS bigint) + 1]"


def snapshots(rows: str, keys: str = "", min_count: int = 5) -> str:
    """Snapshot rows of a relation that has the query-log columns and ``fp``."""
    k = f"{keys}, " if keys else ""
    return f"""
SELECT {k}fp AS query_fingerprint, arg_min(kind, seq) AS query_type, arg_min(source, seq) AS query_source,
  arg_min(query, seq) AS example_query, count(*) AS execution_count,
  sum(execution_time_ms) AS total_execution_time_ms, avg(execution_time_ms) AS avg_execution_time_ms,
  {percentile('list_sort(list(execution_time_ms))', 0.50)} AS p50_latency_ms,
  {percentile('list_sort(list(execution_time_ms))', 0.95)} AS p95_latency_ms,
  {percentile('list_sort(list(execution_time_ms))', 0.99)} AS p99_latency_ms,
  max(execution_time_ms) AS max_latency_ms, min(execution_time_ms) AS min_latency_ms,
  avg(rows_returned) AS avg_rows_returned, avg(rows_scanned) AS avg_rows_scanned,
  avg(buffer_hits) AS avg_buffer_hits, avg(buffer_misses) AS avg_buffer_misses,
  CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS bigint) AS error_count,
  sum(CASE WHEN success THEN 0 ELSE 1 END) / count(*) AS error_rate,
  count(*) * avg(execution_time_ms) AS impact_score
FROM ({rows}) GROUP BY {k}fp HAVING count(*) >= {min_count}"""


FINGERPRINTED = f"""
SELECT *, {fingerprint('query')} AS fp, coalesce(query_type, {query_type('query')}) AS kind,
  CAST(CAST(ts AS date) AS timestamp) AS day FROM ({LOG})"""
DAILY = "SELECT * RENAME (day AS snapshot_timestamp) FROM (" + snapshots(FINGERPRINTED, "day") + ")"
WEEKLY_ROWS = f"""
SELECT * FROM ({FINGERPRINTED}) WHERE ts >= (SELECT max(ts) FROM ({LOG})) - INTERVAL 10080 MINUTE"""

MEASURES = (
    "total_execution_time_ms", "avg_execution_time_ms", "p50_latency_ms", "p95_latency_ms",
    "p99_latency_ms", "max_latency_ms", "min_latency_ms", "avg_rows_returned",
    "avg_rows_scanned", "avg_buffer_hits", "avg_buffer_misses", "error_rate",
)
COMPARABLE = ", ".join(f"{r(m)} AS {m}" for m in MEASURES) + f", {r('impact_score', 3)} AS impact_score"

ORACLE: dict[str, str] = {}

# --- sources ---------------------------------------------------------------------------------

STDERR_STATEMENT = """trim(concat(query, CASE WHEN k % 7 = 0 THEN concat(chr(10), 'MALFORMED LINE') ELSE '' END))"""
STDERR_ROWS = f"""
SELECT date_trunc('millisecond', ts) AS ts, concat({STDERR_STATEMENT},
    CASE WHEN k % 11 = 0 THEN ' /* pg_log_tz=EST */' ELSE '' END) AS query,
  execution_time_ms, seq FROM ({LOG}) WHERE k % 13 NOT IN (0, 1)"""
ORACLE["s1_stderr_log_scan"] = f"""
SELECT ts, query, execution_time_ms, true AS success, 'postgres' AS source FROM ({STDERR_ROWS})"""

ORACLE["s4_csv_log_scan"] = ORACLE["s1_stderr_log_scan"]

JSON_ROWS = f"""
SELECT *, CASE WHEN k % 23 = 3 THEN 'not JSON' WHEN k % 23 = 4 THEN 'not an object'
    WHEN k % 29 = 6 THEN 'bad query' WHEN k % 31 = 7 THEN 'bad success'
    WHEN k % 37 = 1 THEN 'bad rows_returned' END AS reject_reason
FROM ({LOG}) WHERE k % 23 <> 5"""
JSON_ACCEPTED = f"""
SELECT CASE WHEN k % 19 = 18 THEN {NOW} WHEN k % 3 = 0 THEN ts ELSE date_trunc('second', ts) END AS ts,
  CASE WHEN k % 29 = 5 THEN '' ELSE query END AS query, execution_time_ms,
  CASE k % 37 WHEN 2 THEN 12 WHEN 3 THEN 3 ELSE rows_returned END AS rows_returned,
  CASE k % 31 WHEN 8 THEN false WHEN 9 THEN true ELSE success END AS success,
  CASE WHEN success THEN NULL ELSE 'failed, badly' END AS error_message,
  'application' AS source, concat('db', user_id % 3) AS database
FROM ({JSON_ROWS}) WHERE reject_reason IS NULL"""
ORACLE["s2_json_log_scan"] = JSON_ACCEPTED
ORACLE["p7_json_log_rejects"] = f"""
SELECT reject_reason, count(*) AS lines FROM ({JSON_ROWS}) WHERE reject_reason IS NOT NULL GROUP BY 1"""

VECTOR_ROWS = f"""
SELECT CASE k % 9 WHEN 0 THEN {NOW} WHEN 2 THEN ts - INTERVAL 2 HOUR ELSE ts END AS ts,
  concat('{{"collection": ', CASE WHEN k % 10 = 0 THEN 'null' ELSE concat('"c', user_id % 5, '"') END,
    ', "query_vector": "[...]", "top_k": ', k, ', "filter": ',
    CASE k % 4 WHEN 0 THEN '{{"z": "a, b: c", "n": [1, 2]}}' WHEN 1 THEN '"x,y"' ELSE 'null' END, '}}') AS query,
  'VECTOR_SEARCH' AS query_type,
  CASE WHEN k % 12 = 0 THEN 0.0::double ELSE execution_time_ms END AS execution_time_ms,
  CAST(k % 50 AS bigint) AS rows_returned, success, 'vector_db' AS source
FROM ({LOG}) WHERE k % 9 <> 1"""
ORACLE["s3_vector_log_scan"] = VECTOR_ROWS
ORACLE["s4_source_dispatch"] = f"""
SELECT 'postgres' AS source, 3 AS source_ord, count(*) AS entries FROM ({JSON_ACCEPTED})"""
ORACLE["s5_multi_source_collect"] = f"""
SELECT 'postgres' AS source, 0 AS source_ord, NULL::varchar AS query_type, count(*) AS entries,
  {r('sum(execution_time_ms)', 3)} AS total_ms FROM ({STDERR_ROWS})
UNION ALL SELECT 'vector_db', 1, 'VECTOR_SEARCH', count(*), {r('sum(execution_time_ms)', 3)} FROM ({VECTOR_ROWS})
UNION ALL SELECT 'application', 2, NULL, count(*), {r('sum(execution_time_ms)', 3)} FROM ({JSON_ACCEPTED})"""
ORACLE["s6_statement_scan"] = f"""
SELECT queryid, dbid, userid, query, calls, total_time AS total_exec_time_ms,
  coalesce(mean_time, 0) AS mean_exec_time_ms, coalesce(stddev_time, 0) AS stddev_exec_time_ms,
  min_time AS min_exec_time_ms, max_time AS max_exec_time_ms, coalesce(rows, 0) AS rows,
  shared_blks_hit, shared_blks_read
FROM ({VIEW})
WHERE calls >= 2 AND dbid = 1 AND query IS NOT NULL AND query <> '<insufficient privilege>'
  AND NOT regexp_matches(query, '(?i)^\\s*(BEGIN|COMMIT|ROLLBACK|SET|SHOW|RESET|DISCARD)\\b')
  AND query NOT ILIKE '%pg\\_stat\\_statements%' ESCAPE '\\'"""
ORACLE["t10_statement_limit"] = f"""
SELECT * FROM ({ORACLE["s6_statement_scan"]})
ORDER BY mean_exec_time_ms DESC NULLS LAST, queryid NULLS LAST, dbid NULLS LAST, userid NULLS LAST, query NULLS LAST LIMIT 100"""
ORACLE["s7_golden_set_scan"] = f"""
SELECT md5(query) AS query_md5, len(retrieved) AS retrieved, len(relevant) AS relevant FROM ({GOLDEN})"""
ORACLE["s9_load_capture"] = f"""
SELECT queryid, dbid, userid, query, calls, {r('total_exec_time_ms')} AS total_exec_time_ms,
  {r('mean_exec_time_ms')} AS mean_exec_time_ms
FROM ({HISTORY}) WHERE captured_at = (SELECT max(captured_at) FROM ({HISTORY}))"""

# --- scalar functions --------------------------------------------------------------------------

ORACLE["f1_fingerprint"] = f"SELECT seq, {fingerprint('query')} AS query_fingerprint FROM ({LOG})"
ORACLE["f1_fingerprint_flags"] = f"""
SELECT seq, {fingerprint('query', literals=False)} AS keep_literals,
  {fingerprint('query', whitespace=False)} AS keep_whitespace,
  {fingerprint('query', case=False)} AS keep_case FROM ({LOG})"""
ORACLE["f2_query_hash"] = f"""
SELECT seq, substring(sha256({fingerprint('query')}), 1, 16) AS query_hash FROM ({LOG})"""
ORACLE["f3_query_type"] = f"SELECT seq, {query_type('query')} AS query_type FROM ({LOG})"


def _table_matches(keyword: str) -> str:
    pattern = "(?i)\\b" + keyword + '\\s+("?[\\w]+"?\\.?\\w*)'
    return f"regexp_extract_all({replaced('query', '(?i)' + chr(92) + 'bEXTRACT' + chr(92) + 's*' + chr(92) + '([^)]*' + chr(92) + ')', ' ')}, {quoted(pattern)}, 1)"


_FOUND = "list_concat(" + ", ".join(
    _table_matches(k) for k in ("FROM", "JOIN", "UPDATE", "DELETE\\s+FROM", "INSERT\\s+INTO")
) + ")"
ORACLE["f4_table_names"] = f"""
WITH found AS (SELECT seq, {_FOUND} AS names FROM ({LOG})),
each AS (SELECT seq, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM found),
kept AS (SELECT seq, trim(name, '"') AS name, min(pos) AS pos FROM each
  WHERE upper(name) NOT IN ('SELECT', 'WHERE', 'SET', 'VALUES', 'LATERAL') GROUP BY seq, trim(name, '"'))
SELECT f.seq, coalesce(string_agg(name, '|' ORDER BY pos), '') AS tables
FROM found f LEFT JOIN kept USING (seq) GROUP BY f.seq"""
ORACLE["f5_timestamp_coercion"] = f"""
SELECT seq, CASE WHEN k % 7 = 4 THEN date_trunc('millisecond', ts) END AS log_ts,
  CASE k % 7 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts) END AS json_ts,
  CASE k % 7 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts)
    WHEN 3 THEN date_trunc('second', ts) WHEN 4 THEN date_trunc('millisecond', ts) END AS iso_ts
FROM ({LOG})"""
ORACLE["f6_zone_tag"] = f"""
SELECT seq, CASE WHEN k % 3 = 2 THEN concat(query, ' /* pg_log_tz=EST */') ELSE query END AS query FROM ({LOG})"""
ORACLE["f8_counter_coercion"] = f"""
SELECT queryid, calls, coalesce(rows, 0) AS rows, coalesce(mean_time, 0) AS mean_exec_time_ms,
  coalesce(stddev_time, 0) AS stddev_exec_time_ms FROM ({VIEW})"""
_CAP = "CASE WHEN max_exec_time_ms > 0 THEN max_exec_time_ms ELSE 'infinity'::double END"
ORACLE["f10_estimated_percentiles"] = f"""
SELECT captured_at, queryid, userid, query, {r(f'least(mean_exec_time_ms, {_CAP})')} AS p50_latency_ms,
  {r(f'least(mean_exec_time_ms + 1.645::double * stddev_exec_time_ms, {_CAP})')} AS p95_latency_ms,
  {r(f'least(mean_exec_time_ms + 2.326::double * stddev_exec_time_ms, {_CAP})')} AS p99_latency_ms
FROM ({HISTORY})"""
SCORED = f"""
SELECT doc_id, coalesce(1.0::double / list_min(list_filter(
    list_transform(retrieved, lambda x, i: CASE WHEN list_contains(relevant, x) THEN i END), lambda p: p IS NOT NULL)), 0) AS reciprocal_rank,
  CASE WHEN len(retrieved) > 0
    THEN len(list_intersect(retrieved[1:10], relevant)) / len(retrieved[1:10]) ELSE 0 END AS precision_at_k,
  CASE WHEN len(relevant) > 0
    THEN len(list_intersect(retrieved[1:10], relevant)) / len(relevant) END AS recall_at_k
FROM ({GOLDEN})"""
ORACLE["f12_f14_retrieval_scores"] = f"""
SELECT doc_id, {r('reciprocal_rank')} AS reciprocal_rank, {r('precision_at_k')} AS precision_at_k,
  {r('recall_at_k')} AS recall_at_k FROM ({SCORED})"""

# --- SQL checks -----------------------------------------------------------------------------------

PROPOSED = f"SELECT * FROM ({EVENTS}) WHERE action = 'propose'"
_NO_COMMENT = replaced("sql", r"""('(?:[^']|'')*'|"(?:[^"]|"")*")|--[^\n]*|/\*(?s:.*?)\*/""", r"\1 ")
_BLANK = f"upper(trim({replaced(replaced(_NO_COMMENT, chr(39) + '(?:[^' + chr(39) + ']|' + chr(39) * 2 + ')*' + chr(39), chr(39) * 2), chr(92) + 's+', ' ')}))"
_FLAT = "s"
for _ in range(6):
    _FLAT = replaced(_FLAT, r"\([^()]*\)", " ")
_FLAT = f"trim({replaced(_FLAT, chr(92) + 's+', ' ')})"
_FLAT = f"regexp_replace({_FLAT}, '^WITH .*?\\b(SELECT|INSERT|UPDATE|DELETE|MERGE)\\b', '\\1')"
_VERBS = (
    "ABORT ALTER ANALYZE BEGIN CALL CHECKPOINT CLOSE CLUSTER COMMENT COMMIT COPY CREATE DEALLOCATE "
    "DECLARE DELETE DISCARD DO DROP END EXECUTE EXPLAIN FETCH GRANT IMPORT INSERT LISTEN LOAD LOCK MERGE "
    "MOVE NOTIFY PREPARE REASSIGN REFRESH REINDEX RELEASE RESET REVOKE ROLLBACK SAVEPOINT SECURITY SELECT "
    "SET SHOW START TABLE TRUNCATE UNLISTEN UPDATE VACUUM VALUES WITH"
).split()
_VERB_LIST = ", ".join(quoted(v) for v in _VERBS)
CHECKED = f"""
WITH p AS (SELECT proposal_id, sql, current_sql, seq, list_filter(list_transform(string_split({_BLANK}, ';'), lambda t: trim(t)),
    lambda t: t <> '') AS parsed FROM ({PROPOSED})),
st AS (SELECT proposal_id, unnest(parsed) AS s, generate_subscripts(parsed, 1) AS pos FROM p),
flat AS (SELECT proposal_id, pos, s, regexp_extract(s, '^\\(*\\s*([A-Z]+)', 1) AS verb, {_FLAT} AS f FROM st),
cmds AS (SELECT proposal_id, pos, trim(c) AS c, i FROM (
    SELECT proposal_id, pos, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM (
      SELECT proposal_id, pos, string_split(regexp_replace(f, '^ALTER TABLE (?:IF EXISTS )?(?:ONLY )?\\S+ (?:\\* )?', ''), ',') AS cs
      FROM flat WHERE f LIKE 'ALTER TABLE %'))),
reasons AS (
  SELECT proposal_id, pos, 0 AS i, CASE
    WHEN regexp_matches(f, '^DROP MATERIALIZED VIEW\\b') THEN 'DROP MATVIEW'
    WHEN regexp_matches(f, '^DROP (TABLE|INDEX|VIEW)\\b') THEN concat('DROP ', regexp_extract(f, '^DROP ([A-Z]+)', 1))
    WHEN f LIKE 'TRUNCATE%' THEN 'TRUNCATE'
    WHEN f LIKE 'DELETE FROM%' AND NOT regexp_matches(f, '\\bWHERE\\b') THEN 'DELETE without WHERE (deletes every row)'
    WHEN f LIKE 'UPDATE%' AND NOT regexp_matches(f, '\\bWHERE\\b') THEN 'UPDATE without WHERE (rewrites every row)'
    END AS reason FROM flat
  UNION ALL
  SELECT proposal_id, pos, i, CASE WHEN c LIKE 'DROP CONSTRAINT%' THEN 'ALTER TABLE DropConstraint'
    WHEN c LIKE 'DROP %' THEN 'ALTER TABLE DropColumn'
    WHEN regexp_matches(c, '^ALTER (COLUMN )?\\S+ DROP NOT NULL') THEN 'ALTER TABLE DropNotNull'
    WHEN regexp_matches(c, '^ALTER (COLUMN )?\\S+ (SET DATA )?TYPE\\b') THEN 'ALTER TABLE AlterColumnType' END
  FROM cmds),
destr AS (SELECT proposal_id, string_agg(reason, '|' ORDER BY pos, i) AS destructive FROM reasons
  WHERE reason IS NOT NULL GROUP BY proposal_id),
bad AS (SELECT DISTINCT proposal_id FROM flat WHERE verb NOT IN ({_VERB_LIST})
  OR len(string_split(s, '(')) <> len(string_split(s, ')'))
  OR regexp_matches(s, '(\\b(AND|AS|BY|FROM|HAVING|IN|INTO|JOIN|LIKE|NOT|ON|OR|TABLE|UNION|USING|WHERE|WITH)|[,=(])$')),
types AS (SELECT proposal_id, string_agg(verb, '|' ORDER BY pos) AS types FROM flat GROUP BY proposal_id)
SELECT p.proposal_id, p.seq, coalesce(destructive, '') AS all_reasons, coalesce(types, '') AS types,
  CASE WHEN trim(sql) = '' THEN 'empty SQL' WHEN len(parsed) = 0 THEN 'no SQL statements (only comments?)'
    WHEN bad.proposal_id IS NOT NULL THEN 'parse error: syntax error' END AS parse_error
FROM p LEFT JOIN destr USING (proposal_id) LEFT JOIN bad USING (proposal_id) LEFT JOIN types USING (proposal_id)"""
ORACLE["f15_destructive_flags"] = f"SELECT proposal_id, all_reasons AS destructive FROM ({CHECKED})"
# Expected flags and verbs of each form, stated one by one.
ORACLE["f15_deep_statements"] = """
SELECT o_orderkey, NULL::varchar AS parse_error,
  CASE o_orderkey % 7 WHEN 0 THEN 'DELETE without WHERE (deletes every row)' WHEN 1 THEN 'UPDATE without WHERE (rewrites every row)'
    WHEN 5 THEN 'DROP TABLE' WHEN 6 THEN 'TRUNCATE' ELSE '' END AS destructive,
  CASE o_orderkey % 7 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'DELETE' WHEN 3 THEN 'CREATE' WHEN 4 THEN 'SELECT'
    WHEN 5 THEN 'DROP' ELSE 'SELECT|TRUNCATE' END AS statement_types
FROM orders"""
ORACLE["f16_statement_types"] = f"SELECT proposal_id, types AS statement_types, parse_error FROM ({CHECKED})"
ORACLE["r2_propose_check"] = f"""
SELECT proposal_id, parse_error IS NULL AS parse_ok, parse_error,
  CASE WHEN parse_error IS NULL THEN all_reasons ELSE '' END AS destructive FROM ({CHECKED})"""
ORACLE["r10_flags"] = f"""
SELECT proposal_id, CASE WHEN parse_error IS NULL THEN replace(all_reasons, '|', ', ') ELSE 'PARSE FAILED' END AS flags
FROM ({CHECKED})"""


def _clauses(column: str) -> str:
    text = replaced(column, r"""('(?:[^']|'')*'|"(?:[^"]|"")*")|--[^\n]*|/\*(?s:.*?)\*/""", r"\1 ")
    tokens = f"""regexp_extract_all({text}, {quoted(r'''('(?:[^']|'')*'|"(?:[^"]|"")*"|[\w$.]+|[^\s\w$.])''')}, 1)"""
    folded = f"list_transform({tokens}, lambda t: CASE WHEN t LIKE '''%' OR t LIKE '\"%' THEN t ELSE upper(t) END)"
    return f"regexp_replace(coalesce(array_to_string({folded}, ' '), ''), '( ;)+$', '')"


_CUT = r" (FROM|WHERE|GROUP BY|HAVING|ORDER BY|LIMIT|OFFSET|SET|VALUES|RETURNING|UNION)\b"
ORACLE["f17_change_check"] = f"""
WITH n AS (SELECT proposal_id, coalesce({_clauses('current_sql')}, '') AS old, {_clauses('sql')} AS new FROM ({PROPOSED})),
c AS (SELECT *, CASE WHEN old = '' THEN [] ELSE string_split({replaced('old', _CUT, chr(10) + chr(92) + '1')}, chr(10)) END AS olds,
  CASE WHEN new = '' THEN [] ELSE string_split({replaced('new', _CUT, chr(10) + chr(92) + '1')}, chr(10)) END AS news FROM n)
SELECT proposal_id, old <> new AS changed,
  coalesce(array_to_string(list_filter(olds, lambda x: NOT list_contains(news, x)), '|'), '') AS removed,
  coalesce(array_to_string(list_filter(news, lambda x: NOT list_contains(olds, x)), '|'), '') AS added FROM c"""
ORACLE["f18_proposal_sql"] = f"""
SELECT seq, concat(CASE WHEN {query_type('query')} = 'SELECT' THEN 'EXPLAIN (ANALYZE, BUFFERS) ' ELSE 'EXPLAIN ' END,
  rtrim(trim(query), ';'), ';') AS sql FROM ({LOG})"""

# --- model responses ----------------------------------------------------------------------------------

PARSED_RESPONSES = f"""
SELECT *, CASE WHEN doc_id % 11 = 10 THEN 'no JSON object' WHEN doc_id % 17 = 3 THEN 'not JSON'
  WHEN doc_id % 13 = 0 THEN 'bad priority' WHEN doc_id % 7 = 0 THEN 'bad title' END AS reject_reason,
  regexp_extract(response, '(?s)(\\{{.*\\}})', 1) AS body FROM ({RESPONSES})"""
RECOMMENDED = f"""
SELECT doc_id, coalesce(json_extract_string(body, '$.recommendation_id'), 'generated') AS recommendation_id,
  coalesce(json_extract_string(body, '$.priority'), 'medium') AS priority,
  CASE WHEN json_extract_string(body, '$.recommendation_type') IN ('index', 'query_rewrite', 'schema_change',
    'config_tuning', 'vector_params') THEN json_extract_string(body, '$.recommendation_type') ELSE 'config_tuning' END AS recommendation_type,
  json_extract_string(body, '$.title') AS title,
  CASE WHEN doc_id % 6 = 0 THEN '{{"a":1}}' ELSE '{{}}' END AS config_patch,
  CAST(json_extract_string(body, '$.expected_effects.latency_improvement_percent') AS double) AS expected_latency_improvement_percent,
  CASE WHEN json_extract_string(body, '$.risk_level') IN ('low', 'medium', 'high')
    THEN json_extract_string(body, '$.risk_level') ELSE 'medium' END AS risk_level,
  json_extract_string(body, '$.migration_sql') AS migration_sql,
  CAST(json_extract_string(body, '$.confidence_score') AS double) AS confidence_score
FROM (SELECT * FROM ({PARSED_RESPONSES}) WHERE reject_reason IS NULL)"""
ORACLE["f19_response_parsing"] = RECOMMENDED
ORACLE["f19_response_rejects"] = f"""
SELECT reject_reason, count(*) AS responses FROM ({PARSED_RESPONSES}) WHERE reject_reason IS NOT NULL GROUP BY 1"""
STORED_RECOMMENDATIONS = f"""
SELECT * REPLACE (concat('r', doc_id) AS recommendation_id),
  {NOW} - to_days(CAST(doc_id % 60 AS int)) AS recommendation_timestamp, 'pending' AS status FROM ({RECOMMENDED})"""
ORACLE["t4_recent_recommendations"] = f"""
SELECT recommendation_id, recommendation_timestamp, status, priority, recommendation_type, title,
  expected_latency_improvement_percent, risk_level, confidence_score
FROM ({STORED_RECOMMENDATIONS}) WHERE recommendation_timestamp >= {NOW} - INTERVAL 30 DAY"""
ORACLE["t4_latest_recommendations"] = f"""
SELECT recommendation_id, recommendation_timestamp, status, priority, recommendation_type, title,
  expected_latency_improvement_percent, risk_level
FROM ({STORED_RECOMMENDATIONS}) ORDER BY recommendation_timestamp DESC, recommendation_id LIMIT 10"""
ORACLE["k6_recommendation_append"] = f"""
SELECT recommendation_id, recommendation_timestamp, recommendation_type, title,
  CAST(CAST(confidence_score AS decimal(5,4)) AS varchar) AS confidence_score FROM ({STORED_RECOMMENDATIONS})"""
ORACLE["r9_enqueue"] = f"""
SELECT recommendation_timestamp AS ts, concat('pw-', substring(sha256(recommendation_id), 1, 12)) AS proposal_id,
  'propose' AS action, migration_sql AS sql, title, 'architect' AS source, recommendation_id, 'primary' AS target_db
FROM ({STORED_RECOMMENDATIONS})"""

# --- reports ---------------------------------------------------------------------------------------------

NUMERIC_DAILY = f"""
SELECT * REPLACE (CAST(p95_latency_ms AS decimal(15,3)) AS p95_latency_ms, CAST(p99_latency_ms AS decimal(15,3)) AS p99_latency_ms,
  CAST(avg_rows_returned AS decimal(15,2)) AS avg_rows_returned, CAST(avg_rows_scanned AS decimal(15,2)) AS avg_rows_scanned,
  CAST(error_rate AS decimal(5,4)) AS error_rate, CAST(impact_score AS decimal(20,3)) AS impact_score) FROM ({DAILY})"""
ORACLE["f20_workload_report"] = f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY snapshot_timestamp ORDER BY impact_score DESC, query_fingerprint) AS rank,
  count(*) OVER (PARTITION BY snapshot_timestamp) AS n FROM ({NUMERIC_DAILY}))
SELECT snapshot_timestamp, concat('## Workload Summary', chr(10), chr(10), 'Total query patterns analyzed: ', max(n), chr(10),
  'Showing top ', count(*), ' by impact score:', chr(10), chr(10),
  string_agg(concat('### Query Pattern ', rank, chr(10), '- Fingerprint: `', substring(query_fingerprint, 1, 100), '...`', chr(10),
    '- Type: ', query_type, chr(10), '- Source: ', query_source, chr(10),
    '- Executions: ', format('{{:,}}', execution_count), chr(10),
    '- P95 Latency: ', printf('%.2f', CAST(p95_latency_ms AS double)), 'ms', chr(10),
    '- P99 Latency: ', printf('%.2f', CAST(p99_latency_ms AS double)), 'ms', chr(10),
    '- Impact Score: ', format('{{:,}}', CAST(round_even(CAST(impact_score AS double), 0) AS bigint)), chr(10),
    CASE WHEN avg_rows_returned <> 0 THEN concat('- Avg Rows Returned: ', printf('%.0f', CAST(avg_rows_returned AS double)), chr(10)) ELSE '' END,
    CASE WHEN avg_rows_scanned <> 0 THEN concat('- Avg Rows Scanned: ', printf('%.0f', CAST(avg_rows_scanned AS double)), chr(10)) ELSE '' END,
    CASE WHEN error_rate > 0 THEN concat('- Error Rate: ', printf('%.2f', CAST(error_rate AS double) * 100), '%', chr(10)) ELSE '' END,
    '- Example Query: `', substring(example_query, 1, 200), '...`', chr(10), chr(10)), '' ORDER BY rank)) AS workload_summary
FROM s WHERE rank <= 5 GROUP BY snapshot_timestamp""".replace("{{", "{").replace("}}", "}")
NAMED_RESULTS = f"SELECT * REPLACE (concat(eval_type, '/', config_version) AS eval_type) FROM ({RESULTS})"
ORACLE["f20_eval_report"] = f"""
SELECT concat('## Evaluation Results', chr(10), chr(10), string_agg(concat('### ', eval_type, chr(10),
  '- Timestamp: ', strftime(eval_timestamp, '%Y-%m-%d %H:%M:%S'), chr(10),
  CASE WHEN overall_score <> 0 THEN concat('- Overall Score: ', printf('%.4f', overall_score), chr(10)) ELSE '' END,
  CASE WHEN p95_latency_ms <> 0 THEN concat('- P95 Latency: ', printf('%.2f', p95_latency_ms), 'ms', chr(10),
    '- P99 Latency: ', printf('%.2f', p95_latency_ms * 2), 'ms', chr(10)) ELSE '' END,
  CASE WHEN slo_passed IS NULL THEN '' WHEN slo_passed THEN concat('- SLO Status: PASSED', chr(10)) ELSE concat('- SLO Status: FAILED', chr(10)) END,
  CASE WHEN p95_latency_ms > 100 THEN concat('- SLO Violations: [', chr(39), 'p95_latency', chr(39), ']', chr(10)) ELSE '' END,
  chr(10)), '' ORDER BY eval_type)) AS eval_summary
FROM (SELECT * FROM ({NAMED_RESULTS}) ORDER BY eval_timestamp DESC, eval_type LIMIT 5)"""
ORACLE["f20b_schema_config_sections"] = f"""
SELECT seq, md5(concat('## Database Schema', chr(10), chr(10), '### Tables', chr(10), '- ', event_type, chr(10),
    array_to_string(list_transform(range(1, least(1 + k % 8, 5) + 1), lambda i: concat('  - c', i, ': int', chr(10))), ''), chr(10),
    '### Existing Indexes', chr(10),
    array_to_string(list_transform(range(1, least(1 + k % 30, 20) + 1), lambda i: concat('- i', i, ' on ', event_type, chr(10))), ''), chr(10))) AS schema_md5,
  CASE WHEN k % 2 = 0 THEN concat('## Current Configuration', chr(10), chr(10), '```yaml', chr(10), 'work_mem: ', k, 'MB', chr(10), '```', chr(10), chr(10))
    ELSE concat('## Current Configuration', chr(10), chr(10), '(Configuration information not provided)', chr(10), chr(10)) END AS config
FROM ({LOG})"""
ORACLE["f22_numeric_rounding"] = f"""
SELECT snapshot_timestamp, query_fingerprint, CAST(p95_latency_ms AS varchar) AS p95_latency_ms,
  CAST(error_rate AS varchar) AS error_rate FROM ({NUMERIC_DAILY})"""

# --- windows and aggregation --------------------------------------------------------------------------------

ORACLE["p1_trailing_window"] = f"SELECT seq, ts, query FROM ({WEEKLY_ROWS})"
ORACLE["a1_workload_snapshot"] = f"""
SELECT {NOW} AS snapshot_timestamp, newest - INTERVAL 10080 MINUTE AS window_start, newest AS window_end,
  query_fingerprint, query_type, query_source, example_query, execution_count, error_count, {COMPARABLE}
FROM ({snapshots(WEEKLY_ROWS)}), (SELECT max(ts) AS newest FROM ({LOG}))"""
ORACLE["a1_daily_snapshots"] = f"""
SELECT snapshot_timestamp, query_fingerprint, query_type, query_source, execution_count,
  {r('p50_latency_ms')} AS p50_latency_ms, {r('p95_latency_ms')} AS p95_latency_ms,
  {r('p99_latency_ms')} AS p99_latency_ms, {r('impact_score', 3)} AS impact_score FROM ({DAILY})"""

CAPTURES = f"SELECT captured_at, lag(captured_at) OVER (ORDER BY captured_at) AS previous_at FROM (SELECT DISTINCT captured_at FROM ({HISTORY}))"
DELTAS = f"""
WITH h AS MATERIALIZED (SELECT *, CASE WHEN queryid IS NULL THEN query END AS txt FROM ({HISTORY})),
j AS (SELECT c.*, t.previous_at, p.calls AS pc, p.total_exec_time_ms AS pt, p.mean_exec_time_ms AS pm,
    p.stddev_exec_time_ms AS ps, p.rows AS pr, p.shared_blks_hit AS ph, p.shared_blks_read AS pb
  FROM h c JOIN ({CAPTURES}) t ON c.captured_at = t.captured_at
  LEFT JOIN h p ON p.captured_at = t.previous_at AND p.queryid IS NOT DISTINCT FROM c.queryid
    AND p.txt IS NOT DISTINCT FROM c.txt AND p.dbid IS NOT DISTINCT FROM c.dbid AND p.userid IS NOT DISTINCT FROM c.userid),
d AS (SELECT *, pc IS NULL OR calls < pc OR total_exec_time_ms < pt AS fresh, calls - pc AS n, total_exec_time_ms - pt AS t FROM j)
SELECT captured_at, previous_at, queryid, dbid, userid, query, CASE WHEN fresh THEN calls ELSE n END AS calls,
  CASE WHEN fresh THEN total_exec_time_ms ELSE t END AS total_exec_time_ms,
  CASE WHEN fresh THEN mean_exec_time_ms ELSE t / n END AS mean_exec_time_ms,
  CASE WHEN fresh THEN stddev_exec_time_ms ELSE sqrt(greatest((calls * (stddev_exec_time_ms * stddev_exec_time_ms
    + mean_exec_time_ms * mean_exec_time_ms) - pc * (ps * ps + pm * pm)) / n - (t / n) * (t / n), 0)) END AS stddev_exec_time_ms,
  min_exec_time_ms, max_exec_time_ms, CASE WHEN fresh THEN rows ELSE greatest(rows - pr, 0) END AS rows,
  CASE WHEN fresh THEN shared_blks_hit ELSE greatest(shared_blks_hit - ph, 0) END AS shared_blks_hit,
  CASE WHEN fresh THEN shared_blks_read ELSE greatest(shared_blks_read - pb, 0) END AS shared_blks_read
FROM d WHERE CASE WHEN fresh THEN calls ELSE n END > 0"""
_DELTA_COLUMNS = f"""queryid, dbid, userid, query, calls, {r('total_exec_time_ms')} AS total_exec_time_ms,
  {r('mean_exec_time_ms')} AS mean_exec_time_ms, {r('stddev_exec_time_ms', 3)} AS stddev_exec_time_ms,
  min_exec_time_ms, max_exec_time_ms, rows, shared_blks_hit, shared_blks_read"""
ORACLE["j1_history_deltas"] = f"SELECT captured_at, previous_at, {_DELTA_COLUMNS} FROM ({DELTAS})"
ORACLE["j1_capture_delta"] = f"""
SELECT {_DELTA_COLUMNS} FROM ({DELTAS}) WHERE captured_at = (SELECT max(captured_at) FROM ({HISTORY}))"""
ORACLE["j2_previous_capture"] = CAPTURES
ORACLE["j4_long_retrieval_scores"] = f"""
WITH rel AS (SELECT l_orderkey, l_partkey AS item, count(*) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
ret AS (SELECT l.l_orderkey, l.l_partkey AS item, l.l_linenumber AS rank, rel.c IS NOT NULL AS hit
  FROM lineitem l LEFT JOIN rel ON rel.l_orderkey = l.l_orderkey AND rel.item = l.l_partkey),
a AS (SELECT l_orderkey, min(CASE WHEN hit THEN rank END) AS best,
  count(DISTINCT CASE WHEN hit AND rank <= 3 THEN item END) AS hits,
  sum(CASE WHEN rank <= 3 THEN 1 ELSE 0 END) AS top FROM ret GROUP BY 1),
b AS (SELECT l_orderkey, sum(c) AS relevant FROM rel GROUP BY 1)
SELECT l_orderkey, {r('coalesce(1.0::double / best, 0)')} AS reciprocal_rank,
  {r('CASE WHEN top > 0 THEN hits / top ELSE 0 END')} AS precision_at_k,
  {r('CASE WHEN relevant > 0 THEN hits / relevant END')} AS recall_at_k
FROM a LEFT JOIN b USING (l_orderkey)"""


def pooled(rows: str, by: str, min_calls: int) -> str:
    return f"""
SELECT *, sqrt(greatest(squares / execution_count - avg_execution_time_ms * avg_execution_time_ms, 0)) AS sd FROM (
  SELECT *, total_execution_time_ms / execution_count AS avg_execution_time_ms FROM (
    SELECT {by}, {fingerprint('query')} AS query_fingerprint, arg_max(query, (calls, mean_exec_time_ms, query)) AS example_query,
      CAST(sum(calls) AS bigint) AS execution_count, sum(total_exec_time_ms) AS total_execution_time_ms,
      sum(calls * (stddev_exec_time_ms * stddev_exec_time_ms + mean_exec_time_ms * mean_exec_time_ms)) AS squares,
      max(max_exec_time_ms) AS max_latency_ms, min(min_exec_time_ms) AS min_latency_ms,
      sum(rows) AS r, sum(shared_blks_hit) AS h, sum(shared_blks_read) AS b
    FROM ({rows}) WHERE calls > 0 GROUP BY {by}, {fingerprint('query')} HAVING sum(calls) >= {min_calls}))"""


_LIMIT = "CASE WHEN max_latency_ms > 0 THEN max_latency_ms ELSE 'infinity'::double END"
ORACLE["a2_pooled_statements"] = f"""
SELECT captured_at AS day, {NOW} AS snapshot_timestamp, {NOW} AS window_start, {NOW} AS window_end, query_fingerprint,
  {query_type('example_query')} AS query_type, 'postgres' AS query_source, example_query, execution_count,
  {r('total_execution_time_ms')} AS total_execution_time_ms, {r('avg_execution_time_ms')} AS avg_execution_time_ms,
  {r(f'least(avg_execution_time_ms, {_LIMIT})')} AS p50_latency_ms,
  {r(f'least(avg_execution_time_ms + 1.645::double * sd, {_LIMIT})')} AS p95_latency_ms,
  {r(f'least(avg_execution_time_ms + 2.326::double * sd, {_LIMIT})')} AS p99_latency_ms,
  {r('max_latency_ms')} AS max_latency_ms, {r('min_latency_ms')} AS min_latency_ms,
  {r('r / execution_count')} AS avg_rows_returned, NULL::double AS avg_rows_scanned,
  {r('h / execution_count')} AS avg_buffer_hits, {r('b / execution_count')} AS avg_buffer_misses,
  CAST(0 AS bigint) AS error_count, 0.0::double AS error_rate,
  {r('execution_count * avg_execution_time_ms', 3)} AS impact_score
FROM ({pooled(HISTORY, 'captured_at', 5)})"""
ORACLE["a3_capture_summary"] = f"""
SELECT captured_at, count(*) AS statements, CAST(coalesce(sum(calls), 0) AS bigint) AS total_calls
FROM ({HISTORY}) GROUP BY captured_at ORDER BY captured_at DESC LIMIT 20"""
RECENT = f"""
SELECT coalesce(avg(p95_latency_ms), 0) AS p95, coalesce(avg(p99_latency_ms), 0) AS p99, coalesce(avg(error_rate), 0) AS er,
  CAST(coalesce(sum(execution_count), 0) AS bigint) AS q, CAST(coalesce(sum(error_count), 0) AS bigint) AS e
FROM ({DAILY}) WHERE snapshot_timestamp >= TIMESTAMP '2024-01-20 00:30:00' - INTERVAL 1 HOUR"""
ORACLE["a4_recent_slo_metrics"] = f"""
SELECT {r('p95')} AS avg_p95_latency, {r('p99')} AS avg_p99_latency, {r('er')} AS avg_error_rate,
  q AS total_queries, e AS total_errors FROM ({RECENT})"""
ORACLE["a5_slo_evaluation"] = f"""
SELECT NOT (p95 > 20 OR p99 > 1000 OR er > 0.001) AS slo_passed,
  concat_ws('|', CASE WHEN p95 > 20 THEN 'p95_latency' END, CASE WHEN p99 > 1000 THEN 'p99_latency' END,
    CASE WHEN er > 0.001 THEN 'error_rate' END) AS violated,
  CASE WHEN p95 > 20 THEN 20.0::double END AS p95_threshold, {r('p95')} AS p95_latency_ms, {r('p99')} AS p99_latency_ms,
  {r('er')} AS error_rate, q AS total_queries, e AS total_errors FROM ({RECENT})"""
RAG = f"""
SELECT coalesce(avg(reciprocal_rank), 0) AS mrr, coalesce(avg(precision_at_k), 0) AS p, coalesce(avg(recall_at_k), 0) AS rec,
  count(*) AS n FROM ({SCORED})"""
ORACLE["a6_rag_evaluation"] = f"""
SELECT {r('mrr')} AS mrr, {r('p')} AS precision_at_10, {r('rec')} AS recall_at_10, n AS test_count FROM ({RAG})"""
ORACLE["a7_slo_compliance"] = f"""
SELECT date_trunc('day', eval_timestamp) AS eval_date, eval_type,
  {r('avg(CASE WHEN slo_passed THEN 1.0::double ELSE 0.0::double END)')} AS pass_rate,
  {r('avg(p95_latency_ms)')} AS avg_p95_latency, {r('avg(error_rate)')} AS avg_error_rate
FROM ({RESULTS}) WHERE eval_timestamp >= {NOW} - INTERVAL 20 DAY GROUP BY 1, 2"""
ORACLE["a8_status_counts"] = f"""
WITH s AS MATERIALIZED ({DAILY})
SELECT (SELECT count(*) FROM s) AS workload_snapshots, (SELECT count(*) FROM ({RESULTS})) AS eval_results,
  (SELECT count(DISTINCT query_source) FROM s) AS recommendations,
  (SELECT count(DISTINCT query_source) FROM s) AS pending_recommendations"""

# --- ranked listings ---------------------------------------------------------------------------------------------

ORACLE["t2_top_impact_latest"] = f"""
WITH s AS MATERIALIZED ({DAILY})
SELECT query_fingerprint, query_type, query_source, execution_count, {r('p95_latency_ms')} AS p95_latency_ms,
  {r('impact_score', 3)} AS impact_score, example_query
FROM s WHERE snapshot_timestamp = (SELECT max(snapshot_timestamp) FROM s)
ORDER BY s.impact_score DESC, query_fingerprint LIMIT 50"""
ORACLE["t3_top_impact_all"] = f"""
SELECT snapshot_timestamp, query_fingerprint, execution_count, {r('s.impact_score', 3)} AS impact_score
FROM ({DAILY}) s ORDER BY s.impact_score DESC, query_fingerprint, snapshot_timestamp LIMIT 50"""
ORACLE["t7_latest_results"] = f"""
SELECT eval_timestamp, eval_type, {r('overall_score')} AS overall_score, {r('p95_latency_ms')} AS p95_latency_ms,
  {r('error_rate')} AS error_rate, slo_passed
FROM ({NAMED_RESULTS}) ORDER BY eval_timestamp DESC, eval_type LIMIT 10"""
ORACLE["t8_top_query"] = f"""
SELECT snapshot_timestamp, query_source, query_fingerprint, {r('i', 3)} AS impact_score FROM (
  SELECT snapshot_timestamp, query_source, query_fingerprint, impact_score AS i,
    row_number() OVER (PARTITION BY snapshot_timestamp, query_source ORDER BY impact_score DESC, query_fingerprint) AS n
  FROM ({DAILY})) WHERE n = 1"""
ORACLE["t9_top_entries"] = f"""
SELECT snapshot_timestamp, CAST(n AS int) AS rank, query_fingerprint, execution_count FROM (
  SELECT *, row_number() OVER (PARTITION BY snapshot_timestamp ORDER BY impact_score DESC, query_fingerprint) AS n
  FROM ({DAILY})) WHERE n <= 10"""

ORACLE["t11_first_snapshots"] = f"""
SELECT query_type, execution_count, {r('p95_latency_ms')} AS p95_latency_ms, {r('i', 3)} AS impact_score
FROM (SELECT *, impact_score AS i FROM ({snapshots(WEEKLY_ROWS)})) ORDER BY i DESC, query_fingerprint LIMIT 5"""

# --- sinks -----------------------------------------------------------------------------------------------------------

ORACLE["k1_snapshot_upsert"] = f"""
WITH s AS MATERIALIZED (SELECT snapshot_timestamp, query_fingerprint, query_source, query_type, execution_count,
    {r('p50_latency_ms', 3)} AS p50, {r('p95_latency_ms', 3)} AS p95, {r('max_latency_ms', 3)} AS mx FROM ({DAILY})),
old AS (SELECT * FROM s),
new AS (SELECT * FROM s WHERE day(snapshot_timestamp) BETWEEN 18 AND 22
  UNION ALL SELECT * REPLACE ('rerun' AS query_source) FROM s WHERE day(snapshot_timestamp) = 22)
SELECT snapshot_timestamp, query_fingerprint, query_source,
  CASE WHEN n.p50 IS NULL THEN o.execution_count ELSE n.execution_count + 1000 END AS execution_count,
  CASE WHEN o.p50 IS NULL THEN -1.0::double ELSE o.p50 END AS p50_latency_ms,
  CASE WHEN n.p50 IS NULL THEN o.p95 ELSE -2.0::double END AS p95_latency_ms,
  coalesce(o.mx, n.mx) AS max_latency_ms
FROM old o FULL JOIN new n USING (snapshot_timestamp, query_fingerprint, query_source)"""
ORACLE["k2_capture_append"] = f"""
SELECT captured_at, queryid, userid, {fingerprint('query')} AS query_fingerprint, {query_type('query')} AS query_type,
  query, calls, {r('total_exec_time_ms')} AS total_exec_time_ms FROM ({HISTORY})"""
ORACLE["k3_retention"] = f"""
WITH h AS MATERIALIZED ({HISTORY})
SELECT captured_at, count(*) AS statements,
  (SELECT count(*) FROM h WHERE captured_at < {NOW} - INTERVAL 20 DAY) AS removed
FROM h WHERE captured_at >= {NOW} - INTERVAL 20 DAY GROUP BY captured_at"""
ORACLE["k4_capture_export"] = f"""
SELECT strftime(captured_at, '%Y-%m-%dT%H:%M:%S') AS captured_at, CAST(queryid AS varchar) AS queryid,
  CAST(userid AS varchar) AS userid, {fingerprint('query')} AS query_fingerprint, CAST(calls AS varchar) AS calls,
  CAST(rows AS varchar) AS rows
FROM ({HISTORY}) h WHERE h.captured_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'"""
ORACLE["k5_result_append"] = f"""
SELECT eval_timestamp, eval_type, config_version, CAST(CAST(overall_score AS decimal(10,6)) AS varchar) AS overall_score,
  CAST(CAST(p95_latency_ms AS decimal(15,3)) AS varchar) AS p95_latency_ms, slo_passed, NULL::bigint AS test_count FROM ({RESULTS})
UNION ALL SELECT {NOW}, 'rag_accuracy', NULL, CAST(CAST(mrr AS decimal(10,6)) AS varchar), NULL, false, n FROM ({RAG})"""
ORACLE["k7_review_event_append"] = f"SELECT action, count(*) AS events, max(ts) AS newest FROM ({EVENTS}) GROUP BY action"
ORACLE["v1_constraint_violations"] = f"""
SELECT day AS snapshot_timestamp, fp AS query_fingerprint, source AS query_source, count(*) AS copies
FROM ({FINGERPRINTED}) GROUP BY 1, 2, 3 HAVING count(*) > 1"""
ORACLE["v1_proposal_constraints"] = f"""
SELECT seq, CASE WHEN seq % 3 = 1 THEN 'status' ELSE 'reject reason' END AS violation FROM ({EVENTS})
WHERE seq % 3 = 1 OR (seq % 3 = 0 AND (seq % 2 = 0 OR reason IS NULL))"""

# --- review ledger: replayed event by event ----------------------------------------------------------------------------


def replay(mode_on: bool, still: str = "true") -> str:
    """``still``: whether the SQL of an application passes the second check."""
    gate = "st.status = 'approved'" if mode_on else "st.status IN ('pending', 'approved')"
    return f"""
WITH RECURSIVE ck AS MATERIALIZED ({CHECKED}),
ev AS MATERIALIZED (SELECT e.*, ck.parse_error, row_number() OVER (PARTITION BY e.proposal_id ORDER BY e.ts, e.seq) AS n
  FROM ({EVENTS}) e JOIN ck USING (proposal_id)),
st AS (
  SELECT proposal_id, n, seq, 'propose' AS action, NULL::varchar AS before, 'pending' AS status, true AS ok,
    NULL::varchar AS reviewed_by, NULL::timestamp AS reviewed_at, NULL::varchar AS reason,
    NULL::varchar AS applied_by, NULL::timestamp AS applied_at, NULL::varchar AS apply_error
  FROM ev WHERE n = 1
  UNION ALL
  SELECT proposal_id, n, seq, action, before, CASE WHEN NOT ok THEN before WHEN action = 'approve' THEN 'approved'
      WHEN action = 'reject' THEN 'rejected' WHEN error IS NULL THEN 'applied' ELSE 'failed' END,
    ok, CASE WHEN ok AND action <> 'apply' THEN actor ELSE reviewed_by END,
    CASE WHEN ok AND action <> 'apply' THEN ts ELSE reviewed_at END,
    CASE WHEN ok AND action = 'approve' THEN event_reason WHEN ok AND action = 'reject' THEN trim(event_reason) ELSE reason END,
    CASE WHEN ok AND action = 'apply' THEN actor ELSE applied_by END,
    CASE WHEN ok AND action = 'apply' THEN ts ELSE applied_at END,
    CASE WHEN ok AND action = 'apply' THEN string_split(error, chr(10))[1] ELSE apply_error END
  FROM (SELECT ev.proposal_id, ev.n, ev.seq, ev.action, ev.actor, ev.ts, ev.error, ev.reason AS event_reason,
      st.status AS before, st.reviewed_by, st.reviewed_at, st.reason, st.applied_by, st.applied_at, st.apply_error,
      CASE ev.action
        WHEN 'approve' THEN ev.actor <> '' AND ev.parse_error IS NULL AND st.status = 'pending'
        WHEN 'reject' THEN ev.actor <> '' AND trim(coalesce(ev.reason, '')) <> '' AND st.status IN ('pending', 'approved')
        ELSE ev.confirm AND ev.parse_error IS NULL AND {still} AND {gate} END AS ok
    FROM st JOIN ev ON ev.proposal_id = st.proposal_id AND ev.n = st.n + 1))
"""


def state(mode_on: bool) -> str:
    return replay(mode_on) + """
SELECT proposal_id, status, reviewed_by, reviewed_at, reason, applied_by, applied_at, apply_error
FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY n DESC) AS last FROM st) WHERE last = 1"""


def gate(mode_on: bool, still: str = "true") -> str:
    refused = (
        "WHEN before <> 'approved' THEN concat('review mode is on and ', proposal_id, ' is ', before, ', not approved')"
        if mode_on
        else "WHEN before NOT IN ('pending', 'approved') THEN concat(proposal_id, ' is ', before)"
    )
    return replay(mode_on, still) + f"""
SELECT seq, proposal_id, before AS status_before, CASE WHEN NOT confirm THEN 'apply requires explicit confirmation'
    WHEN parse_error IS NOT NULL THEN concat('SQL does not parse: ', parse_error)
    WHEN NOT ({still.replace('ev.', '')}) THEN 'SQL does not parse' {refused} END AS blocked_reason
FROM st JOIN ev USING (proposal_id, n, seq, action) WHERE action = 'apply'
UNION ALL SELECT seq, proposal_id, NULL, concat('no proposal ', proposal_id) FROM ({EVENTS})
WHERE action = 'apply' AND proposal_id = 'gone'"""


ORACLE["r1_proposal_state"] = state(True)
ORACLE["r1_proposal_state_mode_off"] = state(False)
ORACLE["p9_apply_gate"] = gate(True)
ORACLE["p9_apply_gate_mode_off"] = gate(False)
AUDIT = replay(True) + """
SELECT ev.ts, ev.seq, ev.proposal_id,
  CASE WHEN NOT ok THEN 'apply_blocked' WHEN action = 'apply' AND error IS NOT NULL THEN 'apply_failed' ELSE action END AS action,
  CASE WHEN action = 'propose' AND coalesce(ev.actor, '') = '' THEN ev.source ELSE ev.actor END AS actor,
  CASE WHEN action = 'propose' THEN NULL WHEN NOT ok AND NOT confirm THEN 'apply requires explicit confirmation'
    WHEN NOT ok AND parse_error IS NOT NULL THEN concat('SQL does not parse: ', parse_error)
    WHEN NOT ok THEN concat('review mode is on and ', ev.proposal_id, ' is ', before, ', not approved')
    WHEN action = 'apply' THEN string_split(error, chr(10))[1]
    WHEN action = 'reject' THEN trim(ev.reason) ELSE ev.reason END AS reason
FROM st JOIN ev USING (proposal_id, n, seq, action) WHERE ok OR action = 'apply'"""
ORACLE["r5_audit_log"] = AUDIT
ORACLE["r7_audit_listing"] = f"""
SELECT seq, proposal_id, action FROM ({AUDIT}) ORDER BY ts DESC, seq DESC LIMIT 100"""
ORACLE["t6_proposal_listing"] = f"""
SELECT proposal_id, status, title, CASE WHEN parse_error IS NULL THEN replace(all_reasons, '|', ', ') ELSE 'PARSE FAILED' END AS flags,
  p.ts AS created_at
FROM ({state(True)}) s JOIN ({PROPOSED}) p USING (proposal_id) JOIN ({CHECKED}) c USING (proposal_id)
WHERE status = 'rejected' ORDER BY p.ts DESC, p.seq DESC LIMIT 50"""

# --- end-to-end jobs -----------------------------------------------------------------------------------------------------------

_LOGGED = f"""
SELECT *, {fingerprint('query')} AS fp, {query_type('query')} AS kind, 'postgres' AS source, true AS success,
  NULL::bigint AS rows_returned, NULL::bigint AS rows_scanned, NULL::bigint AS buffer_hits, NULL::bigint AS buffer_misses
FROM ({STDERR_ROWS})"""
_LOGGED_WEEK = f"SELECT * FROM ({_LOGGED}) WHERE ts >= (SELECT max(ts) FROM ({STDERR_ROWS})) - INTERVAL 10080 MINUTE"
ORACLE["o1_profile_logs"] = f"""
SELECT {NOW} AS snapshot_timestamp, query_fingerprint, query_type, query_source, execution_count,
  {r('p50_latency_ms')} AS p50_latency_ms, {r('p95_latency_ms')} AS p95_latency_ms, {r('p99_latency_ms')} AS p99_latency_ms,
  {r('impact_score', 3)} AS impact_score FROM ({snapshots(_LOGGED_WEEK)})"""
_LATEST = f"SELECT * FROM ({DELTAS}) WHERE captured_at = (SELECT max(captured_at) FROM ({HISTORY}))"
ORACLE["o2_profile_statements"] = f"""
SELECT previous_at AS window_start, captured_at AS window_end, query_fingerprint, example_query, execution_count,
  {r('avg_execution_time_ms')} AS avg_execution_time_ms, {r('min_latency_ms')} AS min_latency_ms,
  {r('max_latency_ms')} AS max_latency_ms, {r('r / execution_count')} AS avg_rows_returned,
  {r('execution_count * avg_execution_time_ms', 3)} AS impact_score
FROM ({pooled(_LATEST, 'captured_at, previous_at', 1)})"""
ORACLE["o3_capture_only"] = f"""
SELECT captured_at, count(*) AS statements, CAST(sum(calls) AS bigint) AS total_calls FROM (
  SELECT captured_at, calls FROM ({HISTORY}) WHERE captured_at >= {NOW} - INTERVAL 10 DAY
  UNION ALL SELECT {NOW}, calls FROM ({VIEW})
  WHERE calls >= 1 AND dbid = 1 AND query IS NOT NULL AND query <> '<insufficient privilege>'
    AND NOT regexp_matches(query, '(?i)^\\s*(BEGIN|COMMIT|ROLLBACK|SET|SHOW|RESET|DISCARD)\\b')
    AND lower(query) NOT LIKE '%pg_stat_statements%')
GROUP BY captured_at"""
ORACLE["o4_evaluate_all"] = f"""
SELECT TIMESTAMP '2024-01-20 00:30:00' AS eval_timestamp, 'rag_accuracy' AS eval_type, {r('mrr')} AS overall_score,
  NULL::double AS p95_latency_ms, NULL::double AS error_rate, {r('rec')} AS rag_recall_at_k, false AS slo_passed, n AS test_count
FROM ({RAG})
UNION ALL SELECT TIMESTAMP '2024-01-20 00:30:00', 'slo_check', NULL, {r('p95')}, {r('er')}, NULL,
  NOT (p95 > 500 OR p99 > 1000 OR er > 0.001), NULL FROM ({RECENT})"""
ORACLE["o5_recommend"] = f"""
SELECT {NOW} AS recommendation_timestamp, 'pending' AS status, 'medium' AS priority, 'query_rewrite' AS recommendation_type,
  concat('Explain high-impact query (', query_type, ')') AS title,
  'Stub heuristic: highest impact_score query should be EXPLAINed before index changes.' AS rationale, 'low' AS risk_level,
  concat(CASE WHEN query_type = 'SELECT' THEN 'EXPLAIN (ANALYZE, BUFFERS) ' ELSE 'EXPLAIN ' END, rtrim(trim(example_query), ';'), ';') AS queued_sql,
  '-- stub: no-op' AS rollback_sql, 'stub-architect' AS model_name
FROM ({DAILY}) ORDER BY impact_score DESC, query_fingerprint, snapshot_timestamp LIMIT 1"""
_WEEK = snapshots(WEEKLY_ROWS)
ORACLE["o6_run_all"] = f"""
WITH s AS MATERIALIZED ({_WEEK})
SELECT 'profile' AS step, query_fingerprint AS item, {r('impact_score', 3)} AS score FROM s
UNION ALL SELECT 'evaluate', 'rag_accuracy', {r('mrr', 3)} FROM ({RAG})
UNION ALL SELECT 'evaluate', 'slo_check', {r('avg(p95_latency_ms)', 3)} FROM s
UNION ALL SELECT 'recommend', sql, {r('0.4::double', 3)} FROM (
  SELECT concat(CASE WHEN query_type = 'SELECT' THEN 'EXPLAIN (ANALYZE, BUFFERS) ' ELSE 'EXPLAIN ' END, rtrim(trim(example_query), ';'), ';') AS sql
  FROM s ORDER BY impact_score DESC, query_fingerprint LIMIT 1)"""

ORACLE["o1_profile_and_store"] = ORACLE["o1_profile_logs"]
ORACLE["o5_recommend_and_store"] = ORACLE["o5_recommend"]
ORACLE["o2_profile_and_store"] = f"""
WITH live AS (SELECT * FROM ({HISTORY}) WHERE captured_at = (SELECT max(captured_at) FROM ({HISTORY}))
    AND calls >= 1 AND query IS NOT NULL AND query <> '<insufficient privilege>'
    AND NOT regexp_matches(query, '(?i)^\\s*(BEGIN|COMMIT|ROLLBACK|SET|SHOW|RESET|DISCARD)\\b')
    AND lower(query) NOT LIKE '%pg_stat_statements%')
SELECT {NOW} + INTERVAL 1 HOUR AS captured_at, count(*) AS rows, CAST(sum(calls + 7) AS bigint) AS calls,
  CAST(7 * count(*) AS bigint) AS new_calls FROM live"""

# Adds the SQL of the queries over streams, panes and stored runs.
from worklens.plans import incremental_oracle  # noqa: E402

ORACLE.update(incremental_oracle.statements())
