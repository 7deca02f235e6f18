"""Views of the given tables as operator inputs.

Each view is SQL text that Spark and DuckDB both accept, so a query and its oracle read
the same rows. ``<NTZ>`` is the engine's name of the zone-less timestamp type. Statements
stay ASCII: the engines differ in what they take for a word character beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS int)"

# A query log with several spellings of the same patterns, literals of all kinds, lists of
# different lengths, a hot pattern and many rare ones.
QUERY_LOG = f"""
SELECT ts, event_id AS seq, user_id, event_type, k,
  CASE
    WHEN event_type = 'view' THEN concat(
      CASE WHEN k % 2 = 0 THEN 'SELECT * FROM users' ELSE concat('select  *', chr(10), ' from users') END,
      ' WHERE id = ', CAST(user_id AS string),
      CASE WHEN k % 3 = 0 THEN '' ELSE concat(' AND region = ', chr(39), 'r', CAST(k AS string), chr(39)) END)
    WHEN event_type = 'click' THEN concat(
      'SELECT id, name FROM "Products" p JOIN stock s ON p.id = s.id WHERE category IN (',
      CASE k % 3 WHEN 0 THEN '1' WHEN 1 THEN concat('1, ', CAST(k AS string))
        ELSE concat(chr(39), 'a', chr(39), chr(39), 'b', chr(39), ', 2 , 3') END,
      ') AND price > ', CAST(k AS string), '.', CAST(user_id % 100 AS string))
    WHEN event_type = 'purchase' THEN concat(
      'INSERT INTO orders_', CAST(k % 10 AS string), ' (id, note, total) VALUES (',
      CAST(user_id AS string), ', ', chr(39), 'it', chr(39), chr(39), 's ', CAST(k AS string), chr(39),
      ', ', CAST(k AS string), '.50); -- order')
    WHEN event_type = 'signup' THEN concat(
      'UPDATE users SET last_login = NOW(), tag = $1 WHERE n', CAST(user_id % 40 AS string),
      ' = ', CAST(k AS string), '  ;')
    ELSE CASE k % 4
      WHEN 0 THEN concat('DELETE FROM sessions WHERE id = ', CAST(user_id AS string))
      WHEN 1 THEN concat('WITH recent AS (SELECT * FROM events LIMIT ', CAST(k AS string), ') SELECT * FROM recent')
      WHEN 2 THEN 'EXPLAIN SELECT EXTRACT(YEAR FROM created_at) FROM events_log'
      ELSE concat('  create index i', CAST(k AS string), ' on t (a)') END
  END AS query,
  CAST(NULL AS string) AS query_type,
  value AS execution_time_ms,
  CASE WHEN event_type = 'purchase' THEN NULL ELSE CAST(k AS bigint) END AS rows_returned,
  CASE WHEN event_type IN ('view', 'click') THEN CAST(k * 10 AS bigint) END AS rows_scanned,
  CASE WHEN event_type = 'signup' THEN CAST(k + 1 AS bigint) END AS buffer_hits,
  CASE WHEN event_type = 'signup' THEN CAST(k % 7 AS bigint) END AS buffer_misses,
  event_type <> 'error' AS success,
  CASE user_id % 3 WHEN 0 THEN 'application' ELSE 'postgres' END AS source
FROM (SELECT *, {K} AS k FROM {{events}})
"""

# Cumulative statement counters, one capture per day. Counters restart on day 16 for two
# statements, stand still on even days for one, and keys are absent on days without use.
STAT_HISTORY = f"""
WITH e AS (
  SELECT CAST(ts AS date) AS d, event_type, CAST(floor(user_id / 6) AS bigint) AS bucket,
    CAST(value AS decimal(10,2)) AS v, {K} AS k,
    CASE WHEN event_type = 'purchase' AND day(ts) % 2 = 0 THEN 0 ELSE 1 END AS w
  FROM {{events}}),
daily AS (
  SELECT d, event_type, bucket,
    CASE WHEN event_type IN ('click', 'view') AND day(d) >= 16 THEN 1 ELSE 0 END AS epoch,
    sum(w) AS n, sum(w * v) AS s, sum(w * v * v) AS q, min(v) AS mn, max(v) AS mx, sum(w * k) AS r
  FROM e
  GROUP BY d, event_type, bucket,
    CASE WHEN event_type IN ('click', 'view') AND day(d) >= 16 THEN 1 ELSE 0 END),
total AS (
  SELECT d, event_type, bucket,
    CAST(sum(n) OVER w AS bigint) AS calls, CAST(sum(s) OVER w AS double) AS s,
    CAST(sum(q) OVER w AS double) AS q, CAST(min(mn) OVER w AS double) AS mn,
    CAST(max(mx) OVER w AS double) AS mx, CAST(sum(r) OVER w AS bigint) AS r
  FROM daily
  WINDOW w AS (PARTITION BY event_type, bucket, epoch ORDER BY d
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
means AS (
  SELECT *, CASE WHEN calls > 0 THEN s / calls ELSE CAST(0 AS double) END AS mean FROM total)
SELECT CAST(d AS <NTZ>) AS captured_at,
  CASE event_type WHEN 'view' THEN 100 + bucket % 3 WHEN 'click' THEN 200 WHEN 'purchase' THEN 300
    WHEN 'signup' THEN 400 + bucket % 2 END AS queryid,
  bucket % 2 AS dbid, bucket AS userid,
  CASE event_type
    WHEN 'view' THEN CASE bucket % 3 WHEN 0 THEN 'SELECT * FROM users WHERE id = $1'
      WHEN 1 THEN 'select *  from users where id = $1' ELSE 'SELECT * FROM users WHERE id IN ($1, $2)' END
    WHEN 'click' THEN 'SELECT id FROM products WHERE id IN ($1 /*, ... */)'
    WHEN 'purchase' THEN concat('INSERT INTO orders_', CAST(bucket % 20 AS string), ' VALUES ($1, $2)')
    WHEN 'signup' THEN CASE bucket % 2 WHEN 0 THEN 'UPDATE users SET x = $1 WHERE id = $2'
      ELSE 'update users set x = $1 where id = $3' END
    ELSE concat('DELETE FROM sessions WHERE t', CAST(bucket % 5 AS string), ' = $1') END AS query,
  calls, s AS total_exec_time_ms, mean AS mean_exec_time_ms,
  CASE WHEN calls > 0 THEN sqrt(greatest(q / calls - mean * mean, CAST(0 AS double)))
    ELSE CAST(0 AS double) END AS stddev_exec_time_ms,
  mn AS min_exec_time_ms, mx AS max_exec_time_ms, r AS rows,
  r * 3 AS shared_blks_hit, CAST(floor(r / 4) AS bigint) AS shared_blks_read
FROM means
"""

# The live view as a server shows it: unfiltered, with rows a scan has to leave out.
STAT_VIEW = """
SELECT event_id AS queryid, user_id % 2 AS dbid, user_id AS userid,
  CASE WHEN user_id % 17 = 0 THEN '<insufficient privilege>'
    WHEN user_id % 17 = 1 THEN NULL
    WHEN user_id % 17 = 2 THEN '  begin'
    WHEN user_id % 17 = 3 THEN 'SELECT * FROM Pg_Stat_Statements'
    WHEN user_id % 17 = 4 THEN 'SET search_path = x'
    WHEN user_id % 17 = 5 THEN 'settle the bill'
    ELSE concat('SELECT ', event_type, ' FROM t') END AS query,
  CAST(event_id % 9 AS bigint) AS calls,
  value * 9 AS total_time,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE value END AS mean_time,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 2 END AS stddev_time,
  value / 4 AS min_time, value * 2 AS max_time,
  CAST(NULL AS bigint) AS rows, CAST(event_id AS bigint) AS shared_blks_hit,
  CAST(event_id % 3 AS bigint) AS shared_blks_read
FROM {events}
"""

# Evaluation results per day, event type and configuration.
EVAL_RESULTS = """
SELECT CAST(CAST(ts AS date) AS <NTZ>) AS eval_timestamp, event_type AS eval_type,
  'production' AS environment, concat('v', CAST(user_id % 10 AS string)) AS config_version,
  CAST(max(CAST(value AS decimal(10,2))) AS double) AS p95_latency_ms,
  CAST(sum(CAST(CASE WHEN value > 100 THEN 1 ELSE 0 END AS bigint)) AS double) / count(*) AS error_rate,
  CAST(min(CAST(value AS decimal(10,2))) AS double) / 100 AS overall_score,
  CASE WHEN count(*) % 5 = 0 THEN NULL ELSE max(value) < 100 END AS slo_passed
FROM {events}
GROUP BY CAST(ts AS date), event_type, user_id % 10
"""

# Review ledger: one proposal per order, decided by events.
REVIEW_EVENTS = f"""
SELECT o_orderdate AS ts, o_orderkey AS seq, concat('pw-', CAST(o_orderkey AS string)) AS proposal_id,
  'propose' AS action, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'dana' END AS actor,
  CAST(NULL AS string) AS reason, CAST(NULL AS boolean) AS confirm, CAST(NULL AS string) AS error,
  concat('change ', CAST(o_orderkey AS string)) AS title,
  CASE o_orderkey % 23
    WHEN 0 THEN concat('DROP TABLE t', CAST(o_custkey AS string))
    WHEN 1 THEN 'TRUNCATE orders'
    WHEN 2 THEN 'DELETE FROM users'
    WHEN 3 THEN 'DELETE FROM sessions WHERE expires_at < now()'
    WHEN 4 THEN 'UPDATE users SET active = false'
    WHEN 5 THEN concat('UPDATE users SET active = false WHERE id = ', CAST(o_custkey AS string))
    WHEN 6 THEN 'ALTER TABLE t DROP COLUMN c'
    WHEN 7 THEN 'ALTER TABLE t ALTER COLUMN c TYPE text, ADD COLUMN d int, DROP CONSTRAINT k'
    WHEN 8 THEN 'CREATE INDEX i ON t (a); drop  index old_i'
    WHEN 9 THEN concat('INSERT INTO t (a) VALUES (', chr(39), 'x; DROP TABLE t -- ', chr(39), ')')
    WHEN 10 THEN 'SELEC * FRM users'
    WHEN 11 THEN ''
    WHEN 12 THEN '-- only a comment'
    WHEN 13 THEN concat('UPDATE t SET a = ', chr(39), 'WHERE', chr(39), ' /* WHERE */')
    WHEN 14 THEN 'WITH old AS (SELECT id FROM t WHERE a < 1) DELETE FROM t'
    WHEN 15 THEN 'DELETE FROM t USING (SELECT id FROM u WHERE x = 1) s'
    WHEN 16 THEN 'CREATE INDEX ON'
    WHEN 17 THEN 'ALTER TABLE ONLY t ALTER c DROP NOT NULL, ALTER COLUMN d DROP DEFAULT'
    WHEN 18 THEN 'DROP MATERIALIZED VIEW IF EXISTS mv CASCADE'
    WHEN 19 THEN 'DROP DATABASE old'
    WHEN 20 THEN 'SELECT (1'
    WHEN 21 THEN 'EXPLAIN SELECT 1;'
    ELSE concat('SELECT id, total FROM orders', chr(10), 'WHERE user_id = ', CAST(o_custkey AS string), ' -- narrow')
  END AS sql,
  CASE o_orderkey % 4
    WHEN 0 THEN NULL
    WHEN 1 THEN concat('select  id, total from orders where user_id = ', CAST(o_custkey AS string))
    WHEN 2 THEN 'SELECT * FROM orders WHERE user_id = 1 ORDER BY id'
    ELSE 'update users set active=false' END AS current_sql,
  CAST(o_totalprice / 1000000 AS decimal(5,4)) AS confidence,
  CASE WHEN o_orderkey % 5 = 0 THEN 'architect' ELSE 'manual' END AS source,
  CAST(NULL AS string) AS recommendation_id, 'primary' AS target_db
FROM {{orders}}
UNION ALL
SELECT ts, 1000000000 + event_id AS seq,
  CASE WHEN k = 99 THEN 'gone' ELSE concat('pw-', CAST(user_id * 10 + k % 10 AS string)) END AS proposal_id,
  CASE event_type WHEN 'view' THEN 'approve' WHEN 'click' THEN 'approve' WHEN 'error' THEN 'reject'
    ELSE 'apply' END AS action,
  CASE WHEN k % 9 = 0 THEN '' ELSE concat('r', CAST(k % 4 AS string)) END AS actor,
  CASE WHEN k % 5 = 0 THEN '  ' WHEN k % 5 = 1 THEN NULL ELSE concat(' no ', CAST(k AS string), ' ') END AS reason,
  k % 4 <> 0 AS confirm,
  CASE WHEN event_type = 'signup' AND k % 3 = 0 THEN concat('duplicate key ', CAST(k AS string), chr(10), 'detail') END AS error,
  CAST(NULL AS string), CAST(NULL AS string), CAST(NULL AS string), CAST(NULL AS decimal(5,4)),
  CAST(NULL AS string), CAST(NULL AS string), CAST(NULL AS string)
FROM (SELECT *, {K} AS k FROM {{events}})
"""

# Model answers: prose, a JSON object of varying shape, more prose.
RESPONSES = """
SELECT doc_id, concat(
  replace(replace(text, chr(123), ''), chr(125), ''),
  CASE WHEN doc_id % 11 = 10 THEN '' ELSE concat(
    chr(123), '"title": ',
    CASE WHEN doc_id % 7 = 0 THEN '5' ELSE concat('"Index ', CAST(doc_id AS string), '"') END,
    CASE WHEN doc_id % 2 = 0 THEN concat(', "recommendation_id": "r', CAST(doc_id AS string), '"') ELSE '' END,
    CASE doc_id % 5 WHEN 0 THEN ', "recommendation_type": "index"' WHEN 1 THEN ', "recommendation_type": "magic"'
      WHEN 2 THEN ', "recommendation_type": "vector_params"' ELSE '' END,
    CASE doc_id % 4 WHEN 0 THEN ', "risk_level": "high"' WHEN 1 THEN ', "risk_level": "none"' ELSE '' END,
    CASE doc_id % 3 WHEN 0 THEN concat(', "expected_effects": ', chr(123), '"latency_improvement_percent": ',
        CAST(doc_id % 90 AS string), '.5', chr(125))
      WHEN 1 THEN concat(', "expected_effects": ', chr(123), chr(125)) ELSE '' END,
    CASE WHEN doc_id % 13 = 0 THEN ', "priority": null' WHEN doc_id % 13 = 1 THEN ', "priority": "high"' ELSE '' END,
    CASE WHEN doc_id % 6 = 0 THEN concat(', "config_patch": ', chr(123), '"a": 1', chr(125)) ELSE '' END,
    ', "migration_sql": "CREATE INDEX i ON t (a)", "confidence_score": 0.', CAST(doc_id % 10 AS string),
    CASE WHEN doc_id % 17 = 3 THEN ', broken' ELSE '' END, chr(125)) END,
  ' thanks') AS response
FROM {documents}
"""

# Retrieval test set, row by row: the words of a text, and the long ones as relevant.
SPARK_GOLDEN = """
SELECT doc_id, text AS query, split(text, ' ') AS retrieved,
  filter(split(text, ' '), w -> length(w) >= 9) AS relevant
FROM {documents}
"""
DUCK_GOLDEN = """
SELECT doc_id, text AS query, string_split(text, ' ') AS retrieved,
  list_filter(string_split(text, ' '), lambda w: length(w) >= 9) AS relevant
FROM documents
"""

TABLES = ("events", "orders", "lineitem", "documents", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A bridge as a Spark DataFrame."""
    used = {n: table(spark, sf_dir, n) for n in TABLES if "{" + n + "}" in sql}
    return spark.sql(sql.replace("<NTZ>", "timestamp_ntz"), **used)


def duck(sql: str) -> str:
    """A bridge as DuckDB text."""
    return sql.replace("<NTZ>", "timestamp").format(**{n: n for n in TABLES})
