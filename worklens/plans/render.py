"""Log files rendered from the given tables, so the log readers have whole tables to read.

Each record of the query log becomes one entry in one of the log formats; the variants
(several timestamp fields, missing and wrong values, junk lines) are chosen by ``k``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from worklens.plans import bridges
from worklens.session import scratch_path

STDERR = """
concat(
  date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS'), CASE WHEN k % 11 = 0 THEN ' EST [' ELSE ' UTC [' END,
  user_id, '] ',
  CASE k % 13 WHEN 0 THEN 'LOG:  connection authorized: user=app'
    WHEN 1 THEN 'ERROR:  relation does not exist'
    ELSE concat('LOG:  duration: ', CAST(CAST(execution_time_ms AS decimal(12,3)) AS string), ' ms  ',
      CASE WHEN k % 5 = 0 THEN 'execute <unnamed>: ' ELSE 'statement: ' END, query) END,
  CASE WHEN k % 7 = 0 THEN concat(chr(10), 'MALFORMED LINE') ELSE '' END)
"""

_QUOTED = "substr(to_json(named_struct('q', query)), 6, length(to_json(named_struct('q', query))) - 6)"

JSON = f"""
CASE k % 23 WHEN 4 THEN '[1, 2]' WHEN 5 THEN '   ' ELSE concat(
  chr(123), '"database": "db', user_id % 3, '", ',
  CASE WHEN k % 19 = 18 THEN concat('"timestamp": "', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 'Z"')
    WHEN k % 3 = 0 THEN concat('"timestamp": "', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), 'Z"')
    WHEN k % 3 = 1 THEN concat('"timestamp": "", "time": "', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), '"')
    ELSE concat('"ts": "', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '"') END,
  CASE WHEN k % 4 = 0 THEN concat(', "duration_ms": 0, "latency_ms": ', execution_time_ms)
    WHEN k % 4 = 1 THEN concat(', "latency_ms": "', execution_time_ms, '"')
    ELSE concat(', "duration_ms": ', execution_time_ms) END,
  CASE k % 29 WHEN 5 THEN '' WHEN 6 THEN ', "query": null' ELSE concat(', "query": ', {_QUOTED}) END,
  CASE k % 31 WHEN 7 THEN ', "success": null' WHEN 8 THEN ', "success": "no"' WHEN 9 THEN ''
    ELSE concat(', "success": ', success) END,
  CASE WHEN k % 37 = 1 THEN ', "rows_returned": "x"' WHEN k % 37 = 2 THEN ', "rows_returned": "12"'
    WHEN k % 37 = 3 THEN ', "rows_returned": 3.0' WHEN rows_returned IS NULL THEN ''
    ELSE concat(', "rows_returned": ', rows_returned) END,
  CASE WHEN success THEN '' ELSE ', "error": "failed, badly"' END,
  CASE WHEN k % 23 = 3 THEN ', oops' ELSE '' END, chr(125)) END
"""

VECTOR = """
concat(chr(123),
  CASE k % 9 WHEN 0 THEN '' WHEN 1 THEN '"timestamp": "yesterday", '
    WHEN 2 THEN concat('"timestamp": "', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), '+02:00", ')
    WHEN 3 THEN concat('"timestamp": "', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), '", ')
    ELSE concat('"timestamp": "', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), 'Z", ') END,
  CASE WHEN k % 10 = 0 THEN '' ELSE concat('"collection": "c', user_id % 5, '", ') END,
  '"top_k": ', k, ', ',
  CASE k % 4 WHEN 0 THEN concat('"filter": ', chr(123), '"z":"a, b: c","n":[1,2]', chr(125), ', ')
    WHEN 1 THEN '"filter": "x,y", ' WHEN 2 THEN '"filter": null, ' ELSE '' END,
  CASE WHEN k % 12 = 0 THEN '' ELSE concat('"latency_ms": ', execution_time_ms, ', ') END,
  '"results_count": ', k % 50, ', "status": "', CASE WHEN success THEN 'success' ELSE 'error' END, '"', chr(125))
"""


def log_files(spark: SparkSession, sf_dir: str, line: str, where: str = "true", path: str | None = None) -> str:
    """Append one log line (or multi-line entry) per query-log record; returns the folder."""
    path = path or scratch_path(spark, "log")
    log = bridges.view(spark, sf_dir, bridges.QUERY_LOG).where(where)
    log.select(F.expr(line).alias("value")).write.mode("append").text(path)
    return path


CSV_MESSAGE = """
concat(
  CASE k % 13 WHEN 0 THEN 'connection authorized: user=app' WHEN 1 THEN 'relation does not exist'
    ELSE concat('duration: ', CAST(CAST(execution_time_ms AS decimal(12,3)) AS string), ' ms  ',
      CASE WHEN k % 5 = 0 THEN 'execute <unnamed>: ' ELSE 'statement: ' END, query) END,
  CASE WHEN k % 7 = 0 THEN concat(chr(10), 'MALFORMED LINE') ELSE '' END)
"""


def csv_files(spark: SparkSession, sf_dir: str) -> str:
    """Write one csv log record per query-log record; returns the folder."""
    path = scratch_path(spark, "csv-log")
    log = bridges.view(spark, sf_dir, bridges.QUERY_LOG)
    at = F.expr("concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS'), CASE WHEN k % 11 = 0 THEN ' EST' ELSE ' UTC' END)")
    between = [F.lit(f"field {i}").alias(f"c{i}") for i in range(1, 13)]
    after = [F.lit(None).cast("string").alias(f"c{i}") for i in range(14, 23)]
    rows = log.select(at.alias("c0"), *between, F.expr(CSV_MESSAGE).alias("c13"), *after)
    rows.write.options(escape='"', quoteAll=True).csv(path)
    return path
