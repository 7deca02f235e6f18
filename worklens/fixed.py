"""Constants, patterns, word lists and message texts that decide results.

Everything here is data. Changing a value changes query results, so the values are
kept together, in plain text and natural order.
"""

# --- fixed values: whitespace stripped at both ends of a text -----------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: fingerprint patterns (Java syntax, Unicode classes) --------------
# The literal pattern is possessive: alternation under a plain group quantifier would
# overflow the JVM stack on long literals. Its second branch takes the part up to the
# last quote when a literal is not terminated.
SQUASHED_LIST = r"(?U)/\*\s*,\s*\.\.\.\s*\*/"
PARAMETER = r"(?U)\$\d+\b"
QUOTED_LITERAL = r"'(?:[^']++|'')*+'|'(?s:.*)(?=')"
DECIMAL_NUMBER = r"(?U)\b\d+\.\d+\b"
INTEGER_NUMBER = r"(?U)\b\d+\b"
VALUE_LIST = r"(?U)\([\s\x1c-\x1f?,]*\)"
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

# --- fixed values: statement types, in test order -----------------------------------
QUERY_TYPES = (
    "SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER",
    "DROP", "TRUNCATE", "BEGIN", "COMMIT", "ROLLBACK", "WITH",
)
OTHER_TYPE = "OTHER"
VECTOR_TYPE = "VECTOR_SEARCH"

# --- fixed values: table-name patterns, in result order -----------------------------
EXTRACT_CALL = r"(?iU)\bEXTRACT\s*\([^)]*\)"
TABLE_PATTERNS = (
    r'(?iU)\bFROM\s+("?[\w]+"?\.?\w*)',
    r'(?iU)\bJOIN\s+("?[\w]+"?\.?\w*)',
    r'(?iU)\bUPDATE\s+("?[\w]+"?\.?\w*)',
    r'(?iU)\bDELETE\s+FROM\s+("?[\w]+"?\.?\w*)',
    r'(?iU)\bINSERT\s+INTO\s+("?[\w]+"?\.?\w*)',
)
NOT_TABLES = ("SELECT", "WHERE", "SET", "VALUES", "LATERAL")

# --- fixed values: stderr log format ------------------------------------------------
# A line starts an entry when it has the prefix; the loose form also accepts a prefix
# with nothing after the level, which ends the entry before it but starts none.
ENTRY_START = (
    r"(?U)^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}\s+\S+\s+\[\d+\]\s+\w+:(?:\s|$)"
)
ENTRY_FIELDS = (
    r"(?sU)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\s+(\S+)\s+\[(\d+)\]\s+(\w+):[^\S\n]+(.*)$"
)
DURATION_STATEMENT = r"(?isU)duration:\s*([\d.]+)\s*ms\s+(?:statement|(?:execute\s+(\S+))):\s*(.*)$"
ZONE_TAG = " /* pg_log_tz="
ZONE_TAG_END = " */"

# --- fixed values: source names -----------------------------------------------------
SOURCE_POSTGRES = "postgres"
SOURCE_VECTOR = "vector_db"
SOURCE_APPLICATION = "application"

# --- fixed values: JSON log timestamps (pattern that selects a form) -----------------
JSON_TS_FRACTION_Z = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}Z$"
JSON_TS_SPACE = r"^\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$"
JSON_TS_T = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"
ZONE_SUFFIX = r"(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)$"
TRUE_WORDS = ("1", "on", "t", "true", "y", "yes")
FALSE_WORDS = ("0", "off", "f", "false", "n", "no")

# --- fixed values: statement statistics ----------------------------------------------
HIDDEN_QUERY = "<insufficient privilege>"
STATS_VIEW = "pg_stat_statements"
UTILITY_STATEMENT = r"(?i)^\s*(BEGIN|COMMIT|ROLLBACK|SET|SHOW|RESET|DISCARD)\b"
Z_P95 = 1.645
Z_P99 = 2.326
LEGACY_STAT_COLUMNS = {
    "total_time": "total_exec_time_ms",
    "mean_time": "mean_exec_time_ms",
    "stddev_time": "stddev_exec_time_ms",
    "min_time": "min_exec_time_ms",
    "max_time": "max_exec_time_ms",
}
CURRENT_STAT_COLUMNS = {
    "total_exec_time": "total_exec_time_ms",
    "mean_exec_time": "mean_exec_time_ms",
    "stddev_exec_time": "stddev_exec_time_ms",
    "min_exec_time": "min_exec_time_ms",
    "max_exec_time": "max_exec_time_ms",
}
STATS_MISSING = (
    "pg_stat_statements is not available: add it to shared_preload_libraries, restart, "
    "run CREATE EXTENSION pg_stat_statements and grant pg_read_all_stats to the reader"
)

# --- fixed values: service-level thresholds ------------------------------------------
SLO_P95_MS = 500.0
SLO_P99_MS = 1000.0
SLO_ERROR_RATE = 0.001

# --- fixed values: verbs a PostgreSQL statement can start with ------------------------
STATEMENT_VERBS = (
    "ABORT", "ALTER", "ANALYZE", "BEGIN", "CALL", "CHECKPOINT", "CLOSE", "CLUSTER",
    "COMMENT", "COMMIT", "COPY", "CREATE", "DEALLOCATE", "DECLARE", "DELETE", "DISCARD",
    "DO", "DROP", "END", "EXECUTE", "EXPLAIN", "FETCH", "GRANT", "IMPORT", "INSERT",
    "LISTEN", "LOAD", "LOCK", "MERGE", "MOVE", "NOTIFY", "PREPARE", "REASSIGN", "REFRESH",
    "REINDEX", "RELEASE", "RESET", "REVOKE", "ROLLBACK", "SAVEPOINT", "SECURITY", "SELECT",
    "SET", "SHOW", "START", "TABLE", "TRUNCATE", "UNLISTEN", "UPDATE", "VACUUM", "VALUES",
    "WITH",
)
# Reserved words after which a statement cannot end.
DANGLING_WORDS = (
    "AND", "AS", "BY", "FROM", "HAVING", "IN", "INTO", "JOIN", "LIKE", "NOT", "ON", "OR",
    "TABLE", "UNION", "USING", "WHERE", "WITH",
)

# --- fixed values: what DROP can name, and the kind it is reported as -----------------
# Longest spelling first where one is the start of another.
DROP_KINDS = (
    ("ACCESS METHOD", "ACCESS_METHOD"), ("AGGREGATE", "AGGREGATE"), ("CAST", "CAST"),
    ("COLLATION", "COLLATION"), ("CONVERSION", "CONVERSION"), ("DOMAIN", "DOMAIN"),
    ("EVENT TRIGGER", "EVENT_TRIGGER"), ("EXTENSION", "EXTENSION"),
    ("FOREIGN DATA WRAPPER", "FDW"), ("FOREIGN TABLE", "FOREIGN_TABLE"),
    ("FUNCTION", "FUNCTION"), ("INDEX", "INDEX"), ("LANGUAGE", "LANGUAGE"),
    ("MATERIALIZED VIEW", "MATVIEW"), ("OPERATOR CLASS", "OPCLASS"),
    ("OPERATOR FAMILY", "OPFAMILY"), ("OPERATOR", "OPERATOR"), ("POLICY", "POLICY"),
    ("PROCEDURE", "PROCEDURE"), ("PUBLICATION", "PUBLICATION"), ("ROUTINE", "ROUTINE"),
    ("RULE", "RULE"), ("SCHEMA", "SCHEMA"), ("SEQUENCE", "SEQUENCE"),
    ("SERVER", "FOREIGN_SERVER"), ("STATISTICS", "STATISTIC_EXT"), ("TABLE", "TABLE"),
    ("TEXT SEARCH CONFIGURATION", "TSCONFIGURATION"),
    ("TEXT SEARCH DICTIONARY", "TSDICTIONARY"), ("TEXT SEARCH PARSER", "TSPARSER"),
    ("TEXT SEARCH TEMPLATE", "TSTEMPLATE"), ("TRANSFORM", "TRANSFORM"),
    ("TRIGGER", "TRIGGER"), ("TYPE", "TYPE"), ("VIEW", "VIEW"),
)

# --- fixed values: SQL-check messages --------------------------------------------------
TRUNCATE_REASON = "TRUNCATE"
DELETE_REASON = "DELETE without WHERE (deletes every row)"
UPDATE_REASON = "UPDATE without WHERE (rewrites every row)"
ALTER_REASON = "ALTER TABLE "
EMPTY_SQL = "empty SQL"
ONLY_COMMENTS = "no SQL statements (only comments?)"
PARSE_ERROR = "parse error: syntax error"
PARSE_FAILED_FLAG = "PARSE FAILED"

# --- fixed values: review ledger --------------------------------------------------------
STATUSES = ("pending", "approved", "rejected", "applied", "failed")
MODE_OFF_WORDS = ("0", "false", "no", "off")
NEEDS_CONFIRM = "apply requires explicit confirmation"
DOES_NOT_PARSE = "SQL does not parse"
NO_APPROVER = "approve needs a reviewer name"
NO_REJECTER = "reject needs a reviewer name"
NO_REASON = "reject needs a reason"

# --- fixed values: heuristic recommendation -----------------------------------------------
EXPLAIN_READ = "EXPLAIN (ANALYZE, BUFFERS) "
EXPLAIN_PLAN = "EXPLAIN "
HEALTH_SQL = "SELECT version();"
HEALTH_TITLE = "Stub health check"
HEALTH_RATIONALE = "No workload snapshots available; emit a no-op health SQL for CI loop."
EXPLAIN_TITLE = "Explain high-impact query ("
EXPLAIN_RATIONALE = (
    "Stub heuristic: highest impact_score query should be EXPLAINed before index changes."
)
STUB_PATCH = '{"backend": "stub", "mlx": false}'
STUB_ROLLBACK = "-- stub: no-op"
STUB_MODEL = "stub-architect"
STUB_VERSION = "0.1.0"
STUB_CONFIDENCE = 0.4
ARCHITECT_SOURCE = "architect"

# --- fixed values: recommendation enums and defaults -----------------------------------------
RECOMMENDATION_TYPES = ("index", "query_rewrite", "schema_change", "config_tuning", "vector_params")
DEFAULT_TYPE = "config_tuning"
RISK_LEVELS = ("low", "medium", "high")
DEFAULT_RISK = "medium"
DEFAULT_PRIORITY = "medium"
DEFAULT_TITLE = "Optimization Recommendation"
