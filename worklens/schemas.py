"""Declared schemas of the tables this package reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TS = T.TimestampNTZType()
STR = T.StringType()
LONG = T.LongType()
INT = T.IntegerType()
DBL = T.DoubleType()
BOOL = T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


SEQ = _struct(("source_ord", INT), ("file", STR), ("block", LONG), ("line", LONG))

QUERY_LOG = _struct(
    ("ts", TS), ("query", STR), ("query_type", STR), ("execution_time_ms", DBL),
    ("rows_returned", LONG), ("rows_scanned", LONG), ("buffer_hits", LONG),
    ("buffer_misses", LONG), ("success", BOOL), ("error_message", STR), ("source", STR),
    ("database", STR), ("user", STR), ("seq", SEQ),
)

STATEMENT_STATS = _struct(
    ("queryid", LONG), ("dbid", LONG), ("userid", LONG), ("query", STR), ("calls", LONG),
    ("total_exec_time_ms", DBL), ("mean_exec_time_ms", DBL), ("stddev_exec_time_ms", DBL),
    ("min_exec_time_ms", DBL), ("max_exec_time_ms", DBL), ("rows", LONG),
    ("shared_blks_hit", LONG), ("shared_blks_read", LONG),
)

STAT_CAPTURE = T.StructType(
    [T.StructField("captured_at", TS)]
    + STATEMENT_STATS.fields[:3]
    + [T.StructField("query_fingerprint", STR), T.StructField("query_type", STR)]
    + STATEMENT_STATS.fields[3:]
)

GOLDEN_SET = _struct(
    ("query", STR), ("retrieved", T.ArrayType(STR)), ("relevant", T.ArrayType(STR))
)

# Stored form: NUMERIC columns are rounded on write.
WORKLOAD_SNAPSHOT = _struct(
    ("snapshot_timestamp", TS), ("window_start", TS), ("window_end", TS),
    ("query_fingerprint", STR), ("query_type", STR), ("query_source", STR),
    ("example_query", STR), ("execution_count", LONG),
    ("total_execution_time_ms", T.DecimalType(15, 3)),
    ("avg_execution_time_ms", T.DecimalType(15, 3)),
    ("p50_latency_ms", T.DecimalType(15, 3)), ("p95_latency_ms", T.DecimalType(15, 3)),
    ("p99_latency_ms", T.DecimalType(15, 3)), ("max_latency_ms", T.DecimalType(15, 3)),
    ("min_latency_ms", T.DecimalType(15, 3)), ("avg_rows_returned", T.DecimalType(15, 2)),
    ("avg_rows_scanned", T.DecimalType(15, 2)), ("avg_buffer_hits", T.DecimalType(15, 2)),
    ("avg_buffer_misses", T.DecimalType(15, 2)), ("error_count", LONG),
    ("error_rate", T.DecimalType(5, 4)), ("impact_score", T.DecimalType(20, 3)),
)

VIOLATIONS = T.MapType(STR, _struct(("actual", DBL), ("threshold", DBL)))

EVAL_RESULT = _struct(
    ("eval_timestamp", TS), ("eval_type", STR), ("environment", STR), ("config_version", STR),
    ("metrics", STR), ("overall_score", T.DecimalType(10, 6)),
    ("p95_latency_ms", T.DecimalType(15, 3)), ("p99_latency_ms", T.DecimalType(15, 3)),
    ("error_rate", T.DecimalType(5, 4)), ("rag_mrr", T.DecimalType(10, 6)),
    ("rag_precision_at_k", T.DecimalType(10, 6)), ("rag_recall_at_k", T.DecimalType(10, 6)),
    ("slo_passed", BOOL), ("slo_violations", STR), ("test_count", LONG),
    ("passed_count", LONG), ("failed_count", LONG), ("notes", STR),
)

RECOMMENDATION = _struct(
    ("recommendation_id", STR), ("recommendation_timestamp", TS), ("status", STR),
    ("priority", STR), ("workload_snapshot_ids", T.ArrayType(INT)),
    ("eval_result_ids", T.ArrayType(INT)), ("recommendation_type", STR), ("title", STR),
    ("rationale", STR), ("config_patch", STR), ("expected_effects", STR),
    ("expected_latency_improvement_percent", T.DecimalType(10, 2)),
    ("expected_cost_reduction_percent", T.DecimalType(10, 2)), ("risk_level", STR),
    ("risk_notes", STR), ("migration_sql", STR), ("rollback_sql", STR), ("approved_by", STR),
    ("approved_at", TS), ("implemented_by", STR), ("implemented_at", TS),
    ("actual_effects", STR), ("implementation_notes", STR), ("model_name", STR),
    ("model_version", STR), ("confidence_score", T.DecimalType(5, 4)),
)

CONFIG_HISTORY = _struct(
    ("change_timestamp", TS), ("config_key", STR), ("old_value", STR), ("new_value", STR),
    ("change_reason", STR), ("recommendation_id", STR), ("changed_by", STR),
)

REVIEW_EVENT = _struct(
    ("ts", TS), ("seq", LONG), ("proposal_id", STR), ("action", STR), ("actor", STR),
    ("reason", STR), ("confirm", BOOL), ("error", STR), ("title", STR), ("sql", STR),
    ("current_sql", STR), ("confidence", T.DecimalType(5, 4)), ("source", STR),
    ("recommendation_id", STR), ("target_db", STR),
)

REVIEW_AUDIT = _struct(
    ("ts", TS), ("seq", LONG), ("proposal_id", STR), ("action", STR), ("actor", STR),
    ("reason", STR), ("details", STR),
)

TABLES = {
    "workload_snapshots": WORKLOAD_SNAPSHOT,
    "eval_results": EVAL_RESULT,
    "recommendations": RECOMMENDATION,
    "config_history": CONFIG_HISTORY,
    "stat_snapshots": STAT_CAPTURE,
    "review_events": REVIEW_EVENT,
    "review_audit": REVIEW_AUDIT,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to ``schema``: absent columns become NULL, the rest are cast.

    A double goes to NUMERIC through its shortest decimal text, as a database client
    sends it, and rounds half up.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def column(field: T.StructField) -> Column:
        if field.name not in kinds:
            return F.lit(None).cast(field.dataType).alias(field.name)
        return F.col(field.name).cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema.fields])
