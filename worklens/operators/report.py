"""Analysis reports as text columns: one text per group, each section a fixed layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.functions.text import grouped, plain, timestamp_text

NO_WORKLOAD = "No workload data available."
NO_RESULTS = "No evaluation results available."
NO_SCHEMA = "## Database Schema\n\n(Schema information not provided)\n\n"
NO_CONFIG = "## Current Configuration\n\n(Configuration information not provided)\n\n"


def _line(label: str, *value: Column | str) -> Column:
    parts = [v if isinstance(v, Column) else F.lit(v) for v in value]
    return F.concat(F.lit(f"- {label}: "), *parts, F.lit("\n"))


def _present(value: Column) -> Column:
    """Neither NULL nor zero."""
    return F.coalesce(value != 0, F.lit(False))


def _when(shown: Column, line: Column) -> Column:
    return F.when(shown, line).otherwise("")


def _double(name: str) -> Column:
    return F.col(name).cast("double")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("None"))


def _workload_entry(rank: Column) -> Column:
    returned, scanned = _double("avg_rows_returned"), _double("avg_rows_scanned")
    errors = _double("error_rate")
    return F.concat(
        F.lit("### Query Pattern "), rank.cast("string"), F.lit("\n"),
        _line("Fingerprint", "`", F.substring("query_fingerprint", 1, 100), "...`"),
        _line("Type", _text("query_type")),
        _line("Source", _text("query_source")),
        _line("Executions", grouped(F.col("execution_count"))),
        _line("P95 Latency", plain(_double("p95_latency_ms"), 2), "ms"),
        _line("P99 Latency", plain(_double("p99_latency_ms"), 2), "ms"),
        _line("Impact Score", grouped(_double("impact_score"))),
        _when(_present(returned), _line("Avg Rows Returned", plain(returned, 0))),
        _when(_present(scanned), _line("Avg Rows Scanned", plain(scanned, 0))),
        _when(F.coalesce(errors > 0, F.lit(False)), _line("Error Rate", plain(errors * 100, 2), "%")),
        _line("Example Query", "`", F.substring("example_query", 1, 200), "...`"),
        F.lit("\n"),
    )


def top_entries(snapshots: DataFrame, by: tuple[str, ...] = (), limit: int = 50) -> DataFrame:
    """The ``limit`` highest-impact snapshots per group, with their rank.

    The rank filter is applied before the shuffle as well, so each task passes on at most
    ``limit`` rows per group.
    """
    order = (F.desc("impact_score"), F.asc("query_fingerprint"), F.asc("snapshot_timestamp"))
    if not by:
        snapshots = snapshots.orderBy(*order).limit(limit)
    window = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(1)]).orderBy(*order)
    return snapshots.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= limit)


def workload_summary(snapshots: DataFrame, by: tuple[str, ...] = (), limit: int = 50) -> DataFrame:
    """Workload section per group: (by..., workload_summary)."""
    entries = top_entries(snapshots, by, limit).select(
        *by, F.struct("rank", _workload_entry(F.col("rank")).alias("text")).alias("entry")
    )
    shown = entries.groupBy(*by).agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    totals = snapshots.groupBy(*by).agg(F.count(F.lit(1)).alias("patterns"))
    joined = totals.join(shown, list(by)) if by else totals.withColumn(
        "entries", shown.select("entries").scalar()
    )
    text = F.concat(
        F.lit("## Workload Summary\n\nTotal query patterns analyzed: "),
        F.col("patterns").cast("string"),
        F.lit("\nShowing top "), F.size("entries").cast("string"),
        F.lit(" by impact score:\n\n"),
        F.array_join(F.col("entries.text"), ""),
    )
    return joined.select(
        *by, F.when(F.col("patterns") == 0, NO_WORKLOAD).otherwise(text).alias("workload_summary")
    )


def _result_entry() -> Column:
    violated = F.map_keys(F.from_json("slo_violations", "map<string,string>"))
    names = F.concat(F.lit("['"), F.array_join(violated, "', '"), F.lit("']"))
    score, mrr = _double("overall_score"), _double("rag_mrr")
    p95, p99 = _double("p95_latency_ms"), _double("p99_latency_ms")
    return F.concat(
        F.lit("### "), "eval_type", F.lit("\n"),
        _line("Timestamp", timestamp_text(F.col("eval_timestamp"))),
        _when(_present(score), _line("Overall Score", plain(score, 4))),
        _when(_present(p95), _line("P95 Latency", plain(p95, 2), "ms")),
        _when(_present(p99), _line("P99 Latency", plain(p99, 2), "ms")),
        _when(_present(mrr), _line("RAG MRR", plain(mrr, 4))),
        _when(
            F.col("slo_passed").isNotNull(),
            _line("SLO Status", F.when(F.col("slo_passed"), "PASSED").otherwise("FAILED")),
        ),
        _when(F.coalesce(F.size(violated) > 0, F.lit(False)), _line("SLO Violations", names)),
        F.lit("\n"),
    )


def eval_summary(results: DataFrame, limit: int = 5) -> DataFrame:
    """Evaluation section over the newest results: one row (eval_summary)."""
    newest = results.orderBy(F.desc("eval_timestamp"), "eval_type").limit(limit)
    parts = newest.select(
        F.struct((-F.unix_micros(F.col("eval_timestamp").cast("timestamp"))).alias("o"), "eval_type", _result_entry().alias("text")).alias("e")
    ).agg(F.array_sort(F.collect_list("e")).alias("entries"))
    text = F.concat(F.lit("## Evaluation Results\n\n"), F.array_join(F.col("entries.text"), ""))
    return parts.select(
        F.when(F.size("entries") == 0, NO_RESULTS).otherwise(text).alias("eval_summary")
    )


def schema_summary(tables: Column, indexes: Column) -> Column:
    """Schema section from arrays of ``struct<name, columns: array<struct<name, type>>>`` and
    ``struct<name, table>``; at most 5 columns per table and 20 indexes are shown."""
    column_lines = lambda t: F.array_join(
        F.transform(
            F.slice(F.coalesce(t["columns"], F.array().cast("array<struct<name:string,type:string>>")), 1, 5),
            lambda c: F.concat(F.lit("  - "), c["name"], F.lit(": "), c["type"], F.lit("\n")),
        ),
        "",
    )
    table_text = F.array_join(
        F.transform(tables, lambda t: F.concat(F.lit("- "), t["name"], F.lit("\n"), column_lines(t))), ""
    )
    index_text = F.array_join(
        F.transform(
            F.slice(indexes, 1, 20),
            lambda i: F.concat(F.lit("- "), i["name"], F.lit(" on "), i["table"], F.lit("\n")),
        ),
        "",
    )
    return F.when(tables.isNull() & indexes.isNull(), NO_SCHEMA).otherwise(
        F.concat(
            F.lit("## Database Schema\n\n"),
            F.when(tables.isNotNull(), F.concat(F.lit("### Tables\n"), table_text, F.lit("\n"))).otherwise(""),
            F.when(indexes.isNotNull(), F.concat(F.lit("### Existing Indexes\n"), index_text, F.lit("\n"))).otherwise(""),
        )
    )


def config_summary(settings: Column) -> Column:
    """Configuration section from a ``map<string,string>`` (NULL or empty: not provided)."""
    lines = F.array_join(
        F.transform(
            F.map_entries(settings),
            lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n")),
        ),
        "",
    )
    return F.when(settings.isNull() | (F.size(settings) == 0), NO_CONFIG).otherwise(
        F.concat(F.lit("## Current Configuration\n\n```yaml\n"), lines, F.lit("```\n\n"))
    )


def analysis_report(
    snapshots: DataFrame,
    results: DataFrame | None,
    as_of: Column,
    focus_areas: list[str] | None = None,
    limit: int = 50,
    schema: DataFrame | None = None,
    settings: DataFrame | None = None,
) -> DataFrame:
    """The whole report as one row (report).

    ``schema`` has a row (tables, indexes), see :func:`schema_summary`, ``settings`` rows (name, value).
    """
    base = workload_summary(snapshots, (), limit)
    stamp = as_of.cast("timestamp_ntz")
    sections = [
        F.lit("# Database Performance Analysis Request\n\nDate: "),
        timestamp_text(stamp, "T"),
        F.lit("\n\n"),
        F.col("workload_summary"),
    ]
    if results is not None:
        sections.append(eval_summary(results).scalar())
    if schema is not None:
        sections.append(schema.select(schema_summary(F.col("tables"), F.col("indexes")).alias("text")).agg(F.max("text")).scalar())
    if settings is not None:
        given = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value"))))
        sections.append(settings.agg(given.alias("given")).select(config_summary(F.col("given"))).scalar())
    if focus_areas:
        sections.append(F.lit("## Focus Areas\n\n" + "".join(f"- {a}\n" for a in focus_areas) + "\n"))
    return base.select(F.concat(*sections).alias("report"))
