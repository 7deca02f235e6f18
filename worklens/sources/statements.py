"""Captures of the cumulative statement-statistics view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens import fixed, schemas

_COUNTS = ("calls", "rows", "shared_blks_hit", "shared_blks_read")
_TIMES = (
    "total_exec_time_ms", "mean_exec_time_ms", "stddev_exec_time_ms",
    "min_exec_time_ms", "max_exec_time_ms",
)
_IDS = ("queryid", "dbid", "userid")


class StatementsUnavailable(RuntimeError):
    """The table given is not a statement-statistics view."""


def current_names(view: DataFrame) -> DataFrame:
    """Rename the time columns of either server generation to the names used here."""
    if "total_exec_time_ms" in view.columns:
        return view
    for names in (fixed.CURRENT_STAT_COLUMNS, fixed.LEGACY_STAT_COLUMNS):
        if next(iter(names)) in view.columns:
            return view.withColumnsRenamed(names)
    raise StatementsUnavailable(fixed.STATS_MISSING)


def coerced(view: DataFrame) -> DataFrame:
    """Typed statement rows: absent or NULL counters are 0, ids may stay NULL."""

    def number(name: str, kind: str) -> Column:
        value = F.col(name).cast(kind) if name in view.columns else F.lit(None).cast(kind)
        return F.coalesce(value, F.lit(0).cast(kind)).alias(name)

    def identity(name: str) -> Column:
        return (F.col(name) if name in view.columns else F.lit(None)).cast("bigint").alias(name)

    typed = view.select(
        *[identity(n) for n in _IDS], "query",
        *[number(n, "bigint") for n in _COUNTS],
        *[number(n, "double") for n in _TIMES],
        *[c for c in view.columns if c not in (*_IDS, "query", *_COUNTS, *_TIMES)],
    )
    return typed


def scan_statements(
    view: DataFrame,
    min_calls: int = 1,
    dbid: int | Column | None = None,
    limit: int | None = None,
    include_utility: bool = False,
) -> DataFrame:
    """Statements worth keeping, highest mean time first.

    ``view`` is any DataFrame with the view's columns: a JDBC read (the filters are plain
    comparisons, so they can be pushed to the server) or a stored capture. ``dbid`` keeps
    one database; pass a scalar subquery to look it up. All statements are kept unless the
    caller sets a ``limit``.
    """
    named = current_names(view)
    query = F.col("query")
    kept = named.filter(
        (F.col("calls") >= max(int(min_calls), 1))
        & query.isNotNull()
        & (query != fixed.HIDDEN_QUERY)
    )
    if dbid is not None:
        kept = kept.filter(F.col("dbid") == dbid)
    if not include_utility:
        kept = kept.filter(
            ~query.rlike(fixed.UTILITY_STATEMENT) & ~F.lower(query).contains(fixed.STATS_VIEW)
        )
    if limit is not None:
        order = (F.col("mean_exec_time_ms").desc_nulls_last(), *_tie_break(kept))
        kept = kept.orderBy(*order).limit(limit)
    return schemas.conform(coerced(kept), schemas.STATEMENT_STATS)


def _tie_break(view: DataFrame) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in ("queryid", "dbid", "userid", "query") if c in view.columns]


def reset_time(info: DataFrame, column: str = "stats_reset") -> Column:
    """When the counters were last reset, from the server's one-row information table.

    A scalar subquery; null where the table has no row. A zone is dropped.
    """
    return info.agg(F.max(F.col(column).cast("timestamp_ntz"))).scalar()


def database_id(databases: DataFrame, name: str) -> Column:
    """Id of a database by its name, as a scalar subquery; null, which selects nothing, if there is none."""
    return databases.filter(F.col("datname") == name).agg(F.min("oid")).scalar()
