"""SQL-text functions: fingerprint, hash, statement type and table names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worklens import fixed
from worklens.functions.text import let


def fingerprint(
    query: Column,
    *,
    normalize_literals: bool = True,
    normalize_whitespace: bool = True,
    case_insensitive: bool = True,
) -> Column:
    """Normalised statement pattern; each flag adds its steps to one expression chain."""
    out = F.upper(query) if case_insensitive else query
    if normalize_literals:
        for pattern, replacement in (
            (fixed.SQUASHED_LIST, ""),
            (fixed.PARAMETER, "?"),
            (fixed.QUOTED_LITERAL, "?"),
            (fixed.DECIMAL_NUMBER, "?"),
            (fixed.INTEGER_NUMBER, "?"),
            (fixed.VALUE_LIST, "(?)"),
        ):
            out = F.regexp_replace(out, pattern, replacement)
    if normalize_whitespace:
        out = F.trim(F.regexp_replace(out, fixed.WHITESPACE_RUN, " "))
    return out


def fingerprint_hash(pattern: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a fingerprint."""
    return F.substring(F.sha2(pattern, 256), 1, 16)


def query_hash(query: Column, **flags: bool) -> Column:
    return fingerprint_hash(fingerprint(query, **flags))


def query_type(query: Column) -> Column:
    """First matching statement type; a prefix test without a word boundary."""
    head = F.upper(F.substring(F.ltrim(query, F.lit(fixed.WHITESPACE)), 1, 10))
    found = F.regexp_extract(head, "^(" + "|".join(fixed.QUERY_TYPES) + ")", 1)
    return F.when(found == "", fixed.OTHER_TYPE).otherwise(found)


def tables(query: Column) -> Column:
    """Table names: pattern order, first occurrence kept."""

    def names(scrubbed: Column) -> Column:
        found = F.concat(
            *[F.regexp_extract_all(scrubbed, F.lit(p), F.lit(1)) for p in fixed.TABLE_PATTERNS]
        )
        kept = F.filter(found, lambda name: ~F.upper(name).isin(*fixed.NOT_TABLES))
        return F.array_distinct(F.transform(kept, lambda name: F.btrim(name, F.lit('"'))))

    return let(F.regexp_replace(query, fixed.EXTRACT_CALL, " "), names)


def zone_tagged(query: Column, zone: Column) -> Column:
    """Append the log's zone to the statement unless it is UTC."""
    return F.when(
        F.upper(zone) != "UTC",
        F.concat(query, F.lit(fixed.ZONE_TAG), zone, F.lit(fixed.ZONE_TAG_END)),
    ).otherwise(query)
