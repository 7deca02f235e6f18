"""Small text helpers as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from worklens import fixed


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column that is referred to many times may be copied into each place by the
    optimiser; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` only removes spaces)."""
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def spaced_json(compact: Column) -> Column:
    """Compact JSON text with one space after each separator and ASCII escapes.

    The text is split into whole strings, separators and the runs between them, so
    commas and colons inside strings stay as they are.
    """
    tokens = F.regexp_extract_all(
        compact, F.lit(r'("(?:[^"\\]++|\\.)*+"|[^",:]++|[,:])'), F.lit(1)
    )
    spaced = F.transform(tokens, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(t))
    return ascii_escaped(F.array_join(spaced, ""))


def ascii_escaped(text: Column) -> Column:
    """Replace each non-ASCII character by its JSON escape, in UTF-16 units."""

    def one(ch: Column) -> Column:
        units = F.lower(F.hex(F.encode(ch, "utf-16be")))
        return F.when(F.ascii(ch) < 128, ch).otherwise(
            F.regexp_replace(units, "(.{4})", r"\\u$1")
        )

    escaped = F.array_join(F.transform(F.split(text, ""), one), "")
    return F.when(text.rlike(r"[^\x00-\x7f]"), escaped).otherwise(text)


def grouped(number: Column, places: int = 0) -> Column:
    """Number text with thousands separators, e.g. ``1,234.50``."""
    return F.format_number(number, places)


def plain(number: Column, places: int) -> Column:
    """Number text with fixed decimals and no separators."""
    return F.replace(F.format_number(number, places), F.lit(","), F.lit(""))


def timestamp_text(ts: Column, separator: str = " ") -> Column:
    """``YYYY-MM-DD HH:MM:SS``, with six digits of fraction only when there is one."""
    whole = F.date_format(ts, f"yyyy-MM-dd'{separator}'HH:mm:ss")
    micros = F.date_format(ts, f"yyyy-MM-dd'{separator}'HH:mm:ss.SSSSSS")
    return F.when(micros.endswith(".000000"), whole).otherwise(micros)
