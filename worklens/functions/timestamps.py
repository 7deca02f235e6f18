"""Timestamp coercions of the log readers. All results are TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worklens import fixed


def log_timestamp(text: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS.mmm``; NULL when it is not a date."""
    return text.try_cast("timestamp_ntz")


def json_timestamp(text: Column) -> Column:
    """The three accepted forms; NULL for anything else."""
    plain = F.regexp_replace(F.regexp_replace(text, "Z$", ""), "T", " ")
    known = (
        text.rlike(fixed.JSON_TS_FRACTION_Z)
        | text.rlike(fixed.JSON_TS_SPACE)
        | text.rlike(fixed.JSON_TS_T)
    )
    return F.when(known, F.regexp_replace(plain, r"\s+", " ").try_cast("timestamp_ntz"))


def iso_timestamp(text: Column) -> Column:
    """ISO-8601; a zoned value is moved to UTC, an unzoned one is kept as it is."""
    zoned = text.try_cast("timestamp")
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (F.unix_micros(zoned) / 1000000).cast("decimal(18,6)")
    )
    has_zone = text.rlike(r"[T ].*" + fixed.ZONE_SUFFIX)
    return F.when(has_zone, utc).otherwise(text.try_cast("timestamp_ntz"))
