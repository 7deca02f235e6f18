"""Server log in csv format: one record per entry, messages may span lines, files are splittable.

Whether a line opens a record depends on all quotes before it: outside quotes a line feed ends
the record, inside it belongs to the message. A file split either keeps or swaps those two
states, as its quotes are even or odd in number (a doubled quote swaps twice). So a first pass
counts quotes per split, the states are composed over the splits of each file, and a second
pass cuts every split into records from its true state. Records over split edges are put
together as entries of the stderr log are. Quotes are expected where the csv form has them: in
quoted fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklens import fixed, schemas
from worklens.functions.sqltext import zone_tagged
from worklens.functions.text import strip
from worklens.functions.timestamps import log_timestamp
from worklens.sources.stderr_log import whole_entries
from worklens.sources.stitching import PIECE, quoted_stitcher

#: Columns that are read, by their place in a record; further ones of later servers are ignored.
_TIME, _MESSAGE, _COLUMNS = 0, 13, 14


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines as they are between line feeds, and whether they hold an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
        (quotes % 2).cast("int").alias("odd"),
    )


def splits_inside_quotes(log_lines: DataFrame) -> list[tuple[str, int]]:
    """The file splits that start inside a quoted field.

    One row per split, from counts that the tasks add up. The driver lists the splits of a
    scan anyway, so no more of them come back than it holds.
    """
    swaps = log_lines.groupBy("file", "block").agg((F.sum("odd") % 2).alias("swaps"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = swaps.withColumn("inside", F.coalesce(F.sum("swaps").over(before) % 2, F.lit(0)))
    return [(r["file"], r["block"]) for r in inside.where("inside = 1").select("file", "block").collect()]


def csv_records(log_lines: DataFrame, stage: bool = True) -> DataFrame:
    """Whole records ``(file, block, line, text)`` of one or more csv files."""
    pieces = log_lines.mapInArrow(quoted_stitcher(splits_inside_quotes(log_lines)), PIECE)
    return whole_entries(pieces, stage, "csv-pieces")


def read_csv_log(
    spark: SparkSession,
    path: str | list[str],
    source: str = fixed.SOURCE_POSTGRES,
    source_ord: int = 0,
    stage: bool = True,
) -> DataFrame:
    """Records whose message has a duration and a statement, as ``query_log`` rows.

    Records that are not of this form are left out.
    """
    schema = ", ".join(f"c{i} string" for i in range(_COLUMNS))
    text = F.regexp_replace("text", r"\r\z", "")
    fields = F.from_csv(text, schema, {"escape": '"', "mode": "PERMISSIVE", "multiLine": "true"})
    records = csv_records(_lines(spark, path), stage).withColumn("fields", fields).select(
        "file", "block", "line",
        F.col(f"fields.c{_TIME}").alias("at"),
        F.col(f"fields.c{_MESSAGE}").alias("body"),
    )
    found = records.filter(F.col("body").rlike(fixed.DURATION_STATEMENT)).select(
        "file", "block", "line",
        log_timestamp(F.substring("at", 1, 23)).alias("ts"),
        F.regexp_extract("at", r"(\S+)$", 1).alias("zone"),
        F.regexp_extract("body", fixed.DURATION_STATEMENT, 1).try_cast("double").alias("ms"),
        strip(F.regexp_extract("body", fixed.DURATION_STATEMENT, 3)).alias("statement"),
    )
    kept = found.filter(F.col("ts").isNotNull() & F.col("ms").isNotNull() & (F.col("statement") != ""))
    rows = kept.select(
        "ts",
        zone_tagged(F.col("statement"), F.col("zone")).alias("query"),
        F.col("ms").alias("execution_time_ms"),
        F.lit(True).alias("success"),
        F.lit(source).alias("source"),
        F.struct(F.lit(source_ord).alias("source_ord"), "file", "block", "line").alias("seq"),
    )
    return schemas.conform(rows, schemas.QUERY_LOG)
