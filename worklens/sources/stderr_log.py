"""Server log in stderr format: multi-line entries, read split by split.

Stitching does not shuffle the log text. Each task joins the lines of the file splits it
reads with Arrow kernels; only the pieces at split edges (the lines before a split's
first entry, and its last entry) go through a small shuffle that puts them together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklens import fixed, schemas
from worklens.functions.sqltext import zone_tagged
from worklens.functions.text import strip
from worklens.functions.timestamps import log_timestamp
from worklens.session import staged
from worklens.sources.stitching import PIECE, stitch


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines with their file, split offset and a line number that grows within a split."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )


def entries(log_lines: DataFrame, stage: bool = True) -> DataFrame:
    """Whole entries ``(file, block, line, text)`` of one or more log files.

    The pieces are written once to the shared scratch folder, so the text is not read and
    joined a second time for the split edges. Lines of a file before its first entry, or all
    lines of a file without any, are dropped where they are read: only the numbers of their
    splits take part in finding out which of them continue an entry.
    """
    # A window over the lines of a split would do the same, but shuffles every line.
    pieces = log_lines.withColumn("start", F.col("value").rlike(fixed.ENTRY_START)).mapInArrow(
        stitch, PIECE
    )
    return whole_entries(pieces, stage)


def whole_entries(pieces: DataFrame, stage: bool = True, name: str = "log-pieces") -> DataFrame:
    """Entries from the pieces of :mod:`worklens.sources.stitching`: those inside a split, and those over its edges."""
    if stage:
        pieces = staged(pieces, name)
    whole = pieces.filter("kind = 'entry'").select("file", "block", "line", "text")

    # At most two rows per split meet here, whatever the size of the log, and no text.
    order = Window.partitionBy("file").orderBy("block", "line")
    edge = pieces.filter("kind <> 'entry'")
    numbered = edge.select("file", "block", "line", "kind").withColumn(
        "entry", F.sum(F.when(F.col("kind") == "last", 1).otherwise(0)).over(order)
    )
    edges = edge.select("file", "block", "line", "text").join(
        numbered.filter("entry > 0").drop("kind"), ["file", "block", "line"]
    )
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "text")))
    stitched = (
        edges.groupBy("file", "entry")
        .agg(parts.alias("parts"))
        .select(
            "file",
            F.col("parts")[0]["block"].alias("block"),
            F.col("parts")[0]["line"].alias("line"),
            F.array_join(F.col("parts.text"), "\n").alias("text"),
        )
    )
    return whole.unionByName(stitched)


def parse_entries(
    log_entries: DataFrame, source: str = fixed.SOURCE_POSTGRES, source_ord: int = 0
) -> DataFrame:
    """Entries that carry a duration and a statement, as ``query_log`` rows."""
    field = lambda i: F.regexp_extract("text", fixed.ENTRY_FIELDS, i)
    fields = log_entries.select(
        "file", "block", "line",
        F.substring("text", 1, 23).alias("ts_text"),
        field(2).alias("zone"),
        field(5).alias("body"),
    ).filter(F.col("body") != "")
    found = fields.filter(F.col("body").rlike(fixed.DURATION_STATEMENT)).select(
        "file", "block", "line", "zone",
        log_timestamp(F.col("ts_text")).alias("ts"),
        F.regexp_extract("body", fixed.DURATION_STATEMENT, 1).try_cast("double").alias("ms"),
        strip(F.regexp_extract("body", fixed.DURATION_STATEMENT, 3)).alias("statement"),
    )
    kept = found.filter(
        F.col("ts").isNotNull() & F.col("ms").isNotNull() & (F.col("statement") != "")
    )
    rows = kept.select(
        "ts",
        zone_tagged(F.col("statement"), F.col("zone")).alias("query"),
        F.col("ms").alias("execution_time_ms"),
        F.lit(True).alias("success"),
        F.lit(source).alias("source"),
        F.struct(
            F.lit(source_ord).alias("source_ord"), "file", "block", "line"
        ).alias("seq"),
    )
    return schemas.conform(rows, schemas.QUERY_LOG)


def read_stderr_log(
    spark: SparkSession,
    path: str | list[str],
    source: str = fixed.SOURCE_POSTGRES,
    source_ord: int = 0,
    stage: bool = True,
) -> DataFrame:
    """Parse stderr-format server logs into ``query_log`` rows."""
    return parse_entries(entries(lines(spark, path), stage), source, source_ord)
