"""Incremental reading of JSON logs: each run takes only the files that are new.

Rows and rejects are those of the batch reader. The file source keeps what it has read in
its checkpoint, and each micro-batch replaces its own folder of every table, so a batch that
is repeated after a failure adds nothing twice.

With ``late``, event time has a watermark: the newest timestamp of earlier micro-batches less
``delay``. A line without a readable time has no event time then, and is refused. A row whose hour had ended by then is late; it is not stored with the others, but
counted by hour and fingerprint in a table of its own. A micro-batch moves the watermark for
later ones only, so the order of the files within it plays no part.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from worklens import fixed
from worklens.operators.workload import with_fingerprint
from worklens.session import staged
from worklens.sources.json_log import REJECT, accepted, parse_json_rows
from worklens.sources.json_log import rejects as rejected


def _folder(table: str, batch_id: int) -> str:
    return f"{table.rstrip('/')}/batch={batch_id}"


def hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts.cast("timestamp")).cast("timestamp_ntz")


def watermark(spark: SparkSession, marks: str, batch_id: int, delay: str) -> Column:
    """Newest event time of the batches before this one, less the delay; null at first."""
    try:
        newest = spark.read.parquet(marks).where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
    except AnalysisException:  # no batch has been stored yet
        newest = None
    return F.lit(newest).cast("timestamp_ntz") - F.expr(f"interval {delay}")


def append_new_entries(
    spark: SparkSession,
    path: str,
    table: str,
    checkpoint: str,
    now: Column,
    source: str = fixed.SOURCE_APPLICATION,
    rejects: str | None = None,
    late: str | None = None,
    delay: str = "1 hour",
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Append the entries of new log files, with fingerprints, to a query-log table.

    Refused lines are appended to ``rejects``, counts of late rows to ``late``, where given.
    """
    marks = f"{late.rstrip('/')}-marks" if late else None

    def store(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("line", F.monotonically_increasing_id())
        # Written once: lines are parsed once for all tables. Of the lines themselves only the refused ones are read again.
        told = parse_json_rows(numbered, now, source, on_bad_ts="reject" if late else "now")
        parsed = staged(told.withColumn("raw", F.when(F.col(REJECT).isNotNull(), F.col("raw"))), "stream-batch")
        rows = with_fingerprint(accepted(parsed))
        if late:
            closed = hour(F.col("ts")) + F.expr("interval 1 hour") <= watermark(spark, marks, batch_id, delay)
            behind = rows.where(closed).groupBy(hour(F.col("ts")).alias("hour"), "query_fingerprint").agg(F.count(F.lit(1)).alias("late_rows"))
            behind.write.mode("overwrite").parquet(_folder(late, batch_id))
            rows.agg(F.max("ts").alias("newest")).write.mode("overwrite").parquet(_folder(marks, batch_id))
            rows = rows.where(~F.coalesce(closed, F.lit(False)))
        if rejects:
            rejected(parsed).write.mode("overwrite").parquet(_folder(rejects, batch_id))
        rows.write.mode("overwrite").parquet(_folder(table, batch_id))

    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )
    return (
        lines.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
