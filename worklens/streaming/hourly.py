"""Hourly workload of a log that arrives file by file: event-time windows in streaming state.

``cells`` is one declaration for batch and stream: rows are counted per hour, fingerprint and
slot of a quantile sketch. As a stream, the state holds the cells of open hours, the watermark
closes an hour once the newest row is ``delay`` past its end, and its cells are appended once,
each micro-batch to a folder of its own. ``hours`` adds cells up to one row per hour and
fingerprint with a sketch column, from which percentiles of any union of hours follow
(worklens.operators.sketch). Sums are decimals, so they do not depend on the order of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from worklens import schemas
from worklens.operators import sketch

LOG = T.StructType([*schemas.QUERY_LOG.fields, T.StructField("query_fingerprint", T.StringType())])
MONEY = "decimal(28,6)"


def cells(rows: DataFrame, error: float = sketch.ERROR) -> DataFrame:
    """``hour, query_fingerprint, slot, executions, total_ms, min_ms, max_ms, errors``; ``at`` is the event time."""
    ms = F.col("execution_time_ms")
    grouped = rows.groupBy(F.window("at", "1 hour").alias("hour"), "query_fingerprint", sketch.slot(ms, error).alias("slot"))
    summed = grouped.agg(
        F.count(F.lit(1)).alias("executions"),
        F.sum(ms.cast("decimal(18,6)")).alias("total_ms"),
        F.min(ms).alias("min_ms"),
        F.max(ms).alias("max_ms"),
        F.count_if(~F.col("success")).alias("errors"),
    )
    return summed.select(F.col("hour.start").cast("timestamp_ntz").alias("hour"), *summed.columns[1:])


def with_event_time(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def hours(cell_rows: DataFrame) -> DataFrame:
    """One row per hour and fingerprint, with the sketch of its execution times."""
    keys = ["hour", "query_fingerprint"]
    counted = cell_rows.groupBy(*keys, "slot").agg(*_sums())
    entries = F.array_sort(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "executions"))))
    return counted.groupBy(*keys).agg(*_sums(), F.map_from_entries(entries).alias("sketch"))


def _sums() -> list:
    return [
        F.sum("executions").alias("executions"),
        F.sum("total_ms").cast(MONEY).alias("total_ms"),
        F.min("min_ms").alias("min_ms"),
        F.max("max_ms").alias("max_ms"),
        F.sum("errors").alias("errors"),
    ]


def append_closed_hours(
    spark: SparkSession, table: str, out: str, checkpoint: str, delay: str = "1 hour", error: float = sketch.ERROR
) -> StreamingQuery:
    """Read what is new in a query-log table and append the cells of hours that the watermark closes."""
    # The folders of micro-batches are read as files, without their number as a column.
    log = spark.readStream.schema(LOG).parquet(f"{table.rstrip('/')}/batch=*")
    closed = cells(with_event_time(log).withWatermark("at", delay), error)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    return (
        closed.writeStream.foreachBatch(store)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
