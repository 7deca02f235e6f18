"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from worklens.session import scratch_path

#: Spark's own switch for dropping the shuffle files of an execution once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(frame: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet and read again: lineage ends here, and a lost executor loses nothing.

    What was shuffled on the way is not needed again, so its files go with the execution.
    """
    spark = frame.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)
