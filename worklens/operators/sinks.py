"""Writing the stored tables: appends, the snapshot upsert, retention and CSV export.

Tables are Parquet folders partitioned by day. Spark's file commit makes each write
appear as a whole, and a lost executor only repeats its own files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens import schemas
from worklens.functions.text import timestamp_text
from worklens.operators import counters
from worklens.session import staged
from worklens.sources.tables import read_table

SNAPSHOT_KEY = ["snapshot_timestamp", "query_fingerprint", "query_source"]
UPDATED_ON_CONFLICT = (
    "execution_count", "avg_execution_time_ms", "p95_latency_ms", "impact_score",
)


def append(
    df: DataFrame, path: str, name: str, partition: str | None = None, at: str | None = None
) -> None:
    """Append rows in their stored schema, in folders by the ``day`` or ``month`` of ``at``.

    Rows are rebalanced by folder first: small folders get one file instead of one per
    task, and a folder with very many rows is still written by several tasks.
    """
    rows = schemas.conform(df, schemas.TABLES[name])
    if partition is None:
        rows.write.mode("append").parquet(path)
        return
    unit = F.to_date(at) if partition == "day" else F.trunc(F.to_date(at), "month")
    placed = rows.withColumn(partition, unit).hint("rebalance", F.col(partition))
    placed.write.mode("append").partitionBy(partition).parquet(path)


def upserted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored snapshots merged with new ones.

    On the same (time, fingerprint, source) only four columns take the new value; a NULL
    source never matches. Of new rows with one key the one with the most executions counts,
    then the highest impact, then the other columns in order. The key has the fingerprint in
    it, so no key is hot.
    """
    columns = schemas.WORKLOAD_SNAPSHOT.names
    old = schemas.conform(stored, schemas.WORKLOAD_SNAPSHOT)
    others = [c for c in columns if c not in SNAPSHOT_KEY]
    fresh = _one_per_key(schemas.conform(new, schemas.WORKLOAD_SNAPSHOT), others)
    merged = old.select(*SNAPSHOT_KEY, F.struct(*others).alias("o")).join(
        fresh.select(*SNAPSHOT_KEY, F.struct(*others).alias("n")), SNAPSHOT_KEY, "full_outer"
    )
    both = F.col("o").isNotNull() & F.col("n").isNotNull()

    def pick(name: str) -> Column:
        if name in SNAPSHOT_KEY:
            return F.col(name)
        if name in UPDATED_ON_CONFLICT:
            chosen = F.when(F.col("n").isNotNull(), F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))
        else:
            chosen = F.when(
                F.col("n").isNotNull() & ~both, F.col(f"n.{name}")
            ).otherwise(F.col(f"o.{name}"))
        return chosen.alias(name)

    return merged.select(*[pick(c) for c in columns])


def _one_per_key(rows: DataFrame, others: list[str]) -> DataFrame:
    keyed = F.col("query_source").isNotNull()
    order = F.struct("execution_count", "impact_score", *others)
    best = rows.filter(keyed).groupBy(*SNAPSHOT_KEY).agg(F.max_by(F.struct(*others), order).alias("best"))
    return best.select(*SNAPSHOT_KEY, "best.*").select(*rows.columns).unionByName(rows.filter(~keyed))


def save_snapshots(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Upsert into the snapshot table. Only the day partitions of ``new`` are read and replaced."""
    conformed = schemas.conform(new, schemas.WORKLOAD_SNAPSHOT)
    # Read for its days and again for the merge.
    fresh = staged(conformed.withColumn("day", F.to_date("snapshot_timestamp")), "fresh-snapshots")
    stored = read_table(spark, path, "workload_snapshots")
    if "day" in stored.columns:
        # One row per day of the new snapshots: prunes the stored partitions at run time.
        stored = stored.join(fresh.select("day").distinct(), "day", "left_semi")
    merged = upserted(stored, fresh).withColumn("day", F.to_date("snapshot_timestamp"))
    merged = merged.hint("rebalance", F.col("day"))
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def save_capture(rows: DataFrame, captured_at: Column, path: str, **flags: bool) -> None:
    append(counters.as_capture(rows, captured_at, **flags), path, "stat_snapshots", "day", "captured_at")


def prune_captures(spark: SparkSession, path: str, before: Column | None) -> int:
    """Remove captures older than ``before``; returns the number of rows removed.

    Whole days before the bound are dropped as folders; only the day of the bound itself
    is rewritten.
    """
    if before is None:
        return 0
    history = read_table(spark, path, "stat_snapshots")
    if "day" not in history.columns:
        return 0
    bound = before.cast("timestamp_ntz")
    old = history.filter((F.col("day") <= F.to_date(bound)) & (F.col("captured_at") < bound))
    removed = old.count()
    if removed == 0:
        return 0
    edge = history.filter(F.col("day") == F.to_date(bound))
    kept = counters.retained(edge, bound)
    gone = old.select("day").distinct()
    if kept.isEmpty():
        doomed = gone
    else:
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "day"
        ).parquet(path)
        doomed = gone.filter(F.col("day") < F.to_date(bound))
    _drop_days(spark, path, [str(r["day"]) for r in doomed.collect()])
    return removed


def _drop_days(spark: SparkSession, path: str, days: list[str]) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for day in days:
        folder = hadoop(f"{path.rstrip('/')}/day={day}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with header, ISO timestamps and empty NULLs, in the row order given."""
    iso = {
        f.name: timestamp_text(F.col(f.name), "T")
        for f in rows.schema.fields
        if f.dataType == schemas.TS
    }
    options = {"header": True, "nullValue": "", "emptyValue": "", "escape": '"'}
    rows.withColumns(iso).write.mode("overwrite").options(**options).csv(path)


def save_result(results: DataFrame, path: str) -> None:
    append(results, path, "eval_results", "month", "eval_timestamp")


def save_recommendations(recommendations: DataFrame, path: str, json_path: str | None = None) -> None:
    """Append to the table; with ``json_path`` also one JSON line per recommendation."""
    append(recommendations, path, "recommendations", "month", "recommendation_timestamp")
    if json_path is not None:
        schemas.conform(recommendations, schemas.RECOMMENDATION).write.mode("append").json(json_path)


def save_events(events: DataFrame, path: str) -> None:
    """Append to the review ledger, the source of truth for proposal state."""
    append(events, path, "review_events", "month", "ts")
