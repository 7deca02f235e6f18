"""Snapshots of many overlapping windows from panes: each row is read once.

A pane is a stretch of time that every window holds wholly or not at all. Rows are reduced to
one partial aggregate per pane and fingerprint, and to counts of equal execution times. A
window adds up the panes it covers, so a day that slides by the hour costs 24 partial rows per
fingerprint, not 24 times its rows.

Percentiles stay exact, since they are ranks over counts, in two steps. Windows add up counts
per slot of times, a bounded number for each pane, and find the slots that hold the wanted
ranks. Only the times in those slots are then dealt to the windows that want them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.operators.ranks import slot
from worklens.operators.workload import COLUMNS, QUANTILES, RESOURCES, impact_score, with_fingerprint

KEYS = ["window_start", "window_end"]
#: Finer slots are more rows in the first step and fewer in the second.
SLOTS_PER_OCTAVE = 8


def _covering(pane: Column, minutes: int, panes: int) -> Column:
    """Ends of the windows that cover a pane, by its start."""
    step = F.make_dt_interval(mins=F.lit(minutes))
    return F.transform(F.sequence(F.lit(1), F.lit(panes)), lambda i: pane + step * i)


def _window_ranks(counts: DataFrame, minutes: int, panes: int, min_rows: int) -> DataFrame:
    """Percentiles per window and fingerprint, from counts ``n`` per pane, fingerprint and time."""
    value = F.col("execution_time_ms")
    cells = counts.withColumn("_slot", slot(value, SLOTS_PER_OCTAVE))
    group = Window.partitionBy("window_end", "_fp")
    upto = group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    index = {name: F.floor(F.col("_total") * F.lit(float(q))) for name, q in QUANTILES.items()}
    wanted = F.lit(False)
    for place in index.values():
        wanted = wanted | ((place >= F.col("_below")) & (place < F.col("_below") + F.col("_size")))
    slots = (
        cells.groupBy("pane", "_fp", "_slot").agg(F.sum("n").alias("n"))
        .withColumn("window_end", F.explode(_covering(F.col("pane"), minutes, panes)))
        .groupBy("window_end", "_fp", "_slot").agg(F.sum("n").alias("_size"))
        .withColumn("_below", F.sum("_size").over(upto) - F.col("_size"))
        .withColumn("_total", F.sum("_size").over(group))
        .filter((F.col("_total") >= min_rows) & wanted)
        .withColumn("pane", F.explode(_covering(F.col("window_end"), -minutes, panes)))
        .drop("_size")
    )
    # A time that several panes have comes in several rows, which the running count allows.
    inside = Window.partitionBy("window_end", "_fp", "_slot").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cells.join(slots, ["pane", "_fp", "_slot"]).withColumn("_last", F.col("_below") + F.sum("n").over(inside))
    found = [F.min(F.when(F.col("_last") > place, value)).alias(name) for name, place in index.items()]
    return placed.groupBy("window_end", "_fp").agg(*found)


def sliding_snapshots(log: DataFrame, pane_minutes: int = 60, panes: int = 24, min_query_count: int = 5, **flags: bool) -> DataFrame:
    """Snapshots of all windows of ``panes`` panes, one ending with each pane, stamped with their end.

    Panes start at multiples of ``pane_minutes`` since the epoch. A window holds its start but
    not its end. Windows without a fingerprint's rows, or with too few, have no row for it.
    """
    if pane_minutes < 1 or panes < 1:
        raise ValueError("pane_minutes and panes must be at least 1")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    start = F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(60 * pane_minutes))).cast("timestamp_ntz")
    digest = F.coalesce(F.unhex(F.sha2("query_fingerprint", 256)), F.lit(b""))
    rows = with_fingerprint(log, **flags).withColumns({"pane": start, "_fp": digest})
    ms = F.col("execution_time_ms")
    first = F.struct("query_type", F.col("source").alias("query_source"), F.col("query").alias("example_query"))
    partial = rows.groupBy("pane", "_fp", "query_fingerprint").agg(
        F.min_by(first, "seq").alias("first"), F.min("seq").alias("seq"),
        F.count(F.lit(1)).alias("n"), F.sum(ms).alias("total"), F.count(ms).alias("timed"),
        F.max(ms).alias("most"), F.min(ms).alias("least"), F.count_if(~F.col("success")).alias("errors"),
        *[F.sum(c).alias(f"sum_{c}") for c in RESOURCES], *[F.count(c).alias(f"n_{c}") for c in RESOURCES],
    )
    length = F.make_dt_interval(mins=F.lit(pane_minutes * panes))
    ends = F.explode(_covering(F.col("pane"), pane_minutes, panes))
    spread = partial.withColumn("window_end", ends).withColumn("window_start", F.col("window_end") - length)
    totals = (
        spread.groupBy(*KEYS, "_fp", "query_fingerprint")
        .agg(
            F.min_by("first", "seq").alias("first"),
            F.sum("n").alias("execution_count"),
            F.sum("total").alias("total_execution_time_ms"),
            (F.sum("total") / F.sum("timed")).alias("avg_execution_time_ms"),
            F.max("most").alias("max_latency_ms"),
            F.min("least").alias("min_latency_ms"),
            *[(F.sum(f"sum_{c}") / F.nullif(F.sum(f"n_{c}"), F.lit(0))).alias(f"avg_{c}") for c in RESOURCES],
            F.sum("errors").alias("error_count"),
        )
        .filter(F.col("execution_count") >= min_query_count)
    )
    # Keys that are never null, so that both readers of the counts share one shuffle (worklens.operators.ranks).
    known = rows.filter(ms.isNotNull() & F.col("ts").isNotNull()).withColumn("pane", F.coalesce("pane", F.lit("1970-01-01").cast("timestamp_ntz")))
    counts = known.groupBy("pane", "_fp", "execution_time_ms").agg(F.count(F.lit(1)).alias("n"))
    ranks = _window_ranks(counts, pane_minutes, panes, min_query_count)
    return (
        totals.join(ranks, ["window_end", "_fp"])
        .withColumns(
            {
                "error_rate": F.col("error_count") / F.col("execution_count"),
                "impact_score": impact_score(F.col("execution_count"), F.col("avg_execution_time_ms")),
                "snapshot_timestamp": F.col("window_end"),
            }
        )
        .select("*", "first.*")
        .select(*COLUMNS)
    )
