"""Exact nearest-rank values per group, without putting a group into one task.

A group can hold a third of all rows, so its values are never sorted as a whole:

1. rows are counted per (group, value) - combined on the map side, spread over all tasks;
2. values fall into slots of a fixed relative width; cumulated slot counts (a bounded
   number of slots per group) tell which slot holds each wanted rank;
3. only the values of those slots are sorted, slot by slot.

Slots only need to keep the order of values, which the logarithm does, so the result is
exact whatever the slot width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS_PER_OCTAVE = 1024
_SMALLEST = 1e-6


def slot(value: Column, per_octave: int = SLOTS_PER_OCTAVE) -> Column:
    size = F.floor(F.log2(F.abs(value) / F.lit(_SMALLEST) + 1) * per_octave)
    # Never NULL, so that the join on slots adds no filter to one of its sides and both
    # sides can read the same shuffle of the cells.
    return F.coalesce(F.when(value < 0, -size).otherwise(size), F.lit(0))


def nearest_ranks(
    rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], min_rows: int = 1,
    weight: str | None = None,
) -> DataFrame:
    """Per group, the value at 0-based ascending position ``int(n * q)`` for each quantile.

    With ``weight`` a row stands for that many equal values.

    Groups with fewer than ``min_rows`` rows are left out. Keys that are computed should
    not be nullable: the joins would test them for NULL, and that test is pushed to the
    scan, where it computes the key a second time.
    """
    cells = (
        rows.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
        .withColumn("_slot", slot(F.col(value)))
    )
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    index = {name: F.floor(F.col("_total") * F.lit(float(q))) for name, q in quantiles.items()}
    in_slot = None
    for position in index.values():
        hit = (position >= F.col("_below")) & (position < F.col("_below") + F.col("_size"))
        in_slot = hit if in_slot is None else in_slot | hit
    slots = (
        cells.groupBy(*keys, "_slot")
        .agg(F.sum("_n").alias("_size"))
        .withColumn("_below", F.sum("_size").over(upto) - F.col("_size"))
        .withColumn("_total", F.sum("_size").over(group))
        .filter((F.col("_total") >= min_rows) & in_slot)
        .select(*keys, "_slot", "_below", "_total")
    )
    inside = Window.partitionBy(*keys, "_slot").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = cells.join(slots, [*keys, "_slot"]).withColumn(
        "_last", F.col("_below") + F.sum("_n").over(inside)
    )
    return placed.groupBy(*keys).agg(
        *[
            F.min(F.when(F.col("_last") > position, F.col(value))).alias(name)
            for name, position in index.items()
        ]
    )
