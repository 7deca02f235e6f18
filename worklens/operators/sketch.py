"""Mergeable quantile sketches: how many values fall into each slot of logarithmic width.

A sketch is a column, ``map<int, bigint>`` from slot to count. A slot spans values within a
factor of ``(1 + error) / (1 - error)``, and stands for the one value that none of them is
farther from than ``error`` of its size. Two sketches merge by adding counts, so hours add up
to days in any order, and a quantile of the union is within ``error`` of the value at the exact
rank, whatever the values look like. Values nearer to zero than ``SMALLEST`` count as zero.

The number of slots follows from the range of the values (about 350 for each factor of 1000 at
one percent), not from their number. Rows are counted per slot on the map side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative error, and the smallest size of a value that is told from zero.
ERROR, SMALLEST = 0.01, 1e-6
SKETCH = "map<int,bigint>"


def _width(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("error must be between 0 and 1")
    return math.log((1 + error) / (1 - error))


def slot(value: Column, error: float = ERROR) -> Column:
    """Number of a value's slot: order is kept, zero is 0, null stays null, NaN is the largest number."""
    size = F.ceil(F.log(F.abs(value) / F.lit(SMALLEST)) / F.lit(_width(error))).cast("int") + 1
    return (
        F.when(value.isNull(), F.lit(None).cast("int"))
        .when(F.isnan(value), F.lit(2**31 - 1))
        .when(F.abs(value) < SMALLEST, F.lit(0))
        .when(value < 0, -size)
        .otherwise(size)
    )


def slot_value(number: Column, error: float = ERROR) -> Column:
    """The value that a slot stands for."""
    width = _width(error)
    size = F.lit(2 * SMALLEST / (math.exp(width) + 1)) * F.exp(F.lit(width) * (F.abs(number) - 1))
    return F.when(number == 0, F.lit(0.0)).when(number == 2**31 - 1, F.lit(float("nan"))).when(number < 0, -size).otherwise(size)


def _gathered(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per (keys, slot) to a sketch per keys."""
    entries = F.array_sort(F.collect_list(F.struct("_slot", "_n")))
    return counts.groupBy(*keys).agg(F.map_from_entries(entries).alias("sketch"))


def sketches(rows: DataFrame, keys: list[str], value: str, error: float = ERROR) -> DataFrame:
    """One sketch per keys; null values are left out, and keys without others have no row."""
    cells = rows.select(*keys, slot(F.col(value), error).alias("_slot")).where("_slot is not null")
    return _gathered(cells.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n")), keys)


def merged(rows: DataFrame, keys: list[str], sketch: str = "sketch") -> DataFrame:
    """The sketches of all rows of the same keys as one."""
    cells = rows.select(*keys, F.explode(sketch).alias("_slot", "_n"))
    return _gathered(cells.groupBy(*keys, "_slot").agg(F.sum("_n").alias("_n")), keys)


def count(sketch: Column) -> Column:
    return F.aggregate(F.map_values(sketch), F.lit(0).cast("bigint"), lambda total, n: total + n)


def quantile(sketch: Column, q: float, error: float = ERROR) -> Column:
    """Value at 0-based ascending position ``int(n * q)``, within ``error``; null for an empty sketch."""
    if not 0 <= q <= 1:
        raise ValueError("q must be between 0 and 1")
    total = count(sketch)
    place = F.least(F.floor(total * F.lit(float(q))), total - 1)
    start = F.struct(F.lit(0).cast("bigint").alias("below"), F.lit(None).cast("int").alias("slot"), place.alias("place"))

    def step(state: Column, entry: Column) -> Column:
        here = state["below"] <= state["place"]
        return F.struct((state["below"] + entry["value"]).alias("below"), F.when(here, entry["key"]).otherwise(state["slot"]).alias("slot"), state["place"].alias("place"))

    found = F.aggregate(F.array_sort(F.map_entries(sketch)), start, step, lambda state: state["slot"])
    return slot_value(found, error)
