"""What was kept, moved, added and removed between two arrays, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worklens.functions.text import let

_PAIRS = "array<struct<i:int,j:int>>"


def common_subsequence(old: Column, new: Column) -> Column:
    """Places ``struct<i, j>`` (from 0) of a longest common subsequence of two arrays.

    Of several longest ones it is that which takes each element of ``old`` as late in ``new``
    as the last step allows. Time and space grow with the product of the lengths, so this is
    for short arrays such as the clauses of a statement.
    """
    none = F.array().cast(_PAIRS)
    longer = lambda a, b: F.when(F.size(a) >= F.size(b), a).otherwise(b)
    columns = F.when(F.size(new) > 0, F.sequence(F.lit(0), F.size(new) - 1)).otherwise(F.array().cast("array<int>"))
    lines = F.when(F.size(old) > 0, F.sequence(F.lit(0), F.size(old) - 1)).otherwise(F.array().cast("array<int>"))

    def line(above: Column, i: Column) -> Column:
        """Best pairs of old[..i] with every beginning of new, from those of old[..i-1]."""

        def cell(row: Column, j: Column) -> Column:
            met = F.concat(F.get(above, j), F.array(F.struct(i.alias("i"), j.alias("j"))))
            best = F.when(F.get(old, i).eqNullSafe(F.get(new, j)), met).otherwise(longer(F.get(above, j + 1), F.get(row, j)))
            return F.concat(row, F.array(best))

        return F.aggregate(columns, F.array(none), cell)

    start = F.transform(F.sequence(F.lit(0), F.size(new)), lambda _: none)
    return F.aggregate(lines, start, line, lambda rows: F.element_at(rows, -1))


def _left_over(items: Column, taken: Column, at: str) -> Column:
    return F.filter(items, lambda _, k: ~F.exists(taken, lambda pair: pair[at] == k))


def _number(items: Column, item: Column) -> Column:
    return F.size(F.filter(items, lambda x: x.eqNullSafe(item)))


def _nth(items: Column) -> Column:
    """Each element with how many equal ones stand before it."""
    return F.transform(items, lambda x, k: F.struct(x.alias("x"), _number(F.slice(items, 1, k), x).alias("n")))


def _without(items: Column, others: Column) -> Column:
    """Elements that ``others`` has no counterpart for, counting repeats."""
    return F.transform(F.filter(_nth(items), lambda e: e["n"] >= _number(others, e["x"])), lambda e: e["x"])


def _within(items: Column, others: Column) -> Column:
    return F.transform(F.filter(_nth(items), lambda e: e["n"] < _number(others, e["x"])), lambda e: e["x"])


def changes(old: Column, new: Column) -> Column:
    """``struct<kept, moved, removed, added>`` between two arrays.

    Kept elements stand in the same order on both sides; moved ones are on both sides, but in
    another order; the rest was removed or added. Repeats are told apart by their number.
    """

    def told(pairs: Column) -> Column:
        rests = F.struct(_left_over(old, pairs, "i").alias("old"), _left_over(new, pairs, "j").alias("new"))
        return let(
            rests,
            lambda rest: F.struct(
                F.transform(pairs, lambda pair: F.get(old, pair["i"])).alias("kept"),
                _within(rest["old"], rest["new"]).alias("moved"),
                _without(rest["old"], rest["new"]).alias("removed"),
                _without(rest["new"], rest["old"]).alias("added"),
            ),
        )

    return let(common_subsequence(old, new), told)
