"""Per-row retrieval-quality measures over id arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NO_IDS = "array<string>"


def _ids(column: Column) -> Column:
    return F.coalesce(column, F.array().cast(_NO_IDS))


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    """1 / position of the first retrieved id that is relevant, else 0.

    The intersection keeps the order of its first argument, so its first element is the
    first hit; the cost is linear in both lists.
    """
    got = _ids(retrieved)
    hits = F.array_intersect(got, _ids(relevant))
    first = F.try_element_at(hits, F.lit(1))
    position = F.when(first.isNotNull(), F.array_position(got, first)).otherwise(
        F.array_position(F.transform(got, lambda x: x.isNull()), F.lit(True))
    )
    return F.when(F.size(hits) > 0, F.lit(1.0) / position).otherwise(F.lit(0.0))


def precision_at_k(retrieved: Column, relevant: Column, k: int = 10) -> Column:
    """Distinct relevant ids in the first k, over the number retrieved (not over k)."""
    top = F.slice(_ids(retrieved), 1, k)
    hits = F.size(F.array_intersect(top, _ids(relevant)))
    return F.when(F.size(top) > 0, hits / F.size(top)).otherwise(F.lit(0.0))


def recall_at_k(retrieved: Column, relevant: Column, k: int = 10) -> Column:
    """Distinct relevant ids in the first k, over the relevant list; NULL when that is empty."""
    top = F.slice(_ids(retrieved), 1, k)
    hits = F.size(F.array_intersect(top, _ids(relevant)))
    return F.when(F.size(_ids(relevant)) > 0, hits / F.size(_ids(relevant)))
