"""Approximate nearest neighbours by query-aware collision counting.

Every vector is projected on ``PROJECTIONS`` random directions. A task holds its vectors in
shards of at most ``SHARD`` rows and sorts each projection of a shard. For a query, each
sorted array has a window centred at the query's own projection; the radius grows
geometrically (virtual rehashing), and only the two new margins of each window are read.
A vector that lies in the windows of at least ``THRESHOLD`` of the projections is verified:
its Euclidean distance is computed in double precision on the original components. The
search of a shard ends when the k-th distance found so far lies within the radius, at
which point a vector at most that near has reached the threshold with a probability of
about 0.98, or when every vector of the shard has been verified.

Queries are a stated set. They are sent to the tasks in blocks of at most ``QUERY_BLOCK``
and every block is run against all vectors; a task keeps k rows per query. Blocks follow
each other, so the driver never holds more than one.

Vectors that are null, empty, zero or hold a null or non-finite component take no part;
vectors of different lengths are never compared. Query ids are taken once, a query's
own id is never its neighbour, other repeated rows count as rows of their own. Ties go to
the smaller id. Rows without id take no part.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worklens.llm.staging import staged

#: Projections, half width of a window at radius 1, growth of the radius.
PROJECTIONS, HALF_WIDTH, GROWTH = 32, 1.36, 1.2
#: Share of projections whose windows must hold a vector before it is verified.
THRESHOLD = 0.73
#: Radii whose windows are looked up at a time.
LEVELS = 8
#: First radius, as a share of the median distance in the shard.
FIRST = 0.5
#: Rows of a shard, queries of a block.
SHARD, QUERY_BLOCK = 1 << 14, 1 << 12


def usable(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """vec_id and components as doubles of the vectors that take part."""
    value = F.col(name).cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", value.alias("vector")).where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0))


class Shard:
    """Sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        projected = np.ascontiguousarray((vectors @ directions).T)
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, axis=1)
        some = vectors[:: max(1, len(vectors) // 128)]
        apart = np.sqrt(((some[:, None] - some[None]) ** 2).sum(-1))
        self.scale = float(np.median(apart[apart > 0])) if (apart > 0).any() else 1.0

    def search(self, own: int, query: np.ndarray, centre: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (distances, ids) of ``best`` and this shard."""
        m, n = self.sorted.shape
        wanted = int(np.ceil(THRESHOLD * m))
        counts = np.zeros(n, np.int64)
        seen = self.ids == own
        left = right = None
        level, bounds = 0, self._windows(centre, 0)
        while True:
            if level and level % LEVELS == 0:
                bounds = self._windows(centre, level)
            lo, hi = bounds[0][:, level % LEVELS], bounds[1][:, level % LEVELS]
            if left is None:
                pieces = [self.order[j, lo[j] : hi[j]] for j in range(m)]
            else:
                pieces = [self.order[j, lo[j] : left[j]] for j in range(m)] + [self.order[j, right[j] : hi[j]] for j in range(m)]
            left, right = lo, hi
            counts += np.bincount(np.concatenate(pieces), minlength=n)
            fresh = np.flatnonzero((counts >= wanted) & ~seen)
            if len(fresh):
                seen[fresh] = True
                distance = np.sqrt(((self.vectors[fresh] - query) ** 2).sum(axis=1))
                best = _best(np.concatenate([best[0], distance]), np.concatenate([best[1], self.ids[fresh]]), k)
            if seen.all() or len(best[0]) == k and best[0][-1] <= self._radius(level):
                return best
            level += 1

    def _radius(self, level: int | np.ndarray):
        return FIRST * self.scale * GROWTH**level

    def _windows(self, centre: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds in each sorted array of the windows of ``LEVELS`` radii from ``level`` on."""
        half = HALF_WIDTH * self._radius(level + np.arange(LEVELS))
        lo = [np.searchsorted(self.sorted[j], centre[j] - half, "left") for j in range(len(centre))]
        hi = [np.searchsorted(self.sorted[j], centre[j] + half, "right") for j in range(len(centre))]
        return np.array(lo), np.array(hi)


def _best(distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, distance))[:k]
    return distance[order], ids[order]


def directions(width: int, projections: int = PROJECTIONS, seed: int = 7) -> np.ndarray:
    """Random directions: orthogonal sets, scaled so that a projected difference has the variance of a Gaussian one."""
    rng = np.random.default_rng((seed, width))
    parts = []
    while sum(p.shape[1] for p in parts) < projections:
        q, _ = np.linalg.qr(rng.standard_normal((width, width)))
        parts.append(q * np.sqrt(width))
    return np.concatenate(parts, axis=1)[:, :projections]


def _searched(block, k: int):
    """A map over batches of (vec_id, vector): k rows per query of the block and task."""

    def run(batches):
        queries = block.value
        best = {own: (np.zeros(0), np.zeros(0, np.int64)) for own, _ in queries}
        by_width: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for own, vector in queries:
            by_width[len(vector)].append((own, vector))
        held: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)

        def search(width: int) -> None:
            rows = held.pop(width)
            lines = directions(width)
            shard = Shard(np.array([r[0] for r in rows], np.int64), np.stack([r[1] for r in rows]), lines)
            for own, vector in by_width[width]:
                best[own] = shard.search(own, vector, vector @ lines, best[own], k)

        for batch in batches:
            lists = batch.column(1)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, vec in enumerate(batch.column(0).to_pylist()):
                vector = values[offsets[i] : offsets[i + 1]]
                if len(vector) in by_width:
                    held[len(vector)].append((vec, vector.copy()))
                    if len(held[len(vector)]) == SHARD:
                        search(len(vector))
        for width in list(held):
            search(width)
        for own, (distance, ids) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), own, np.int64)), pa.array(ids), pa.array(distance)], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of ``queries`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    asked = staged(usable(queries).dropDuplicates(["vec_id"]), "queries")
    blocks = max(1, -(-asked.count() // block))
    parts = []
    for number in range(blocks):
        # Bounded: about QUERY_BLOCK vectors, whatever the table.
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).collect()
        shared = spark.sparkContext.broadcast([(r[0], np.array(r[1], float)) for r in part])
        found = rows.mapInArrow(_searched(shared, k), "query_id long, vec_id long, score double")
        parts.append(found if blocks == 1 else staged(found, "found"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
