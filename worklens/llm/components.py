"""Connected components of a link table, as joins and aggregates.

Alternating star contraction: a large-star step ties every larger neighbour of a node to
the smallest node it sees, a small-star step does the same for the smaller neighbours.
The number of rounds grows with the logarithm of the longest chain. Each step is
written to the shared folder, and minima are written before they are joined, so that both
sides of the join come from a shuffle that adaptive execution can split when one node has
very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.staging import staged


def _with_smallest(pairs: DataFrame) -> DataFrame:
    """Each pair (a, b) with the smallest b of its a."""
    smallest = staged(pairs.groupBy("a").agg(F.min("b").alias("m")), "smallest")
    return pairs.join(smallest, "a")


def _large_star(links: DataFrame) -> DataFrame:
    both = staged(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    tied = _with_smallest(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    return staged(tied.distinct(), "large-star")


def _small_star(links: DataFrame) -> DataFrame:
    tied = _with_smallest(links).select("a", "b", "m")
    out = tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return staged(out.unionByName(tied.select("a", F.col("m").alias("b"))).distinct(), "small-star")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that is not the smallest of its component."""
    links = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(links)
    while state[0]:
        links = _small_star(_large_star(links))
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
