"""Uniqueness of new rows against a long history: a Bloom filter per stored day.

A filter says of a key that it is surely not in its day, or that it may be. New keys are tested
against the filters of all days, and only the days that may hold one of them are read. No key
is missed, so the violations are those of a count over the whole history, provided that the
history itself is unique; a day that is read in vain costs time only.

A filter is a set of rows ``(day, chunk, bitmap)``, each of 32,768 bits, so days are added by
appending rows and a filter of any size is tested piece by piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, and how many of them a key sets: one false answer in about 40,000 for 50,000 keys a day.
BITS, PROBES = 1 << 20, 5
CHUNK = 1 << 15


def _positions(keys: list[str], bits: int, probes: int) -> Column:
    one, other = F.xxhash64(*keys), F.xxhash64(F.lit(7), *keys)
    places = F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda i: F.pmod(F.shiftright(one, 1) + i * F.shiftrightunsigned(other, 24), F.lit(bits)))
    return F.array_distinct(places)


def day_filters(rows: DataFrame, day: str, keys: list[str], bits: int = BITS, probes: int = PROBES) -> DataFrame:
    """Filters ``(day, chunk, bitmap)`` over the keys of each day; keys with a NULL take no part."""
    if bits % CHUNK or bits <= 0:
        raise ValueError(f"bits must be a multiple of {CHUNK}")
    at = rows.dropna(subset=keys).select(F.col(day).alias("day"), F.explode(_positions(keys, bits, probes)).alias("at"))
    placed = at.select("day", F.floor(F.col("at") / CHUNK).cast("int").alias("chunk"), F.pmod("at", F.lit(CHUNK)).alias("bit"))
    return placed.groupBy("day", "chunk").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def _is_set(bitmap: Column, bit: Column) -> Column:
    octet = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(octet / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1


def days_that_may_hold(new: DataFrame, filters: DataFrame, keys: list[str], bits: int = BITS, probes: int = PROBES) -> DataFrame:
    """The days of which the filter does not rule out every new key."""
    places = new.dropna(subset=keys).select(*keys).distinct().select(F.xxhash64(*keys).alias("one"), F.xxhash64(F.lit(7), *keys).alias("other"), _positions(keys, bits, probes).alias("all"))
    probed = places.select("one", "other", F.size("all").alias("number"), F.explode("all").alias("at"))
    # Bits to look at, per chunk: at most as many as the chunk has.
    wanted = probed.groupBy(F.floor(F.col("at") / CHUNK).cast("int").alias("chunk")).agg(F.collect_set(F.pmod("at", F.lit(CHUNK))).alias("bits"))
    met = filters.join(wanted, "chunk").select("day", "chunk", F.explode(F.filter("bits", lambda b: _is_set(F.col("bitmap"), b))).alias("bit"))
    found = met.select("day", (F.col("chunk").cast("long") * CHUNK + F.col("bit")).alias("at")).join(probed, "at")
    whole = found.groupBy("day", "one", "other", "number").agg(F.count(F.lit(1)).alias("n")).where("n = number")
    return whole.select("day").distinct()


def new_violations(new: DataFrame, stored: DataFrame, filters: DataFrame, day: str, keys: list[str], bits: int = BITS, probes: int = PROBES) -> tuple[DataFrame, list]:
    """Keys of ``new`` that occur more than once in it and the history together, and the days that were read."""
    days = [r["day"] for r in days_that_may_hold(new, filters, keys, bits, probes).collect()]  # bounded by the days stored
    near = stored.where(F.col(day).isin(days)) if days else stored.limit(0)
    fresh = new.dropna(subset=keys).select(*keys, F.lit(1).alias("fresh"))
    both = fresh.unionByName(near.dropna(subset=keys).select(*keys, F.lit(0).alias("fresh")))
    counted = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.max("fresh").alias("fresh"))
    return counted.where("copies > 1 and fresh = 1").drop("fresh"), sorted(days)
