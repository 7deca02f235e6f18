"""Quantile sketches against exact ranks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from worklens.operators import sketch

QS = (0.0, 0.01, 0.5, 0.95, 0.99, 1.0)


def values(kind, rng, n):
    if kind == "skewed":
        return [math.exp(rng.gauss(0, 4)) for _ in range(n)]
    if kind == "tied":
        return [rng.choice([0.0, 5.0, 5.0, 5.0, 1e6]) for _ in range(n)]
    if kind == "signed":
        return [rng.gauss(0, 1) * 10 ** rng.randint(-9, 9) for _ in range(n)]
    return [rng.random() + 1 for _ in range(n)]


def exact(xs, q):
    return sorted(xs)[min(int(len(xs) * q), len(xs) - 1)]


@pytest.mark.parametrize("kind", ["skewed", "tied", "signed", "flat"])
@pytest.mark.parametrize("error", [0.02])
def test_any_union_is_within_the_error(spark, kind, error):
    rng = random.Random(kind)
    rows = [(h, x) for h in range(6) for x in values(kind, rng, rng.choice([1, 7, 300]))]
    frame = spark.createDataFrame(rows, "h int, x double").repartition(4)
    parts = sketch.sketches(frame, ["h"], "x", error)
    for hours in ([1], [0, 3, 5], list(range(6))):
        one = sketch.merged(parts.where(F.col("h").isin(hours)).withColumn("all", F.lit(1)), ["all"])
        got = one.select(sketch.count(F.col("sketch")), *[sketch.quantile(F.col("sketch"), q, error) for q in QS]).first()
        xs = [x for h, x in rows if h in hours]
        assert got[0] == len(xs)
        for q, found in zip(QS, got[1:], strict=True):
            want = exact(xs, q)
            assert abs(found - want) <= error * abs(want) * (1 + 1e-9) + sketch.SMALLEST
        # Merging is the sketch of the union.
        whole = sketch.sketches(frame.where(F.col("h").isin(hours)).withColumn("all", F.lit(1)), ["all"], "x", error)
        assert one.first()["sketch"] == whole.first()["sketch"]


def test_nulls_empty_and_bounds(spark):
    frame = spark.createDataFrame([(1, None), (2, 3.0), (2, None), (3, float("nan")), (3, 1.0)], "k int, x double")
    got = {r["k"]: r["q"] for r in sketch.sketches(frame, ["k"], "x").select("k", sketch.quantile(F.col("sketch"), 0.5).alias("q")).collect()}
    assert set(got) == {2, 3} and got[2] == pytest.approx(3.0, rel=0.01) and math.isnan(got[3])
    empty = spark.range(1).select(F.expr("cast(map() as map<int,bigint>)").alias("s"))
    assert empty.select(sketch.quantile(F.col("s"), 0.5)).first()[0] is None
    with pytest.raises(ValueError):
        sketch.quantile(F.col("s"), 1.5)
    with pytest.raises(ValueError):
        sketch.slot(F.col("s"), 0)
