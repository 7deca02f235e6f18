"""Uniqueness through day filters against a count over the whole history."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from worklens.operators import dayfilters, listings

START = date(2024, 1, 1)


def test_violations_equal_the_whole_count_and_few_days_are_read(spark):
    rows = [(START + timedelta(days=d), f"q{i}", "s") for d in range(20) for i in range(d * 30, d * 30 + 30)]
    stored = spark.createDataFrame(rows, "day date, fp string, source string")
    filters = dayfilters.day_filters(stored, "day", ["fp", "source"])
    fresh = [(START + timedelta(days=30), k, s) for k, s in [("q5", "s"), ("q95", "s"), ("q95", "other"), ("n1", "s"), ("n1", "s"), ("n2", "s"), (None, "s"), (None, "s")]]
    new = spark.createDataFrame(fresh, "day date, fp string, source string")
    got, days = dayfilters.new_violations(new, stored, filters, "day", ["fp", "source"])
    want = listings.unique_key_violations(stored.unionByName(new), ["fp", "source"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("fp", "source", "copies").collect())) != []
    assert days == [START, START + timedelta(days=3)]


def test_full_filters_and_nothing_new(spark):
    stored = spark.createDataFrame([(START + timedelta(days=d), d * 40_000 + i) for d in range(2) for i in range(40_000)], "day date, k int")
    filters = dayfilters.day_filters(stored, "day", ["k"], 1 << 15, 2)
    new = spark.createDataFrame([(START, k) for k in (7, 50_000, 90_000)], "day date, k int")
    got, days = dayfilters.new_violations(new, stored, filters, "day", ["k"], 1 << 15, 2)
    assert sorted(map(tuple, got.collect())) == [(7, 2), (50_000, 2)] and len(days) == 2
    none, days = dayfilters.new_violations(new.limit(0), stored, filters, "day", ["k"], 1 << 15, 2)
    assert none.collect() == [] and days == []
    with pytest.raises(ValueError):
        dayfilters.day_filters(stored, "day", ["k"], 1000)
    assert dayfilters.day_filters(stored.where(F.lit(False)), "day", ["k"]).isEmpty()
