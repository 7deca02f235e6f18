"""Sliding windows from panes against one profile per window."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from worklens.operators import panes, workload
from worklens.operators.workload import COLUMNS

SF = "/root/testdata/sf0.001"


def test_windows_equal_single_profiles(spark):
    from worklens.plans.queries import query_log

    log = query_log(spark, SF).where("ts < timestamp'2024-01-04'")
    got = panes.sliding_snapshots(log, 60, 24, 1).drop("snapshot_timestamp")
    ends = [datetime(2024, 1, 1, 5), datetime(2024, 1, 2), datetime(2024, 1, 3, 13), datetime(2024, 1, 4, 20)]
    names = [c for c in COLUMNS if c not in ("snapshot_timestamp", "window_start", "window_end")]
    for end in ends:
        inside = workload.with_fingerprint(log.where((F.col("ts") >= F.lit(end - timedelta(hours=24)).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz"))))
        want = {r["query_fingerprint"]: r for r in workload._snapshot_rows(inside, [], 1).select(*names).collect()}
        rows = {r["query_fingerprint"]: r for r in got.where(F.col("window_end") == F.lit(end).cast("timestamp_ntz")).collect()}
        assert want and set(rows) == set(want)
        for key, row in rows.items():
            assert row["window_start"] == end - timedelta(hours=24)
            for name in names:
                assert row[name] == (pytest.approx(want[key][name]) if isinstance(want[key][name], float) else want[key][name]), name


def test_log_is_read_twice_whatever_the_number_of_windows(spark):
    from worklens.plans.queries import query_log

    def scans(count):
        plan = panes.sliding_snapshots(query_log(spark, SF), 60, count, 1)._jdf.queryExecution().executedPlan().toString()
        return plan.count("Scan parquet")

    assert scans(2) == scans(200) <= 3
    with pytest.raises(ValueError):
        panes.sliding_snapshots(query_log(spark, SF), 60, 0)


def test_times_are_dealt_only_to_the_windows_that_want_them(spark):
    """Every window of 24 panes used to get a copy of every time."""
    rows = [(datetime(2024, 1, 1 + i // 600, i // 25 % 24, i % 60), f"s{i % 2}", 1.0 + (i * 7919 % 3001) ** 1.5) for i in range(1800)]
    log = spark.createDataFrame(rows, "at timestamp_ntz, fp string, ms double")
    counts = log.select(F.date_trunc("hour", F.col("at").cast("timestamp")).cast("timestamp_ntz").alias("pane"), F.encode("fp", "utf-8").alias("_fp"), F.col("ms").alias("execution_time_ms")).groupBy("pane", "_fp", "execution_time_ms").agg(F.count(F.lit(1)).alias("n"))
    got = {(r["window_end"], bytes(r["_fp"]).decode()): tuple(r[n] for n in panes.QUANTILES) for r in panes._window_ranks(counts, 60, 24, 1).collect()}
    want = {}
    for at, fp, ms in rows:
        hour = at.replace(minute=0)
        for k in range(1, 25):
            want.setdefault((hour + timedelta(hours=k), fp), []).append(ms)
    assert set(got) == set(want)
    for key, values in want.items():
        values.sort()
        assert got[key] == tuple(values[int(len(values) * q)] for q in panes.QUANTILES.values())
