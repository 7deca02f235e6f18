"""Statement counters: pooling, changes between captures, storage, retention and export."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from worklens import schemas
from worklens.operators import counters, sinks
from worklens.plans import pipelines
from worklens.sources import statements
from worklens.sources.tables import read_table

NOON = datetime(2025, 3, 14, 12)
AT_NOON = F.lit(NOON)

SCAN = "SELECT name FROM depots WHERE region = $1"
TOUCH = "UPDATE depots SET seen = $1 WHERE depot = $2"


def stats(spark, *entries):
    """Statement rows from (id, text, calls, mean), each with any other counters by name."""
    rows = []
    for ident, text, calls, mean, *more in entries:
        extra = more[0] if more else {}
        known = {"queryid": ident, "dbid": 1, "userid": 3, "query": text, "calls": calls, "rows": 0,
                 "shared_blks_hit": 0, "shared_blks_read": 0, "total_exec_time_ms": calls * float(mean),
                 "mean_exec_time_ms": float(mean), "stddev_exec_time_ms": 0.0, "min_exec_time_ms": float(mean),
                 "max_exec_time_ms": float(mean)} | extra
        rows.append([known[name] for name in schemas.STATEMENT_STATS.names])
    return spark.createDataFrame(rows, schemas.STATEMENT_STATS)


def changes(spark, before, after):
    found = counters.delta_rows(stats(spark, *after), stats(spark, *before))
    return {r["query"]: (r["calls"], r["mean_exec_time_ms"]) for r in found.collect()}


# Pinned numbers: p95 is mean + 1.645 deviations, at most the maximum; pooled variance has a part between means.
POOLED = [
    ([(1, SCAN, 100, 20, {"stddev_exec_time_ms": 5.0, "max_exec_time_ms": 40.0})], (100, 20.0, 28.225)),
    ([(1, SCAN, 10, 10), (2, SCAN.lower().replace(" ", "  "), 30, 30)], (40, 25.0, 30.0)),
    ([(1, SCAN, 4, 8, {"max_exec_time_ms": 8.5, "stddev_exec_time_ms": 2.0})], (4, 8.0, 8.5)),
]


@pytest.mark.parametrize(("entries", "expected"), POOLED)
def test_pooled_times(spark, entries, expected):
    (got,) = counters.pooled_snapshots(stats(spark, *entries), AT_NOON, AT_NOON, AT_NOON, 1).collect()
    values = got["execution_count"], float(got["avg_execution_time_ms"]), float(got["p95_latency_ms"])
    assert values == pytest.approx(expected)
    assert float(got["impact_score"]) == pytest.approx(expected[0] * expected[1])


def test_pooled_rows_and_buffers_are_per_call_and_rare_statements_go(spark):
    counted = {"rows": 50, "shared_blks_hit": 75, "shared_blks_read": 25}
    table = stats(spark, (1, SCAN, 25, 2, counted), (2, TOUCH, 4, 9))
    (got,) = counters.pooled_snapshots(table, AT_NOON, AT_NOON, AT_NOON, 5).collect()
    assert (got["query_type"], got["query_source"]) == ("SELECT", "postgres")
    assert (got["avg_rows_returned"], got["avg_buffer_hits"], got["avg_buffer_misses"]) == (2.0, 3.0, 1.0)


CHANGES = [
    ("grown", [(1, SCAN, 8, 5)], [(1, SCAN, 20, 8)], {SCAN: (12, 10.0)}),
    ("reset", [(1, SCAN, 8, 5)], [(1, SCAN, 3, 7)], {SCAN: (3, 7.0)}),
    ("idle", [(1, SCAN, 8, 5)], [(1, SCAN, 8, 5)], {}),
    ("new", [(1, SCAN, 8, 5)], [(1, SCAN, 8, 5), (2, TOUCH, 6, 1)], {TOUCH: (6, 1.0)}),
    ("gone", [(1, SCAN, 8, 5), (2, TOUCH, 6, 1)], [(1, SCAN, 9, 5)], {SCAN: (1, 5.0)}),
    # Without an id the text is the key; of two stored rows the one with the smaller mean was stored last.
    ("by text", [(None, TOUCH, 9, 4), (None, TOUCH, 5, 1)], [(None, TOUCH, 8, 4)], {TOUCH: (3, 9.0)}),
]


@pytest.mark.parametrize(("before", "after", "expected"), [c[1:] for c in CHANGES], ids=[c[0] for c in CHANGES])
def test_changes_between_two_captures(spark, before, after, expected):
    assert changes(spark, before, after) == expected


def test_without_an_earlier_capture_counters_stay(spark):
    assert counters.delta_rows(stats(spark, (1, SCAN, 8, 5), (2, TOUCH, 6, 1)), None).count() == 2


def test_deviation_of_the_new_calls_alone(spark):
    # 3 calls of 4 ms, then 3 of 10 ms: pooled mean 7 and deviation 3, none among the new ones.
    before, after = stats(spark, (5, SCAN, 3, 4)), stats(spark, (5, SCAN, 6, 7, {"stddev_exec_time_ms": 3.0}))
    (got,) = counters.delta_rows(after, before).collect()
    assert (got["calls"], got["mean_exec_time_ms"]) == (3, 10.0)
    assert got["stddev_exec_time_ms"] == pytest.approx(0.0, abs=1e-9)


def test_changes_over_a_whole_history(spark):
    captures = {0: [(1, SCAN, 5, 2), (2, TOUCH, 4, 1)], 1: [(1, SCAN, 11, 2)], 2: [(1, SCAN, 11, 2), (2, TOUCH, 9, 1)]}
    history = None
    for hour, entries in captures.items():
        part = stats(spark, *entries).withColumn("captured_at", F.lit(NOON + timedelta(hours=hour)).cast("timestamp_ntz"))
        history = part if history is None else history.unionByName(part)
    found = {(r["captured_at"].hour, r["query"]): r["calls"] for r in counters.history_deltas(history).collect()}
    # The second statement was away for one capture, so it counts as new when it is back.
    assert found == {(12, SCAN): 5, (12, TOUCH): 4, (13, SCAN): 6, (14, TOUCH): 9}


GENERATIONS = {"current": "{}_exec_time", "legacy": "{}_time"}


@pytest.mark.parametrize("form", GENERATIONS.values(), ids=GENERATIONS)
def test_scan_knows_both_generations_of_names(spark, form):
    times = ", ".join(f"CAST({value} AS double) AS {form.format(kind)}" for kind, value in
                      {"total": 12, "mean": 4, "stddev": "NULL", "min": 1, "max": 9}.items())
    view = spark.sql(f"SELECT 3L AS queryid, 'SELECT $1' AS query, 3L AS calls, {times}, 5L AS rows, NULL AS shared_blks_hit, 0L AS shared_blks_read")
    (got,) = statements.scan_statements(view).collect()
    assert (got["calls"], got["mean_exec_time_ms"], got["stddev_exec_time_ms"]) == (3, 4.0, 0.0)
    assert (got["dbid"], got["shared_blks_hit"], got["rows"]) == (None, 0, 5)


def test_scan_keeps_all_statements_unless_limited(spark):
    many = stats(spark, *[(i, f"SELECT {i} FROM depots", 2, i) for i in range(6000)])
    assert statements.scan_statements(many).count() == 6000
    top = statements.scan_statements(many, limit=3).collect()
    assert sorted(r["queryid"] for r in top) == [5997, 5998, 5999]


def test_scan_refuses_another_table(spark):
    with pytest.raises(statements.StatementsUnavailable, match="shared_preload_libraries"):
        statements.scan_statements(spark.range(1))


def stored(spark, path, *times):
    for number, at in enumerate(times, 1):
        sinks.save_capture(stats(spark, (1, SCAN, 10 * number, 2), (2, TOUCH, number, 3)), F.lit(at), path)
    return read_table(spark, path, "stat_snapshots")


def test_retention_drops_whole_days_and_the_head_of_one(spark, tmp_path):
    path = str(tmp_path / "kept")
    morning = NOON.replace(hour=2)
    stored(spark, path, NOON - timedelta(days=60), NOON - timedelta(days=9), morning, NOON)
    assert sinks.prune_captures(spark, path, counters.retention_bound(NOON, retention_days=30)) == 2
    assert sinks.prune_captures(spark, path, None) == 0 and counters.retention_bound(NOON, 0) is None
    assert sinks.prune_captures(spark, path, F.lit(morning + timedelta(hours=1))) == 4
    left = counters.captures(read_table(spark, path, "stat_snapshots")).collect()
    assert [(r["captured_at"], r["statements"]) for r in left] == [(NOON, 2)]


def test_export_has_iso_times_in_order(spark, tmp_path):
    history = stored(spark, str(tmp_path / "kept"), NOON - timedelta(days=5), NOON)
    out = str(tmp_path / "csv")
    sinks.export_csv(counters.export_rows(history, since=NOON - timedelta(days=1)), out)
    rows = spark.read.csv(out, header=True).collect()
    assert [(r["captured_at"], r["queryid"]) for r in rows] == [("2025-03-14T12:00:00", "1"), ("2025-03-14T12:00:00", "2")]
    assert rows[0]["query_fingerprint"] == "SELECT NAME FROM DEPOTS WHERE REGION = ?"


def test_profiles_follow_each_other_without_gaps(spark, tmp_path):
    hist, snaps = str(tmp_path / "h"), str(tmp_path / "s")
    for hour, calls in enumerate((12, 20, 20)):
        view = stats(spark, (1, SCAN, calls, 2))
        pipelines.store_statement_profile(spark, view, F.lit(NOON + timedelta(hours=hour)), snaps, hist)
    got = read_table(spark, snaps, "workload_snapshots").orderBy("snapshot_timestamp").collect()
    assert [(r["execution_count"], r["window_start"]) for r in got] == [(12, NOON), (8, NOON)]
    # The idle window has left neither snapshots nor a capture.
    assert read_table(spark, hist, "stat_snapshots").select("captured_at").distinct().count() == 2


def test_first_window_begins_at_the_last_reset(spark, tmp_path):
    reset = NOON - timedelta(hours=7)
    paths = str(tmp_path / "s"), str(tmp_path / "h")
    pipelines.store_statement_profile(spark, stats(spark, (1, SCAN, 9, 2)), AT_NOON, *paths, stats_reset_at=F.lit(reset))
    (got,) = read_table(spark, paths[0], "workload_snapshots").collect()
    assert (got["window_start"], got["window_end"]) == (reset, NOON)


def test_upsert_takes_four_columns_and_one_row_per_key(spark, tmp_path):
    path = str(tmp_path / "s")
    snap = lambda *entries: counters.pooled_snapshots(stats(spark, *entries), AT_NOON, AT_NOON, AT_NOON)
    sinks.save_snapshots(spark, snap((1, SCAN, 10, 10)), path)
    sinks.save_snapshots(spark, snap((1, SCAN, 15, 1)).unionByName(snap((1, SCAN, 30, 20), (2, TOUCH, 1, 1))), path)
    rows = {r["query_type"]: r for r in read_table(spark, path, "workload_snapshots").collect()}
    old = rows["SELECT"]
    assert len(rows) == 2 and (old["execution_count"], float(old["impact_score"])) == (30, 600.0)
    assert (float(old["avg_execution_time_ms"]), float(old["total_execution_time_ms"])) == (20.0, 100.0)
