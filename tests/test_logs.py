import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from worklens.operators import workload
from worklens.sources import json_log, registry, stderr_log

NOW = F.expr("timestamp_ntz'2030-01-01 00:00:00'")
PREFIX = "2025-01-09 10:30:45.123 UTC [12345] LOG:  duration: "


def read(spark, path):
    rows = stderr_log.read_stderr_log(spark, str(path)).orderBy("seq").collect()
    return [(r["query"], r["execution_time_ms"]) for r in rows]


def test_multiline_execute_and_zone(spark, tmp_path):
    log = tmp_path / "pg.log"
    log.write_text(
        "junk before the first entry\n"
        "2025-01-09 12:34:56.789 EST [12345] LOG:  duration: 12.3 ms  statement: SELECT id\n"
        "FROM users\nWHERE active = true\n"
        "2025-01-09 12:35:00.000 UTC [12346] LOG:  duration: 1.0 ms  execute <unnamed>: SELECT 1\n"
        "2025-13-09 12:35:00.000 UTC [12346] LOG:  duration: 1.0 ms  statement: SELECT bad date\n"
        "2025-01-09 12:35:01.000 UTC [12346] LOG:  duration: 1.2.3 ms  statement: SELECT bad number\n"
        "2025-01-09 12:35:01.000 UTC [12346] LOG:  duration: 1 ms  statement:   \n"
        "2025-01-09 12:35:02.000 UTC [12346] ERROR:  relation missing\n"
        "2025-01-09 12:35:02.500 UTC [12346] LOG:\n"
        "duration: 5 ms  statement: SELECT lost\n"
    )
    rows = stderr_log.read_stderr_log(spark, str(log)).orderBy("seq").collect()
    assert [r["query"] for r in rows] == [
        "SELECT id\nFROM users\nWHERE active = true /* pg_log_tz=EST */", "SELECT 1",
    ]
    assert rows[0]["ts"] == datetime(2025, 1, 9, 12, 34, 56, 789000) and rows[0]["success"] is True


def test_malformed_line_joins_the_entry_before(spark, tmp_path):
    log = tmp_path / "e.log"
    log.write_text(f"\n{PREFIX}234.567 ms  statement: SELECT * FROM users\nMALFORMED LINE\n{PREFIX}45.1 ms  statement: SELECT 2\n")
    assert read(spark, log) == [("SELECT * FROM users\nMALFORMED LINE", 234.567), ("SELECT 2", 45.1)]


@pytest.mark.parametrize("stage", [False, True])
def test_result_does_not_depend_on_file_splits(spark, tmp_path, stage):
    rng = random.Random(3)
    expected = {}
    for f in range(2):
        entries = []
        for i in range(60):
            sql = f"SELECT {f}_{i}" + "".join("\n" + "x" * rng.randint(0, 60) for _ in range(rng.choice([0, 0, 1, 5, 40])))
            entries.append(sql.strip())
        (tmp_path / f"{f}.log").write_text("".join(f"{PREFIX}{i}.5 ms  statement: {s}\n" for i, s in enumerate(entries)))
        expected[f] = [(s, i + 0.5) for i, s in enumerate(entries)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = stderr_log.read_stderr_log(spark, str(tmp_path), stage=stage).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = [(r["query"], r["execution_time_ms"]) for r in rows]
    assert got == expected[0] + expected[1]


def parse(spark, values, reader=json_log.parse_json_rows, **options):
    df = spark.createDataFrame([("f", 0, i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)],
                               "file string, block long, line long, value string")
    return reader(df, NOW, **options).orderBy("seq").collect()


def test_json_fallbacks(spark):
    rows = parse(spark, [
        {"timestamp": "2024-01-02T03:04:05.25Z", "query": "SELECT 1", "duration_ms": 2.5, "rows_returned": 3},
        {"timestamp": "", "time": "2024-01-02 03:04:05", "duration_ms": 0, "latency_ms": "7"},
        {"ts": "2024-01-02T03:04:05Z", "duration_ms": None, "success": "off"},
        {"timestamp": 17, "time": "2024-01-02 03:04:05"},
    ])
    assert [r["reject_reason"] for r in rows] == [None] * 4
    assert [r["ts"] for r in rows] == [
        datetime(2024, 1, 2, 3, 4, 5, 250000), datetime(2024, 1, 2, 3, 4, 5), datetime(2030, 1, 1), datetime(2030, 1, 1),
    ]
    assert [r["execution_time_ms"] for r in rows] == [2.5, 7.0, 0.0, 0.0]
    assert [r["success"] for r in rows] == [True, True, False, True]
    assert rows[1]["query"] == ""


def test_json_rejects(spark):
    cases = {
        "{bad": "not JSON", "[1]": "not an object", '{"a":1} x': "not JSON",
        '{"query": null}': "bad query", '{"query": 5}': "bad query", '{"success": null}': "bad success",
        '{"latency_ms": null}': "bad execution time", '{"duration_ms": [1]}': "bad execution time",
        '{"rows_returned": 1.5}': "bad rows_returned", '{"user": 3}': "bad user",
    }
    rows = parse(spark, list(cases))
    assert [r["reject_reason"] for r in rows] == list(cases.values())
    assert parse(spark, ["   "]) == []
    assert parse(spark, ["{}"], on_bad_ts="reject")[0]["reject_reason"] == "bad timestamp"


def test_vector_rows(spark):
    rows = parse(spark, [
        {"timestamp": "2024-01-02T03:04:05Z", "collection": "docs", "top_k": 5,
         "filter": {"z": "a, b", "a": [1, 2]}, "latency_ms": 3, "results_count": 4, "status": "success"},
        {"timestamp": "2024-01-02T03:04:05+02:00"},
        {"timestamp": "soon"},
    ], json_log.parse_vector_rows)
    assert rows[0]["query"] == json.dumps(
        {"collection": "docs", "query_vector": "[...]", "top_k": 5, "filter": {"z": "a, b", "a": [1, 2]}})
    assert rows[0]["success"] is True and rows[1]["success"] is False
    assert rows[1]["query"] == '{"collection": null, "query_vector": "[...]", "top_k": null, "filter": null}'
    assert rows[1]["ts"] == datetime(2024, 1, 2, 1, 4, 5)
    assert rows[2]["reject_reason"] == "bad timestamp"


def test_sources_are_collected_in_order_and_missing_ones_skipped(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"query": "SELECT 1", "duration_ms": 1}\n')
    (tmp_path / "p.log").write_text(f"{PREFIX}2 ms  statement: SELECT 2\n")
    logs = registry.collect_logs(spark, {
        "application_logs": {"enabled": True, "log_path": str(tmp_path / "a.json")},
        "postgres_logs": {"enabled": True, "log_path": str(tmp_path / "p.log")},
        "vector_logs": {"enabled": True, "log_path": str(tmp_path / "none")},
        "other_logs": {"enabled": True, "log_path": str(tmp_path / "a.json")},
        "postgres_logs_off": {"enabled": False},
    }, NOW)
    rows = logs.orderBy("seq").collect()
    assert [(r["query"], r["source"]) for r in rows] == [("SELECT 1", "application"), ("SELECT 2", "postgres")]
    with pytest.raises(ValueError):
        registry.reader_for("other_logs")
    assert registry.reader_for("postgres_logs", "csv") is not registry.reader_for("postgres_logs")


def test_a_file_of_another_format_gives_no_entries(spark, tmp_path):
    (tmp_path / "p.log").write_text("2025-01-09,a,b\n" * 5000)
    assert stderr_log.read_stderr_log(spark, str(tmp_path)).isEmpty()


def test_snapshots_of_a_log(spark, tmp_path):
    start = "2025-01-09 10:30:{:02d}.123 UTC [1] LOG:  duration: {} ms  statement: {}\n"
    lines = [start.format(i, 100 + 10 * i, f"SELECT * FROM users WHERE email = '{i}'") for i in range(10)]
    lines += [start.format(20 + i, 5, "INSERT INTO t VALUES (1)") for i in range(3)]
    (tmp_path / "p.log").write_text("".join(lines))
    log = stderr_log.read_stderr_log(spark, str(tmp_path / "p.log"))
    rows = workload.by_impact(workload.workload_snapshots(log, datetime(2025, 1, 9, 11), 60, 2)).collect()
    assert [r["query_type"] for r in rows] == ["SELECT", "INSERT"]
    top = rows[0]
    assert (top["execution_count"], top["p50_latency_ms"], top["p95_latency_ms"]) == (10, 150.0, 190.0)
    assert top["impact_score"] == pytest.approx(1450.0) and top["error_count"] == 0
    assert top["example_query"].endswith("'0'") and top["window_end"] == datetime(2025, 1, 9, 10, 30, 22, 123000)
    assert workload.workload_snapshots(log, datetime(2025, 1, 9), 60, 100).count() == 0
