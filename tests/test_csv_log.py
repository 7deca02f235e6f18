"""The csv log read in many splits against a whole read."""

import random

import pytest
from pyspark.sql import functions as F

from worklens import fixed
from worklens.sources import csv_log, registry

SPLIT = "spark.sql.files.maxPartitionBytes"


def record(i, message):
    fields = [f"2025-01-09 10:{i // 60 % 60:02d}:{i % 60:02d}.123 UTC", *(f"f{j}" for j in range(12)), message, "", "more"]
    return ",".join(f'"{f}"'.replace('"' + f + '"', '"' + f.replace('"', '""') + '"') if any(c in f for c in ',"\r\n') or i % 3 else f for f in fields)


def written(tmp_path, rows, end="\n", name="a.csv"):
    path = tmp_path / name
    path.write_bytes((end.join(rows) + end).encode())
    return str(path)


def whole(spark, path):
    """Duration and statement of the records, by Spark's reader of whole files."""
    schema = ", ".join(f"c{i} string" for i in range(14))
    rows = spark.read.schema(schema).options(multiLine=True, escape='"').csv(path)
    found = rows.where(F.col("c13").rlike(fixed.DURATION_STATEMENT)).select("c13")
    return sorted(r[0] for r in found.select(F.btrim(F.regexp_extract("c13", fixed.DURATION_STATEMENT, 3), F.lit(" \n\r\t"))).collect())


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get(SPLIT)
    spark.conf.set(SPLIT, "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set(SPLIT, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def statements(rng, n):
    parts = ["SELECT 1", "SELECT 'a,b'", 'SELECT "x" FROM t', "SELECT\n  2", 'SELECT "a\n""b"', '""', "SELECT '\n\n\n'", "x" * 300]
    return ["duration: 1.5 ms  statement: SELECT " + " ".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(n)]


def test_splits_inside_quotes_are_read_as_a_whole(spark, tmp_path, small_splits):
    rng = random.Random(4)
    rows = [record(i, m) for i, m in enumerate(statements(rng, 800))]
    # A message over several splits, and lines in it that look like records.
    rows[400] = record(400, "duration: 2 ms  statement: SELECT 'long\n" + "\n".join(record(i, "duration: 9 ms  statement: not one") for i in range(200)) + "'")
    path = written(tmp_path, rows)
    lines = csv_log._lines(spark, path)
    assert lines.rdd.getNumPartitions() > 20
    assert len(csv_log.splits_inside_quotes(lines)) >= 3
    got = sorted(r["query"] for r in csv_log.read_csv_log(spark, path).collect())
    assert got == whole(spark, path) and len(got) == 800


def test_other_line_ends_blank_lines_and_several_files(spark, tmp_path, small_splits):
    rng = random.Random(5)
    messages = statements(rng, 200)
    written(tmp_path, [record(i, m) for i, m in enumerate(messages)], "\r\n", "a.csv")
    written(tmp_path, [record(i, m) for i, m in enumerate(messages)] + ["", "", "not,a,record"], "\n", "b.csv")
    written(tmp_path, ['"never closed, ' + "x" * 50], "\n", "c.csv")
    got = sorted(r["query"] for r in csv_log.read_csv_log(spark, str(tmp_path)).collect())
    one = sorted(r["query"] for r in csv_log.read_csv_log(spark, str(tmp_path / "b.csv")).collect())
    assert len(one) == 200 and got == sorted(one * 2)
    rows = csv_log.read_csv_log(spark, str(tmp_path / "b.csv"))
    assert rows.select("seq").distinct().count() == 200
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_text("")
    assert csv_log.read_csv_log(spark, str(tmp_path / "empty")).isEmpty()


def test_unknown_formats_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="format"):
        registry.reader_for("postgres_logs", "xml")
    assert registry.reader_for("postgres_logs", "standard") is registry.reader_for("postgres_logs")
    assert registry.reader_for("vector_logs", None) is registry.reader_for("vector_logs")


def test_a_source_that_fails_while_it_runs_fails_alone(spark, tmp_path):
    (tmp_path / "bad.json.gz").write_bytes(b"this is no gzip file")
    (tmp_path / "good.json").write_text('{"query": "SELECT 1", "duration_ms": 1}\n')
    sources = {
        "application_logs": {"enabled": True, "log_path": str(tmp_path / "bad.json.gz")},
        "vector_logs": {"enabled": True, "log_path": str(tmp_path / "none")},
        "postgres_logs": {"enabled": True, "log_path": str(tmp_path / "good.json"), "log_format": "json"},
        "other": {"enabled": True, "log_path": "x"},
        "off": {"enabled": False},
    }
    rows, status = registry.store_logs(spark, sources, F.expr("timestamp_ntz'2030-01-01 00:00:00'"), str(tmp_path / "out"))
    assert [r["query"] for r in rows.collect()] == ["SELECT 1"]
    told = {r["source"]: (r["status"], r["rows"]) for r in status.collect()}
    assert told == {"application_logs": ("failed", 0), "vector_logs": ("failed", 0), "postgres_logs": ("stored", 1), "other": ("failed", 0)}
    assert all(r["error"] for r in status.where("status = 'failed'").collect())
