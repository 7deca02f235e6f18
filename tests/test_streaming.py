"""Streams against the batch over the same rows."""

import itertools
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from worklens import schemas
from worklens.operators import review
from worklens.streaming import hourly, json_tail, ledger
from worklens.streaming.json_tail import append_new_entries

NOW = "timestamp_ntz'2030-01-01 00:00:00'"


def test_each_run_takes_only_new_files(spark, tmp_path):
    logs, table, state = tmp_path / "logs", str(tmp_path / "table"), str(tmp_path / "state")
    logs.mkdir()
    now = F.expr(NOW)

    def run():
        append_new_entries(spark, str(logs), table, state, now).awaitTermination()
        return sorted(r["query_fingerprint"] for r in spark.read.parquet(table).collect())

    (logs / "a.json").write_text('{"query": "SELECT 1", "duration_ms": 1}\n{bad\n')
    assert run() == ["SELECT ?"]
    (logs / "b.json").write_text('{"query": "SELECT x FROM t WHERE id = 7", "duration_ms": 1}\n')
    assert run() == ["SELECT ?", "SELECT X FROM T WHERE ID = ?"]
    assert len(run()) == 2


def line(at, n):
    return json.dumps({"timestamp": at.isoformat(), "query": f"SELECT {n} FROM t{n % 3}", "duration_ms": 1 + n % 17 * 1.25, "success": n % 5 > 0})


def files(start):
    """Three files of hours that overlap, and one row far ahead that closes them."""
    out = {}
    for f in range(3):
        out[f"f{f}.json"] = [line(start + timedelta(minutes=70 * f + 7 * i), 10 * f + i) for i in range(30)] + ["{bad", "  ", '{"query": "SELECT 1", "duration_ms": 1}']
    return out


def replay(spark, folder, order, content, delay):
    logs = folder / "logs"
    logs.mkdir(parents=True)
    paths = {n: str(folder / n) for n in ("log", "state", "rejects", "late", "hours", "hour-state")}
    for name in order:
        (logs / name).write_text("\n".join(content[name]) + "\n")
        append_new_entries(spark, str(logs), paths["log"], paths["state"], F.expr(NOW), rejects=paths["rejects"], late=paths["late"], delay=delay).awaitTermination()
        hourly.append_closed_hours(spark, paths["log"], paths["hours"], paths["hour-state"], delay).awaitTermination()
    return paths


def told(frame):
    return sorted(map(str, frame.select("hour", "query_fingerprint", "executions", "total_ms", "min_ms", "max_ms", "errors", "sketch").collect()))


def test_closed_hours_equal_the_batch_in_any_order_of_files(spark, tmp_path):
    content = files(datetime(2024, 1, 1, 6))
    last = datetime(2024, 1, 5)
    content["last.json"] = [line(last, 1)]
    results = []
    for number, order in enumerate([p for p in itertools.permutations(sorted(content)[:3])][::3]):
        paths = replay(spark, tmp_path / str(number), [*order, "last.json"], content, "10 hours")
        log = spark.read.schema(hourly.LOG).parquet(paths["log"])
        assert spark.read.parquet(paths["late"]).isEmpty()
        batch = hourly.hours(hourly.cells(hourly.with_event_time(log.where(F.col("ts") < F.lit(last).cast("timestamp_ntz")))))
        streamed = hourly.hours(spark.read.parquet(paths["hours"]))
        assert told(streamed) == told(batch) and streamed.count() > 10
        refused = sorted(r["reject_reason"] for r in spark.read.parquet(paths["rejects"]).collect())
        assert refused == ["bad timestamp"] * 3 + ["not JSON"] * 3
        results.append(told(streamed))
    assert len(results) == 2 and results[0] == results[1]


def test_only_refused_lines_are_kept_with_what_was_parsed(spark, tmp_path, monkeypatch):
    parsed, write = [], json_tail.staged
    monkeypatch.setattr(json_tail, "staged", lambda frame, name: parsed.append(write(frame, name)) or parsed[-1])
    content = files(datetime(2024, 1, 1, 6))
    paths = replay(spark, tmp_path, ["f0.json"], content, "1 hour")
    rows = parsed[0].collect()
    assert len(rows) == 32 and all((r["raw"] is None) == (r["reject_reason"] is None) for r in rows)
    assert {r["raw"] for r in spark.read.parquet(paths["rejects"]).collect()} == {"{bad", '{"query": "SELECT 1", "duration_ms": 1}'}


def test_rows_behind_the_watermark_are_counted_apart(spark, tmp_path):
    content = files(datetime(2024, 1, 1, 6))
    paths = replay(spark, tmp_path, ["f2.json", "f0.json"], content, "0 minutes")
    stored, late = spark.read.parquet(paths["log"]), spark.read.parquet(paths["late"])
    newest = max(datetime.fromisoformat(json.loads(x)["timestamp"]) for x in content["f2.json"] if "timestamp" in x)
    times = [datetime.fromisoformat(json.loads(x)["timestamp"]) for x in content["f0.json"] if "timestamp" in x]
    behind = [t for t in times if t.replace(minute=0) + timedelta(hours=1) <= newest]
    assert behind and late.agg(F.sum("late_rows")).first()[0] == len(behind)
    assert stored.count() == 60 - len(behind)
    assert {r["hour"] for r in late.collect()} == {t.replace(minute=0) for t in behind}


def events(spark):
    rows, at = [], datetime(2024, 1, 1)
    add = lambda pid, action, **more: rows.append({"ts": at + timedelta(minutes=len(rows)), "seq": len(rows), "proposal_id": pid, "action": action, **more})
    for pid, sql in (("a", "UPDATE t SET x = 1"), ("b", "SELEC * FRM t"), ("c", "SELECT 1"), ("d", "CREATE INDEX i ON t (x)")):
        add(pid, "propose", sql=sql, actor="" if pid == "c" else "dana", title=pid, confidence=None)
    add("a", "apply", confirm=True, actor="r")
    add("a", "approve", actor="")
    add("a", "approve", actor="r1", reason="fine")
    add("b", "approve", actor="r1")
    add("a", "approve", actor="r2")
    add("a", "apply", confirm=False, actor="r")
    add("a", "apply", confirm=True, actor="r", sql="SELEC broken")
    add("a", "apply", confirm=True, actor="r", sql="UPDATE t SET x = 2", error="duplicate key\ndetail")
    add("a", "reject", actor="r", reason=" no ")
    add("c", "reject", actor="r", reason="  ")
    add("c", "reject", actor="r", reason=" no ")
    add("c", "apply", confirm=True, actor="r")
    add("d", "approve", actor="r3")
    add("d", "reject", actor="r3", reason="changed")
    add("gone", "apply", confirm=True, actor="r")
    add("gone", "approve", actor="r")
    add("d", "propose", sql="SELECT 2", actor="x")
    add("b", "reject", actor="r", reason="broken")
    add("e", "propose", sql="SELECT 3", actor="x")
    add("e", "approve", actor="r")
    add("e", "apply", confirm=True, actor="r")
    return schemas.conform(spark.createDataFrame([tuple(r.get(f.name) for f in schemas.REVIEW_EVENT.fields) for r in rows], schemas.REVIEW_EVENT), schemas.REVIEW_EVENT), len(rows)


@pytest.mark.parametrize("mode_on", [True, False])
def test_ledger_in_state_equals_the_batch_fold(spark, tmp_path, mode_on):
    ledger_events, n = events(spark)
    path, out, state = (str(tmp_path / x) for x in ("events", "out", "state"))
    for start in range(0, n, 14):  # a run, and so a restart, twice
        ledger_events.where(f"seq >= {start} and seq < {start + 14}").write.mode("append").parquet(path)
        ledger.append_verdicts(spark, path, out, state, mode_on).awaitTermination()
    verdicts = spark.read.parquet(out)
    assert verdicts.count() == n
    rows = lambda frame: sorted(map(str, frame.collect()))
    assert rows(review.audit_rows(verdicts, mode_on)) == rows(review.audit_log(ledger_events, mode_on))
    assert rows(ledger.state_from_verdicts(verdicts, ledger_events)) == rows(review.proposal_state(ledger_events, mode_on))
    refused = {(r["seq"], r["refusal"]) for r in verdicts.where("refusal is not null").collect()}
    assert refused == {(r["seq"], r["refusal"]) for r in review.verdicts(ledger_events, mode_on).where("refusal is not null").collect()}
    assert (10, "SQL does not parse") in refused


def test_proposals_share_the_keys_of_the_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "BUCKETS", 2)
    ledger_events, n = events(spark)
    path, out, state = (str(tmp_path / x) for x in ("events", "out", "state"))
    ledger_events.write.parquet(path)
    query = ledger.append_verdicts(spark, path, out, state)
    query.awaitTermination()
    assert 1 <= query.lastProgress.stateOperators[0].numRowsTotal <= 2 < ledger_events.select("proposal_id").distinct().count()
    assert spark.read.parquet(out).count() == n
