from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from worklens import fixed, schemas
from worklens.functions import sqlcheck
from worklens.operators import recommend, review

X = F.col("x")
T0 = datetime(2026, 1, 1)


@pytest.mark.parametrize("sql,flags", [
    ("DROP TABLE users", ["DROP TABLE"]),
    ("DROP INDEX idx_a", ["DROP INDEX"]),
    ("TRUNCATE orders", ["TRUNCATE"]),
    ("DELETE FROM users", [fixed.DELETE_REASON]),
    ("UPDATE users SET active = false", [fixed.UPDATE_REASON]),
    ("ALTER TABLE t DROP COLUMN c", ["ALTER TABLE DropColumn"]),
    ("ALTER TABLE t ALTER COLUMN c TYPE text", ["ALTER TABLE AlterColumnType"]),
    ("CREATE INDEX i ON t (a); DROP TABLE old_t", ["DROP TABLE"]),
    ("ALTER TABLE t ALTER c DROP NOT NULL, DROP d, ALTER e DROP DEFAULT, DROP CONSTRAINT k",
     ["ALTER TABLE DropNotNull", "ALTER TABLE DropColumn", "ALTER TABLE DropConstraint"]),
    ("WITH a AS (SELECT 1 WHERE true) DELETE FROM t", [fixed.DELETE_REASON]),
    ("DELETE FROM t USING (SELECT 1 WHERE true) u", [fixed.DELETE_REASON]),
    ("UPDATE t SET a = 'WHERE' -- WHERE", [fixed.UPDATE_REASON]),
    ("DROP FOREIGN TABLE f", ["DROP FOREIGN_TABLE"]),
    ("DROP OPERATOR CLASS c", ["DROP OPCLASS"]),
    ("DROP DATABASE d", []),
    ("CREATE INDEX CONCURRENTLY idx_orders_user ON orders (user_id)", []),
    ("DELETE FROM sessions WHERE expires_at < now()", []),
    ("UPDATE users SET active = false WHERE id = 7", []),
    ("ALTER TABLE t ADD COLUMN c int", []),
    ("INSERT INTO t (a) VALUES ('; DROP TABLE t --')", []),
    ("WITH d AS (DELETE FROM t) SELECT * FROM d", []),
])
def test_destructive_flags(one, sql, flags):
    (got,) = one([sql], sqlcheck.check(X))
    assert got["parse_error"] is None and got["destructive"] == flags and got["statement_types"]


@pytest.mark.parametrize("sql,message", [
    ("SELEC * FRM users", "syntax error"), ("CREATE INDEX ON", "syntax error"), ("SELECT (1", "syntax error"),
    ("SELECT 'a", "syntax error"), ("", "empty"), ("  ", "empty"), (None, "empty"),
    ("-- just a comment", "no SQL statements"), (";;", "no SQL statements"),
])
def test_sql_that_is_not_accepted(one, sql, message):
    (got,) = one([sql], sqlcheck.check(X))
    assert message in got["parse_error"] and got["destructive"] == []


def test_long_literal_in_check(one):
    (got,) = one(["INSERT INTO t VALUES ('" + "x''" * 60_000 + "')"], sqlcheck.check(X))
    assert got["parse_error"] is None


def test_layout_is_no_change(spark):
    rows = spark.createDataFrame([
        ("select 1", "SELECT   1 -- same"), ("select a=1", "SELECT a = 1;"), ("select 'a'", "select 'A'"),
        ("-- now\nSELECT * FROM orders WHERE user_id = 123", "SELECT id FROM orders WHERE user_id = 123 ORDER BY id LIMIT 50"),
        (None, "CREATE INDEX i ON t (a)"),
    ], "current_sql string, sql string")
    got = review.changes(rows).collect()
    assert [r["changed"] for r in got] == [False, False, True, True, True]
    assert got[3]["removed_clauses"] == ["SELECT *"] and got[3]["added_clauses"] == ["SELECT ID", "ORDER BY ID", "LIMIT 50"]
    assert got[4]["removed_clauses"] == []


def events(spark, *rows):
    names = schemas.REVIEW_EVENT.names
    data = []
    for i, r in enumerate(rows):
        full = {"ts": T0 + timedelta(minutes=i), "seq": i, "proposal_id": "p", "actor": "ben", **r}
        data.append(tuple(full.get(n) for n in names))
    return spark.createDataFrame(data, schemas.REVIEW_EVENT)


def propose(sql, **more):
    return {"action": "propose", "sql": sql, "title": "t", **more}


APPLY = {"action": "apply", "confirm": True}


def actions(e, **mode):
    return [r["action"] for r in review.audit_log(e, **mode).orderBy("ts", "seq").collect()]


def status(e, **mode):
    (row,) = review.proposal_state(e, **mode).collect()
    return row


def test_nothing_is_applied_without_approval(spark):
    e = events(spark, propose("INSERT INTO t VALUES (1, 'a')"), APPLY, {"action": "approve"},
               {"action": "apply", "confirm": False}, APPLY, APPLY)
    assert actions(e) == ["propose", "apply_blocked", "approve", "apply_blocked", "apply", "apply_blocked"]
    s = status(e)
    assert (s["status"], s["applied_by"], s["reviewed_by"]) == ("applied", "ben", "ben")
    reasons = [r["reason"] for r in review.audit_log(e).orderBy("ts").collect() if r["action"] == "apply_blocked"]
    assert "not approved" in reasons[0] and "explicit confirmation" in reasons[1] and "p is applied" in reasons[2]


def test_reject_needs_and_keeps_a_reason(spark):
    e = events(spark, propose("DELETE FROM t"), {"action": "reject", "reason": "  "},
               {"action": "reject", "reason": " no WHERE "}, {"action": "approve"}, APPLY)
    s = status(e)
    assert (s["status"], s["reason"], s["destructive"]) == ("rejected", "no WHERE", [fixed.DELETE_REASON])
    assert actions(e) == ["propose", "reject", "apply_blocked"]
    refused = {r["action"]: r["refusal"] for r in review.verdicts(e).filter("NOT accepted").collect()}
    assert refused["approve"] == "p is rejected; can only approve from pending"


def test_sql_that_does_not_parse_is_blocked_in_both_modes(spark):
    e = events(spark, propose("INSRT INTO t VALUES (2)"), {"action": "approve"}, APPLY)
    assert status(e)["status"] == "pending" and status(e, mode_on=False)["status"] == "pending"
    blocked = review.audit_log(e, mode_on=False).filter("action = 'apply_blocked'").collect()
    assert "does not parse" in blocked[0]["reason"]


def test_failed_apply_is_final(spark):
    e = events(spark, propose("INSERT INTO t VALUES (5)"), {"action": "approve"},
               {**APPLY, "error": "duplicate key\nmore"}, APPLY, {"action": "reject", "reason": "late"})
    s = status(e)
    assert (s["status"], s["apply_error"]) == ("failed", "duplicate key")
    assert actions(e) == ["propose", "approve", "apply_failed", "apply_blocked"]


def test_mode_off_still_needs_confirmation(spark):
    e = events(spark, propose("INSERT INTO t VALUES (3)"), {"action": "apply", "confirm": False}, APPLY)
    assert status(e, mode_on=False)["status"] == "applied" and status(e)["status"] == "pending"


def test_events_before_the_proposal_or_without_actor_do_nothing(spark):
    e = events(spark, {"action": "approve"}, propose("SELECT 1 FROM t"), {"action": "approve", "actor": ""}, APPLY)
    assert status(e)["status"] == "pending"
    first = review.verdicts(e).orderBy("ts").first()
    assert first["refusal"] == "no proposal p"


def test_equal_times_are_ordered_by_seq(spark):
    same = {"ts": T0}
    e = events(spark, {**propose("SELECT 1 FROM t"), **same}, {"action": "approve", **same},
               {"action": "reject", "reason": "r", **same}, {**APPLY, **same})
    assert status(e)["status"] == "rejected"
    assert actions(e) == ["propose", "approve", "reject", "apply_blocked"]


def test_review_mode_setting():
    assert review.review_mode() is True and review.review_mode(False) is False
    assert review.review_mode(False, "1") is True and review.review_mode(True, " Off ") is False
    assert review.review_mode(None, " ") is True


def test_explain_never_runs_writes(one):
    sql = recommend.explain_sql(X, review.F.lit("UPDATE"))
    assert one(["UPDATE t SET x = 1 WHERE id = 1;"], sql) == ["EXPLAIN UPDATE t SET x = 1 WHERE id = 1;"]
    assert one(["SELECT * FROM t;;"], recommend.explain_sql(X, F.lit("select"))) == ["EXPLAIN (ANALYZE, BUFFERS) SELECT * FROM t;"]


def test_recommendation_without_snapshots_is_a_health_check(spark):
    empty = spark.createDataFrame([], schemas.WORKLOAD_SNAPSHOT)
    (rec,) = recommend.heuristic(empty, F.lit(T0)).collect()
    assert rec["migration_sql"] == "SELECT version();" and rec["recommendation_type"] == "config_tuning"
    assert '"backend": "stub"' in rec["config_patch"]
    queued = review.enqueue(recommend.heuristic(empty, F.lit(T0)))
    (s,) = review.proposal_state(queued).collect()
    assert s["source"] == "architect" and s["recommendation_id"] == rec["recommendation_id"]


def test_one_fold_serves_audit_and_state(spark, monkeypatch):
    from worklens.plans.queries import review_events

    events, made = review_events(spark, "/root/testdata/sf0.001"), []
    monkeypatch.setattr(review, "checked", lambda rows, whole=review.checked: made.append(1) or whole(rows))
    fold = review.folded(events)
    rows = lambda frame: sorted(map(str, frame.collect()))
    got = rows(review.audit_log(events, fold=fold)), rows(review.proposal_state(events, fold=fold))
    assert len(made) == 1  # proposals are checked once
    assert got == (rows(review.audit_log(events)), rows(review.proposal_state(events)))
