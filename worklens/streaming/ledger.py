"""The review ledger as arbitrary state: events are judged as they arrive.

``transformWithState`` keeps one small state per proposal: what its first ``propose`` event
said, and its status. An event is judged against that state and moves it; no earlier event is
read again, whatever the length of the ledger. Each key of the state store costs several calls
between Python and the JVM, so proposals share ``BUCKETS`` keys by a hash of their id: a bucket is
read and written once per micro-batch, not each proposal by itself. SQL is checked by expressions
before the rows reach the state, so Python only compares fields. Judged events have the columns of
:func:`worklens.operators.review.verdicts`; audit rows and proposal states follow from them by
the functions of the batch fold.

Events of a proposal have to arrive in the order of ``(ts, seq)``, micro-batch by micro-batch;
within one they are sorted here. Each micro-batch replaces its own folder, and Spark keeps the
state with the checkpoint, so a restart goes on where the last commit was.
"""

from __future__ import annotations

import json
import sys
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from worklens import fixed, schemas
from worklens.functions import sqlcheck
from worklens.functions.text import strip
from worklens.operators import review

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What a proposal's first event says, kept as one JSON text in its state.
FACTS = "parse_ok boolean, parse_error string, destructive array<string>, statement_types array<string>, _source string, _confidence decimal(5,4)"
#: A bucket's proposals, as JSON: lists of id, status, parse_ok, parse_error and facts.
STATE = "proposals string"
#: Keys of the state store. A checkpoint keeps the number that it was begun with.
BUCKETS = 4096
#: Workers need no part of the package: fixed texts travel with the processor.
TEXTS = {n: getattr(fixed, n) for n in ("NO_APPROVER", "NO_REJECTER", "NO_REASON", "NEEDS_CONFIRM", "DOES_NOT_PARSE")}
EVENT = "ts timestamp, seq long, proposal_id string, action string, actor string, reason string, confirm boolean, error string"
JUDGED = f"{EVENT}, facts string, _known boolean, status_before string, refusal string"


def _place(row: Row) -> tuple:
    """Order of events; nulls first, as Spark sorts them."""
    return (row.ts is not None, row.ts, row.seq is not None, row.seq)


class Proposals(StatefulProcessor):
    """The proposals of one bucket: events in, judged events out."""

    def __init__(self, mode_on: bool) -> None:
        self.mode_on = mode_on
        self.texts = TEXTS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("proposals", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.state.get()
        states = {p[0]: tuple(p[1:]) for p in json.loads(held[0])} if held is not None else {}
        arrived = defaultdict(list)
        for row in rows:
            arrived[row.proposal_id].append(row)
        moved = False
        for pid, events in arrived.items():
            before = state = states.get(pid)
            for row in sorted(events, key=_place):
                first = row.action == "propose" and state is None
                if first:
                    state = ("pending", row.parse_ok, row.parse_error, row.facts)
                refusal = None if first else self._refusal(row, state)
                yield Row(
                    ts=row.ts, seq=row.seq, proposal_id=pid, action=row.action, actor=row.actor, reason=row.reason, confirm=row.confirm, error=row.error,
                    facts=state[3] if state else None, _known=state is not None, status_before=state[0] if state else None, refusal=refusal,
                )
                if refusal is None and state is not None:
                    status = {"approve": "approved", "reject": "rejected", "apply": "failed" if row.error is not None else "applied"}.get(row.action, state[0])
                    state = (status, *state[1:])
            if state != before:
                states[pid], moved = state, True
        if moved:
            self.state.update((json.dumps([[pid, *state] for pid, state in states.items()]),))

    def close(self) -> None:
        pass

    def _refusal(self, row: Row, state: tuple | None) -> str | None:
        pid, texts = row.proposal_id, self.texts
        status, parses, problem = state[:3] if state else (None, None, None)
        unknown = f"no proposal {pid}" if state is None else None
        if row.action == "approve":
            if not row.actor:
                return texts["NO_APPROVER"]
            if unknown:
                return unknown
            if not parses:
                return f"{pid} does not parse ({problem}); reject it instead"
            return None if status == "pending" else f"{pid} is {status}; can only approve from pending"
        if row.action == "reject":
            if not row.actor:
                return texts["NO_REJECTER"]
            if not row.stripped:
                return texts["NO_REASON"]
            return unknown or (None if status in ("pending", "approved") else f"{pid} is {status}; can only reject from pending, approved")
        if row.action == "apply":
            if unknown:
                return unknown
            if not row.confirm:
                return texts["NEEDS_CONFIRM"]
            if not parses:
                return f"{texts['DOES_NOT_PARSE']}: {problem}"
            if not row.still_parses:
                return texts["DOES_NOT_PARSE"]
            if self.mode_on:
                return None if status == "approved" else f"review mode is on and {pid} is {status}, not approved"
            return None if status in ("pending", "approved") else f"{pid} is {status}"
        return f"{pid} exists already" if row.action == "propose" else None


def _prepared(events: DataFrame) -> DataFrame:
    """Events with the checks that judging needs, made by expressions."""
    made = F.struct(
        F.col("_check.parse_error").isNull().alias("parse_ok"),
        F.col("_check.parse_error").alias("parse_error"),
        F.col("_check.destructive").alias("destructive"),
        F.col("_check.statement_types").alias("statement_types"),
        F.coalesce("source", F.lit("manual")).alias("_source"),
        F.col("confidence").alias("_confidence"),
    )
    proposes = F.col("action") == "propose"
    rows = events.withColumn("_check", F.when(proposes, sqlcheck.check(F.col("sql"))))
    return rows.select(
        F.col("ts").cast("timestamp").alias("ts"),
        *EVENT_COLUMNS[1:],
        strip(F.col("reason")).alias("stripped"),
        review.still_parses().alias("still_parses"),
        (proposes & F.col("_check.parse_error").isNull()).alias("parse_ok"),
        F.col("_check.parse_error").alias("parse_error"),
        F.when(proposes, F.to_json(made)).alias("facts"),
    )


EVENT_COLUMNS = tuple(part.split()[0] for part in EVENT.split(", "))


def judged_columns(rows: DataFrame) -> DataFrame:
    """Judged events with the columns of the batch fold's verdicts."""
    facts = F.from_json("facts", FACTS)
    return rows.withColumn("_facts", facts).select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), *EVENT_COLUMNS[1:], "_facts.*", "_known", "status_before", "refusal", F.col("refusal").isNull().alias("accepted")
    )


def append_verdicts(
    spark: SparkSession, events: str, out: str, checkpoint: str, mode_on: bool = True, files_per_batch: int | None = None
) -> StreamingQuery:
    """Judge the new events of a ledger table and append the verdicts."""
    reader = spark.readStream.schema(schemas.REVIEW_EVENT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stateful = (
        _prepared(reader.parquet(events))
        .withColumn("bucket", F.pmod(F.xxhash64("proposal_id"), F.lit(BUCKETS)))
        .groupBy("bucket")
        .transformWithState(statefulProcessor=Proposals(mode_on), outputStructType=JUDGED, outputMode="Append", timeMode="None")
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        judged_columns(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        return stateful.writeStream.foreachBatch(store).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)


def _event(action: str, reason: Column) -> Column:
    detail = F.struct("ts", "seq", "actor", reason.alias("reason"), "error")
    return F.min(F.when(F.col("accepted") & (F.col("action") == action), detail))


def state_from_verdicts(verdicts: DataFrame, events: DataFrame) -> DataFrame:
    """State of every proposal, from the judged events that took effect."""
    decided = verdicts.where(F.col("action").isin("approve", "reject", "apply")).groupBy("proposal_id").agg(
        _event("approve", F.col("reason")).alias("approved"),
        _event("reject", strip(F.col("reason"))).alias("rejected"),
        _event("apply", F.col("reason")).alias("applied"),
    )
    return review.state_of(review.proposals(events), decided)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
