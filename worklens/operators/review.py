"""Review ledger: events in, proposal state and audit rows out.

Each proposal moves pending -> approved -> applied / failed, or to rejected from pending
or approved. Replaying events one by one would put all events of a proposal into one
task. It is not needed: once a proposal exists, its state at any moment follows from at
most three events - the first valid approval, the first valid rejection, and the first
valid application - and each of those is a minimum over ``(ts, seq)``, which is combined
on the map side. Where events have to see their proposal's row, the proposals are a
written table, so both sides of the join come from a shuffle that adaptive execution can
split: a proposal with very many events is spread, the others are copied nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens import fixed, schemas
from worklens.functions import sequences, sqlcheck
from worklens.functions.text import let, strip
from worklens.session import staged

def review_mode(config_value: bool | None = None, setting: str | None = None) -> bool:
    """Effective review mode: an explicit setting text wins over the config; default on."""
    if setting is not None and setting.strip() != "":
        return setting.strip().lower() not in fixed.MODE_OFF_WORDS
    return True if config_value is None else bool(config_value)


def checked(proposed: DataFrame) -> DataFrame:
    """Add parse result, destructive reasons and statement types for the column ``sql``."""
    return (
        proposed.withColumn("_check", sqlcheck.check(F.col("sql")))
        .select("*", "_check.*")
        .withColumn("parse_ok", F.col("parse_error").isNull())
        .drop("_check")
    )


def _order() -> Column:
    return F.struct("ts", "seq")


def proposals(events: DataFrame) -> DataFrame:
    """One checked row per proposal, from its first ``propose`` event."""
    columns = (
        "title", "sql", "current_sql", "confidence", "source", "recommendation_id", "target_db",
        "actor", "ts", "seq",
    )
    first = (
        events.filter(F.col("action") == "propose")
        .groupBy("proposal_id")
        .agg(F.min_by(F.struct(*columns), _order()).alias("p"))
        .select("proposal_id", "p.*")
    )
    return checked(first).select(
        "proposal_id", "title", "sql", "current_sql", "confidence",
        F.coalesce("source", F.lit("manual")).alias("source"), "recommendation_id",
        F.coalesce("target_db", F.lit("primary")).alias("target_db"),
        F.col("actor").alias("proposed_by"), "parse_ok", "parse_error", "destructive",
        "statement_types", F.col("ts").alias("created_at"), F.col("seq").alias("created_seq"),
    )


def _given(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def _with_proposal(events: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """Events with the row of their proposal."""
    return events.join(facts, "proposal_id", how)


def _valid(action: str) -> Column:
    """Event is acceptable in itself, leaving aside the state it meets."""
    parse_ok = F.col("parse_ok")
    rules = {
        "approve": _given(F.col("actor")) & parse_ok,
        "reject": _given(F.col("actor")) & _given(strip(F.col("reason"))),
        "apply": F.coalesce(F.col("confirm"), F.lit(False)) & parse_ok & still_parses(),
    }
    return (F.col("action") == action) & rules[action]


def still_parses() -> Column:
    """Result of the second check, made when a proposal is applied.

    An ``apply`` event that carries SQL says what is about to run, which may differ from what
    was checked when it was proposed. Without SQL the proposal's own, checked text runs.
    """
    again = (F.col("action") == "apply") & F.col("sql").isNotNull()
    return F.when(again, sqlcheck.check(F.col("sql"))["parse_error"].isNull()).otherwise(F.lit(True))


def decisions(events: DataFrame, proposed: DataFrame, mode_on: bool = True) -> DataFrame:
    """Per proposal the deciding events: ``approved``, ``rejected`` and ``applied`` structs.

    A struct is NULL when that step never happened.
    """
    facts = proposed.select(
        "proposal_id", "parse_ok", F.struct("created_at", "created_seq").alias("created")
    )
    acts = events.filter(F.col("action").isin("approve", "reject", "apply"))
    later = _order() > F.col("created")
    seen = _with_proposal(acts, facts).filter(later)
    detail = F.struct(
        "ts", "seq", "actor", strip(F.col("reason")).alias("reason"), "error"
    )
    raw_detail = F.struct("ts", "seq", "actor", "reason", "error")

    def first(action: str, value: Column = raw_detail, also: Column | None = None) -> Column:
        ok = _valid(action) if also is None else _valid(action) & also
        return F.min(F.when(ok, value))

    aggregates = [first("approve").alias("approve"), first("reject", detail).alias("reject")]
    if not mode_on:
        aggregates.append(first("apply").alias("apply"))
    firsts = seen.groupBy("proposal_id").agg(*aggregates)
    if mode_on:
        # An application counts only after the approval and before a rejection.
        gate = firsts.filter(F.col("approve").isNotNull()).select(
            "proposal_id",
            _at("approve").alias("_from"),
            F.when(F.col("reject").isNotNull(), _at("reject")).alias("_until"),
        ).filter(F.col("_until").isNull() | (F.col("_from") < F.col("_until")))
        tries = _with_proposal(
            acts.filter(F.col("action") == "apply"), staged(facts.join(gate, "proposal_id"), "gates")
        )
        inside = (_order() > F.col("_from")) & (
            F.col("_until").isNull() | (_order() < F.col("_until"))
        )
        applied = tries.groupBy("proposal_id").agg(first("apply", also=inside).alias("apply"))
        firsts = firsts.join(applied, "proposal_id", "left")
    # The earlier of rejection and application is final; an approval must come before it.
    reject_first = F.col("reject").isNotNull() & (
        F.col("apply").isNull() | (_at("reject") < _at("apply"))
    )
    final = F.when(reject_first, _at("reject")).when(F.col("apply").isNotNull(), _at("apply"))
    return (
        firsts.withColumns({"_final": final, "_reject_first": reject_first})
        .select(
            "proposal_id",
            F.when(
                F.col("approve").isNotNull()
                & (F.col("_final").isNull() | (_at("approve") < F.col("_final"))),
                F.col("approve"),
            ).alias("approved"),
            F.when(F.col("_reject_first"), F.col("reject")).alias("rejected"),
            F.when(~F.col("_reject_first"), F.col("apply")).alias("applied"),
        )
    )


def _at(event: str) -> Column:
    return F.struct(F.col(f"{event}.ts").alias("ts"), F.col(f"{event}.seq").alias("seq"))


def first_error_line(error: Column) -> Column:
    return F.substring(F.split(error, r"\r\n|\r|\n")[0], 1, 500)


def folded(events: DataFrame, mode_on: bool = True) -> tuple[DataFrame, DataFrame]:
    """Proposals and their deciding events, written once for results that need both."""
    proposed = staged(proposals(events), "proposals")
    return proposed, staged(decisions(events, proposed, mode_on), "decisions")


def proposal_state(events: DataFrame, mode_on: bool = True, fold: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Current state of every proposal, as the queue table stores it; ``fold`` as of :func:`folded`."""
    if fold is not None:
        return state_of(*fold)
    proposed = staged(proposals(events), "proposals")
    return state_of(proposed, decisions(events, proposed, mode_on))


def state_of(proposed: DataFrame, decided: DataFrame) -> DataFrame:
    joined = proposed.join(decided, "proposal_id", "left")
    approved, rejected, applied = F.col("approved"), F.col("rejected"), F.col("applied")
    error = first_error_line(applied["error"])
    reviewed = F.coalesce(rejected, approved)
    return joined.select(
        "proposal_id",
        F.when(rejected.isNotNull(), "rejected")
        .when(applied.isNotNull() & applied["error"].isNotNull(), "failed")
        .when(applied.isNotNull(), "applied")
        .when(approved.isNotNull(), "approved")
        .otherwise("pending")
        .alias("status"),
        "title", "sql", "current_sql", "confidence", "source", "recommendation_id", "target_db",
        "parse_ok", "parse_error", "destructive", "created_at", "created_seq",
        reviewed["actor"].alias("reviewed_by"),
        reviewed["ts"].alias("reviewed_at"),
        reviewed["reason"].alias("reason"),
        applied["actor"].alias("applied_by"),
        applied["ts"].alias("applied_at"),
        error.alias("apply_error"),
    )


def verdicts(events: DataFrame, mode_on: bool = True, fold: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Every event with the status it met, whether it took effect, and why not."""
    if fold is None:
        proposed = staged(proposals(events), "proposals")
        fold = proposed, decisions(events, proposed, mode_on)
    proposed, decided = fold
    facts = proposed.select(
        "proposal_id", "parse_ok", "parse_error", "destructive", "statement_types",
        F.col("source").alias("_source"), F.col("confidence").alias("_confidence"),
        F.struct(F.col("created_at").alias("ts"), F.col("created_seq").alias("seq")).alias("_created"),
    ).join(decided, "proposal_id", "left")
    rows = _with_proposal(events, staged(facts, "judged-proposals"), "left")
    now, pid, action = _order(), F.col("proposal_id"), F.col("action")

    def after(event: str) -> Column:
        return F.col(event).isNotNull() & (now > _at(event))

    known = F.coalesce(now >= F.col("_created"), F.lit(False))
    status = (
        F.when(~known, None)
        .when(after("rejected"), "rejected")
        .when(after("applied") & F.col("applied.error").isNotNull(), "failed")
        .when(after("applied"), "applied")
        .when(after("approved"), "approved")
        .otherwise("pending")
    )
    rows = rows.withColumns({"_known": known, "status_before": status})
    state = F.col("status_before")
    wrong_state = lambda verb, frm: F.concat(
        pid, F.lit(" is "), state, F.lit(f"; can only {verb} from {frm}")
    )
    no_actor = ~_given(F.col("actor"))
    refusal = (
        F.when(
            action == "approve",
            F.when(no_actor, fixed.NO_APPROVER)
            .when(~F.col("_known"), _unknown())
            .when(~F.col("parse_ok"), F.concat(pid, F.lit(" does not parse ("), "parse_error", F.lit("); reject it instead")))
            .when(state != "pending", wrong_state("approve", "pending")),
        )
        .when(
            action == "reject",
            F.when(no_actor, fixed.NO_REJECTER)
            .when(~_given(strip(F.col("reason"))), fixed.NO_REASON)
            .when(~F.col("_known"), _unknown())
            .when(~state.isin("pending", "approved"), wrong_state("reject", "pending, approved")),
        )
        .when(
            action == "apply",
            F.when(~F.col("_known"), _unknown()).otherwise(
                blocked_reason(pid, F.col("confirm"), F.col("parse_ok"), F.col("parse_error"), state, mode_on, still_parses())
            ),
        )
        .when((action == "propose") & (now != F.col("_created")), F.concat(pid, F.lit(" exists already")))
    )
    return rows.withColumn("refusal", refusal).withColumn("accepted", F.col("refusal").isNull())


def _unknown() -> Column:
    return F.concat(F.lit("no proposal "), F.col("proposal_id"))


def blocked_reason(
    proposal_id: Column, confirm: Column, parse_ok: Column, parse_error: Column, status: Column,
    mode_on: bool = True, still_parses: Column | None = None,
) -> Column:
    """Why an application is refused: the first rule that fails, NULL when it may run.

    ``parse_ok`` is the stored flag; ``still_parses`` the result of checking again.
    """
    blocked = F.when(~F.coalesce(confirm, F.lit(False)), fixed.NEEDS_CONFIRM).when(
        ~parse_ok, F.concat(F.lit(fixed.DOES_NOT_PARSE + ": "), parse_error)
    )
    if still_parses is not None:
        blocked = blocked.when(~still_parses, fixed.DOES_NOT_PARSE)
    if mode_on:
        return blocked.when(
            status != "approved",
            F.concat(F.lit("review mode is on and "), proposal_id, F.lit(" is "), status, F.lit(", not approved")),
        )
    return blocked.when(
        ~status.isin("pending", "approved"), F.concat(proposal_id, F.lit(" is "), status)
    )


def audit_log(events: DataFrame, mode_on: bool = True, fold: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Audit rows: every step that took effect, and every refused application."""
    return audit_rows(verdicts(events, mode_on, fold), mode_on)


def audit_rows(judged: DataFrame, mode_on: bool = True) -> DataFrame:
    """The audit rows of judged events, see :func:`verdicts`."""
    blocked = (F.col("action") == "apply") & F.col("_known") & ~F.col("accepted")
    failed = (F.col("action") == "apply") & F.col("accepted") & F.col("error").isNotNull()
    after = F.when(F.col("action") == "approve", "approved").otherwise("rejected")
    details = (
        F.when(
            F.col("action") == "propose",
            F.to_json(
                F.struct("parse_ok", "parse_error", "destructive", "statement_types",
                         F.col("_confidence").alias("confidence")),
                {"ignoreNullFields": "false"},
            ),
        )
        .when(
            blocked,
            F.to_json(
                F.struct(F.col("status_before").alias("status"), F.lit(mode_on).alias("review_mode"),
                         F.coalesce("confirm", F.lit(False)).alias("confirm"))
            ),
        )
        .when(
            F.col("action") == "apply",
            F.to_json(
                F.struct(F.col("status_before").alias("from"), F.lit(mode_on).alias("review_mode"),
                         "destructive")
            ),
        )
        .otherwise(F.to_json(F.struct(F.col("status_before").alias("from"), after.alias("to"))))
    )
    rows = judged.filter(F.col("accepted") | blocked).select(
        "ts", "seq", "proposal_id",
        F.when(blocked, "apply_blocked").when(failed, "apply_failed").otherwise(F.col("action")).alias("action"),
        F.when(
            (F.col("action") == "propose") & ~_given(F.col("actor")), F.col("_source")
        ).otherwise(F.col("actor")).alias("actor"),
        F.when(blocked, F.col("refusal"))
        .when(F.col("action") == "apply", first_error_line(F.col("error")))
        .when(F.col("action") == "reject", strip(F.col("reason")))
        .when(F.col("action") == "approve", F.col("reason"))
        .alias("reason"),
        details.alias("details"),
    )
    return schemas.conform(rows, schemas.REVIEW_AUDIT)


def audit_listing(audit: DataFrame, proposal_id: str | None = None, limit: int | None = 100) -> DataFrame:
    """Audit rows, newest first; all of them with ``limit=None``."""
    rows = audit if not proposal_id else audit.filter(F.col("proposal_id") == proposal_id)
    ordered = rows.orderBy(F.desc("ts"), F.desc("seq"))
    return ordered if limit is None else ordered.limit(limit)


def proposal_listing(state: DataFrame, status: str | None = None, limit: int | None = 50) -> DataFrame:
    """Proposals with their reviewer flags, newest first; all of them with ``limit=None``."""
    if status is not None and status not in fixed.STATUSES:
        raise ValueError(f"status must be one of {fixed.STATUSES}")
    rows = state if status is None else state.filter(F.col("status") == status)
    ordered = rows.orderBy(F.desc("created_at"), F.desc("created_seq"))
    shown = ordered if limit is None else ordered.limit(limit)
    return shown.withColumn("flags", sqlcheck.flags(F.col("parse_ok"), F.col("destructive")))


def proposal(state: DataFrame, proposal_id: str) -> DataFrame:
    return state.filter(F.col("proposal_id") == proposal_id)


def changes(proposed: DataFrame) -> DataFrame:
    """Proposals with a change flag and the clauses taken out and put in."""
    both = F.struct(
        sqlcheck.clauses(F.col("current_sql")).alias("old"), sqlcheck.clauses(F.col("sql")).alias("new")
    )
    return (
        proposed.withColumn("_clauses", both)
        .withColumns(
            {
                "changed": F.col("_clauses.old") != F.col("_clauses.new"),
                "removed_clauses": sqlcheck.without(F.col("_clauses.old"), F.col("_clauses.new")),
                "added_clauses": sqlcheck.without(F.col("_clauses.new"), F.col("_clauses.old")),
            }
        )
        .drop("_clauses")
    )


def clause_changes(proposed: DataFrame) -> DataFrame:
    """Proposals with the clauses that were kept, moved, removed and added, by their order."""
    both = F.struct(sqlcheck.clauses(F.col("current_sql")).alias("old"), sqlcheck.clauses(F.col("sql")).alias("new"))
    told = let(both, lambda c: sequences.changes(c["old"], c["new"]))
    return proposed.withColumn("_told", told).select("*", *[F.col(f"_told.{n}").alias(f"{n}_clauses") for n in ("kept", "moved", "removed", "added")]).drop("_told")


def enqueue(recommendations: DataFrame, target_db: str = "primary") -> DataFrame:
    """``propose`` events for the migration SQL of recommendations.

    The proposal id follows from the recommendation id, so a retried run queues nothing
    twice.
    """
    rows = recommendations.filter(_given(F.col("migration_sql"))).select(
        F.col("recommendation_timestamp").alias("ts"),
        F.lit(0).cast("bigint").alias("seq"),
        F.concat(F.lit("pw-"), F.substring(F.sha2("recommendation_id", 256), 1, 12)).alias("proposal_id"),
        F.lit("propose").alias("action"),
        F.col("migration_sql").alias("sql"),
        "title",
        F.col("confidence_score").alias("confidence"),
        F.get_json_object("config_patch", "$.current_sql").alias("current_sql"),
        F.lit(fixed.ARCHITECT_SOURCE).alias("source"),
        "recommendation_id",
        F.lit(target_db).alias("target_db"),
    )
    return schemas.conform(rows, schemas.REVIEW_EVENT)
