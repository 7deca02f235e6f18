"""Recommendations: the heuristic one per group, and parsed model responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens import fixed, schemas
from worklens.functions.text import let, strip
from worklens.functions.variants import Field, document, facts, first_failure, shape_error

_RESPONSE_FIELDS = (
    "recommendation_id", "recommendation_type", "priority", "title", "rationale", "config_patch",
    "expected_effects", "risk_level", "risk_notes", "migration_sql", "rollback_sql",
    "confidence_score",
)
_EFFECTS = ("latency_improvement_percent", "cost_reduction_percent")


def top_by_impact(snapshots: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The snapshot with the highest impact (NULL counts as 0), one per group."""
    impact = F.coalesce(F.col("impact_score").cast("double"), F.lit(0.0))
    others = [c for c in snapshots.columns if c not in by]
    key = F.struct(-impact, "query_fingerprint", "snapshot_timestamp")
    return (
        snapshots.groupBy(*by)
        .agg(F.min_by(F.struct(*others), key).alias("top"))
        .select(*by, "top.*")
    )


def explain_sql(example: Column, query_type: Column) -> Column:
    """EXPLAIN text; only reads are analysed, because ANALYZE runs the statement."""
    body = F.rtrim(strip(example), F.lit(";"))
    read = F.upper(F.coalesce(query_type, F.lit(""))) == "SELECT"
    lead = F.when(read, fixed.EXPLAIN_READ).otherwise(fixed.EXPLAIN_PLAN)
    return F.when(
        F.coalesce(example != "", F.lit(False)), F.concat(lead, body, F.lit(";"))
    ).otherwise(fixed.HEALTH_SQL)


def register_recommender(name: str, recommender: Callable[[DataFrame, Column], DataFrame]) -> None:
    """Add a source of recommendations: a function of (snapshots, as_of) that returns recommendation rows."""
    _RECOMMENDERS[name] = recommender


def recommend(snapshots: DataFrame, as_of: Column, name: str = "heuristic") -> DataFrame:
    if name not in _RECOMMENDERS:
        raise ValueError(f"unknown recommender {name}; known are {', '.join(sorted(_RECOMMENDERS))}")
    return _RECOMMENDERS[name](snapshots, as_of)


def heuristic(snapshots: DataFrame, as_of: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """One reviewable recommendation per group; without snapshots a harmless health check."""
    top = top_by_impact(snapshots, by)
    usable = F.coalesce(F.col("example_query") != "", F.lit(False))
    sql = explain_sql(F.col("example_query"), F.col("query_type"))
    stamp = as_of.cast("timestamp_ntz")
    identity = F.concat_ws(
        "|", stamp.cast("string"), *[F.col(c).cast("string") for c in by],
        F.coalesce("query_fingerprint", F.lit("")), sql,
    )
    rows = top.select(
        *by,
        F.concat(F.lit("rec-"), F.substring(F.sha2(identity, 256), 1, 32)).alias("recommendation_id"),
        stamp.alias("recommendation_timestamp"),
        F.lit("pending").alias("status"),
        F.lit(fixed.DEFAULT_PRIORITY).alias("priority"),
        F.when(usable, "query_rewrite").otherwise(fixed.DEFAULT_TYPE).alias("recommendation_type"),
        F.when(
            usable,
            F.concat(F.lit(fixed.EXPLAIN_TITLE), F.coalesce("query_type", F.lit("None")), F.lit(")")),
        ).otherwise(fixed.HEALTH_TITLE).alias("title"),
        F.when(usable, fixed.EXPLAIN_RATIONALE).otherwise(fixed.HEALTH_RATIONALE).alias("rationale"),
        F.lit(fixed.STUB_PATCH).alias("config_patch"),
        F.lit("{}").alias("expected_effects"),
        F.lit("low").alias("risk_level"),
        sql.alias("migration_sql"),
        F.lit(fixed.STUB_ROLLBACK).alias("rollback_sql"),
        F.lit(fixed.STUB_MODEL).alias("model_name"),
        F.lit(fixed.STUB_VERSION).alias("model_version"),
        F.lit(fixed.STUB_CONFIDENCE).alias("confidence_score"),
    )
    if by:
        return rows
    return schemas.conform(rows, schemas.RECOMMENDATION)


def parse_responses(responses: DataFrame, as_of: Column, model_name: str, model_version: str) -> DataFrame:
    """Recommendation rows from model answers in ``response``; other columns are kept.

    The JSON object is what lies between the first ``{`` and the last ``}``. Unknown types
    and risk levels fall back to the defaults. ``reject_reason`` tells why a response
    gives no recommendation; its other columns are then meaningless.
    """
    body = F.regexp_extract("response", r"(?s)(\{.*\})", 1)
    digest = F.concat(F.lit("rec-"), F.substring(F.sha2("response", 256), 1, 32))

    def one_of(field: Field, allowed: tuple[str, ...], default: str) -> Column:
        return F.when(field.is_text & field.text.isin(*allowed), field.text).otherwise(default)

    def nested(doc: Column, field: Field, name: str) -> Column:
        value = F.to_json(doc[name])
        return F.when(field.missing, "{}").otherwise(value)

    def build(text: Column, doc: Column, known: Column) -> Column:
        rec_id, rec_id_ok = Field(known, "recommendation_id").text_or(digest)
        priority, priority_ok = Field(known, "priority").text_or(fixed.DEFAULT_PRIORITY)
        title, title_ok = Field(known, "title").text_or(fixed.DEFAULT_TITLE)
        rationale, rationale_ok = Field(known, "rationale").text_or("")
        patch, effects = Field(known, "config_patch"), Field(known, "expected_effects")
        kind, risk = Field(known, "recommendation_type"), Field(known, "risk_level")
        latency, latency_ok = Field(known, _EFFECTS[0]).optional_double()
        cost, cost_ok = Field(known, _EFFECTS[1]).optional_double()
        notes, notes_ok = Field(known, "risk_notes").optional_text()
        migration, migration_ok = Field(known, "migration_sql").optional_text()
        rollback, rollback_ok = Field(known, "rollback_sql").optional_text()
        confidence, confidence_ok = Field(known, "confidence_score").optional_double()
        checks = {
            "recommendation_id": rec_id_ok, "priority": priority_ok, "title": title_ok,
            "rationale": rationale_ok,
            "config_patch": patch.missing | patch.is_object,
            "expected_effects": effects.missing | effects.is_object,
            "recommendation_type": ~kind.is_nested, "risk_level": ~risk.is_nested,
            "latency improvement": latency_ok, "cost reduction": cost_ok,
            "confidence_score": confidence_ok, "risk_notes": notes_ok,
            "migration_sql": migration_ok, "rollback_sql": rollback_ok,
        }
        return F.struct(
            rec_id.alias("recommendation_id"),
            as_of.cast("timestamp_ntz").alias("recommendation_timestamp"),
            F.lit("pending").alias("status"),
            priority.alias("priority"),
            one_of(kind, fixed.RECOMMENDATION_TYPES, fixed.DEFAULT_TYPE).alias("recommendation_type"),
            title.alias("title"),
            rationale.alias("rationale"),
            nested(doc, patch, "config_patch").alias("config_patch"),
            nested(doc, effects, "expected_effects").alias("expected_effects"),
            latency.alias("expected_latency_improvement_percent"),
            cost.alias("expected_cost_reduction_percent"),
            one_of(risk, fixed.RISK_LEVELS, fixed.DEFAULT_RISK).alias("risk_level"),
            notes.alias("risk_notes"),
            migration.alias("migration_sql"),
            rollback.alias("rollback_sql"),
            F.lit(model_name).alias("model_name"),
            F.lit(model_version).alias("model_version"),
            confidence.alias("confidence_score"),
            F.when(text == "", "no JSON object")
            .otherwise(F.coalesce(shape_error(text, doc), first_failure(checks)))
            .alias("reject_reason"),
        )

    parsed = let(
        body,
        lambda text: let(
            document(text, _RESPONSE_FIELDS),
            lambda doc: let(facts(_response_values(doc)), lambda known: build(text, doc, known)),
        ),
    )
    return responses.withColumn("_row", parsed).select(*responses.columns, "_row.*")


def _response_values(doc: Column) -> dict[str, Column]:
    effects = doc["expected_effects"]
    return {
        **{n: doc[n] for n in _RESPONSE_FIELDS},
        **{n: F.try_variant_get(effects, f"$.{n}", "variant") for n in _EFFECTS},
    }


_RECOMMENDERS: dict[str, Callable[[DataFrame, Column], DataFrame]] = {"heuristic": heuristic}
