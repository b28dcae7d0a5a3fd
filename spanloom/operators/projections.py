"""Projections of the event table: measurement facts, outcome rows and hierarchy edges.

All three are narrow per-row expansions of the event table: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .filters import first_rows, point_lookup

# Measured field path -> (flat column, unit).
MEASUREMENTS: dict[str, tuple[str, str]] = {
    "usage.input_tokens": ("input_tokens", "tokens"),
    "usage.output_tokens": ("output_tokens", "tokens"),
    "usage.cached_tokens": ("cached_tokens", "tokens"),
    "usage.cache_creation_tokens": ("cache_creation_tokens", "tokens"),
    "usage.cache_read_tokens": ("cache_read_tokens", "tokens"),
    "usage.reasoning_tokens": ("reasoning_tokens", "tokens"),
    "usage.total_tokens": ("total_tokens", "tokens"),
    "usage.cost": ("cost", "cost"),
    "usage.context_size": ("context_size", "tokens"),
    "usage.context_utilization": ("context_utilization", "ratio"),
    "usage.compaction_count": ("compaction_count", "count"),
    "performance.latency_ms": ("latency_ms", "ms"),
    "performance.time_to_first_token_ms": ("time_to_first_token_ms", "ms"),
    "performance.duration_ms": ("duration_ms", "ms"),
    "performance.tool_duration_ms": ("tool_duration_ms", "ms"),
    "performance.session_duration_ms": ("session_duration_ms", "ms"),
    "performance.agent_duration_ms": ("agent_duration_ms", "ms"),
    "performance.workflow_duration_ms": ("workflow_duration_ms", "ms"),
    "performance.wall_clock_ms": ("wall_clock_ms", "ms"),
    "performance.concurrency": ("concurrency", "workers"),
    "performance.parallel_utilization": ("parallel_utilization", "ratio"),
    "reliability.retry_count": ("retry_count", "attempts"),
    "reliability.agent_failure": ("agent_failure", "flag"),
    "reliability.reassessment_count": ("reassessment_count", "count"),
    "reliability.rework_count": ("rework_count", "count"),
    "behavior.tool_call_count": ("tool_call_count", "count"),
    "behavior.files_inspected_count": ("files_inspected_count", "count"),
    "behavior.files_changed_count": ("files_changed_count", "count"),
    "behavior.commands_executed_count": ("commands_executed_count", "count"),
    "behavior.tests_invoked_count": ("tests_invoked_count", "count"),
}

# Evidence classes kept as they are, and sources that count as reported.
OWN_QUALITY = ("observed", "reported", "inferred", "estimated", "derived")
REPORTERS = ("provider", "client", "gateway")


def evidence_quality(source: Column) -> Column:
    return (
        F.when(source.isin(*OWN_QUALITY), source)
        .when(source.isin(*REPORTERS), F.lit("reported"))
        .otherwise(F.lit("unknown"))
    )


def _stated(fields: Column, key: str | Column) -> Column:
    return F.nullif(F.try_element_at(fields, F.lit(key) if isinstance(key, str) else key), F.lit(""))


def measurement_facts(events: DataFrame) -> DataFrame:
    """Long form: one row per event and measured field that has a value.

    The values are spread as one plain array; path, unit and evidence are looked up only for the
    entries that have a value.
    """
    values = F.array(*[F.col(column).cast("double") for column, _ in MEASUREMENTS.values()])
    rows = events.select(
        "event_id", "observed_at", "received_at", "usage_source", "provenance_fields",
        F.posexplode(values).alias("at", "value"),
    ).where(F.col("value").isNotNull())

    def looked_up(entries: list[str]) -> Column:
        return F.get(F.array(*[F.lit(e) for e in entries]), F.col("at"))

    sections = [path.split(".")[0] for path in MEASUREMENTS]
    rows = rows.select(
        "event_id", "observed_at", "received_at", "value", "usage_source", "provenance_fields",
        looked_up(list(MEASUREMENTS)).alias("field_path"),
        looked_up([unit for _, unit in MEASUREMENTS.values()]).alias("unit"),
        looked_up(sections).alias("section"),
    )
    # Who reported it: the field's own entry, its section's entry, else the default.
    usage_default = F.when(F.col("section") == "usage", F.nullif(F.col("usage_source"), F.lit("")))
    fields = F.col("provenance_fields")
    source = F.coalesce(
        _stated(fields, F.col("field_path")), _stated(fields, F.col("section")), usage_default,
        F.lit("unknown"),
    )
    return rows.withColumn("evidence_source", source).select(
        "event_id", "field_path", "value", "unit",
        F.concat(F.lit("evidence:"), "event_id", F.lit(":"), "field_path").alias("evidence_id"),
        "evidence_source",
        evidence_quality(F.col("evidence_source")).alias("evidence_quality"),
        "observed_at", "received_at",
    )


def outcome_events(events: DataFrame) -> DataFrame:
    """One row per event that states any outcome field."""
    stated = F.coalesce("outcome_kind", "outcome_status", "correlation_id", "correlation_basis")
    return events.where(stated.isNotNull()).select(
        "event_id",
        F.col("outcome_kind").alias("kind"),
        F.col("outcome_status").alias("status"),
        "correlation_id", "correlation_basis",
        F.coalesce("evidence_source", F.lit("unknown")).alias("evidence_source"),
        "observed_at", "received_at",
    )


def fact_listing(facts: DataFrame, event_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Facts of all events or of one; with a limit the first by time, id and path."""
    rows = facts if event_id is None else point_lookup(facts, event_id)
    return first_rows(rows, limit, "observed_at", "event_id", "field_path")


def outcome_listing(outcomes: DataFrame, event_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Outcomes of all events or of one; with a limit the first by time and id."""
    rows = outcomes if event_id is None else point_lookup(outcomes, event_id)
    return first_rows(rows, limit, "observed_at", "event_id")


def relation_evidence(relation: Column) -> Column:
    fields = F.col("provenance_fields")
    own = F.concat(F.lit("execution."), relation)
    return F.coalesce(_stated(fields, own), _stated(fields, "execution"), F.lit("unknown"))


# Relation -> column that holds its target.
HIERARCHY = {
    "project": "project_id",
    "parent_event": "parent_event_id",
    "session": "session_id",
    "workflow": "workflow_id",
    "agent": "agent_id",
    "subagent": "subagent_id",
    "parent_agent": "parent_agent_id",
}


def hierarchy_edges(events: DataFrame) -> DataFrame:
    """Up to seven edges per event, to its project, parent event, session, workflow and agents.

    Each relation appears once per event, so (child, relation, target) is unique by construction.
    """
    targets = F.array(*[F.col(column) for column in HIERARCHY.values()])
    rows = events.select(
        "event_id", "observed_at", "received_at", "provenance_fields",
        F.posexplode(targets).alias("at", "target_id"),
    ).where(F.col("target_id").isNotNull())
    rows = rows.withColumn(
        "relation", F.get(F.array(*[F.lit(r) for r in HIERARCHY]), F.col("at"))
    )
    return rows.select(
        F.col("event_id").alias("child_event_id"),
        F.when(F.col("relation") == "parent_event", F.col("target_id")).alias("parent_event_id"),
        "relation", "target_id",
        relation_evidence(F.col("relation")).alias("evidence_source"),
        "observed_at", "received_at",
    )
