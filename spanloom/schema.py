"""Names and types of the versioned event envelope and of the tables made from it."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- Fixed values: field names of the envelope.
# Section -> text fields, in envelope order.
TEXT_FIELDS: dict[str, tuple[str, ...]] = {
    "source": ("kind", "name", "version"),
    "project": ("project_id", "repository", "root", "remote", "branch", "commit", "worktree"),
    "execution": (
        "trace_id", "span_id", "parent_event_id", "session_id", "workflow_id", "agent_id",
        "subagent_id", "parent_agent_id", "role", "skill", "lane", "task_id", "task_class",
    ),
    "llm": (
        "provider", "model", "model_family", "model_variant", "client", "auth_mode", "route",
        "reasoning_effort",
    ),
    "usage": ("source",),
    "reliability": ("status", "error_kind"),
    "outcome": ("kind", "status", "correlation_id", "correlation_basis", "evidence_source"),
    "provenance": ("adapter", "semantic_conventions", "content_capture"),
}

NUMBER_FIELDS: dict[str, tuple[str, ...]] = {
    "usage": (
        "input_tokens", "output_tokens", "cached_tokens", "cache_creation_tokens",
        "cache_read_tokens", "reasoning_tokens", "total_tokens", "cost", "context_size",
        "context_utilization", "compaction_count",
    ),
    "performance": (
        "latency_ms", "time_to_first_token_ms", "duration_ms", "tool_duration_ms",
        "session_duration_ms", "agent_duration_ms", "workflow_duration_ms", "wall_clock_ms",
        "concurrency", "parallel_utilization",
    ),
    "reliability": ("retry_count", "reassessment_count", "rework_count"),
    "behavior": (
        "tool_call_count", "files_inspected_count", "files_changed_count",
        "commands_executed_count", "tests_invoked_count",
    ),
}

FLAG_FIELDS: dict[str, tuple[str, ...]] = {
    "reliability": ("rate_limited", "timeout", "tool_failure", "agent_failure", "aborted"),
}

SECTIONS = (
    "source", "project", "execution", "llm", "usage", "performance", "reliability", "behavior",
    "outcome", "provenance",
)

# Value a text field takes when it is missing.
TEXT_DEFAULTS = {
    ("source", "kind"): "unknown",
    ("source", "name"): "unknown",
    ("project", "project_id"): "project:unknown",
    ("llm", "provider"): "unknown",
    ("llm", "model"): "unknown",
    ("llm", "client"): "unknown",
    ("llm", "auth_mode"): "unknown",
    ("llm", "route"): "unknown",
    ("usage", "source"): "unknown",
    ("reliability", "status"): "unknown",
    ("provenance", "adapter"): "unknown",
    ("provenance", "semantic_conventions"): "gen_ai.experimental",
    ("provenance", "content_capture"): "disabled",
}


def _section_type(section: str) -> T.StructType:
    fields = [T.StructField(n, T.StringType()) for n in TEXT_FIELDS.get(section, ())]
    fields += [T.StructField(n, T.DoubleType()) for n in NUMBER_FIELDS.get(section, ())]
    fields += [T.StructField(n, T.BooleanType()) for n in FLAG_FIELDS.get(section, ())]
    if section == "behavior":
        fields.append(T.StructField("tool_names", T.ArrayType(T.StringType())))
    if section == "provenance":
        fields.append(T.StructField("fields", T.MapType(T.StringType(), T.StringType())))
    return T.StructType(fields)


ENVELOPE = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("observed_at", T.TimestampType()),
        T.StructField("received_at", T.TimestampType()),
    ]
    + [T.StructField(s, _section_type(s)) for s in SECTIONS]
    + [T.StructField("attributes", T.StringType()), T.StructField("extensions", T.StringType())]
)

# Flat column -> envelope path. Column names differ from the path only where listed here.
RENAMED = {
    ("project", "commit"): "commit_sha",
    ("usage", "source"): "usage_source",
    ("outcome", "kind"): "outcome_kind",
    ("outcome", "status"): "outcome_status",
    ("source", "kind"): "source_kind",
    ("source", "name"): "source_name",
    ("source", "version"): "source_version",
}
_NOT_FLAT = {("project", "root"), ("project", "remote")}


def flat_columns() -> list[tuple[str, str]]:
    """(flat name, envelope path) for every column of the flat event table."""
    out = [(n, n) for n in ("event_id", "schema_version", "event_type", "observed_at", "received_at")]
    for section in SECTIONS:
        if section == "provenance":
            continue
        for group in (TEXT_FIELDS, NUMBER_FIELDS, FLAG_FIELDS):
            for name in group.get(section, ()):
                if (section, name) not in _NOT_FLAT:
                    out.append((RENAMED.get((section, name), name), f"{section}.{name}"))
    return out


STORE_TABLES = (
    "events", "ingest_ledger", "event_conflicts", "rejects", "measurement_facts",
    "outcome_events", "attribution_edges", "correlation_keys", "correlation_edges", "event_rollup",
    "maintenance_actions",
    "id_index", "id_filters",
)
