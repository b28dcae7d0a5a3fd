"""The 81 event-time metric families."""

from __future__ import annotations

from dataclasses import dataclass

from .aggregates import FAILURE, SUCCESS

UNKNOWN = "unknown"

# Label -> (column, value of a missing label) on the event table.
EVENT_LABELS: dict[str, tuple[str, str]] = {
    "event_type": ("event_type", UNKNOWN),
    "project": ("project_id", UNKNOWN),
    "repository": ("repository", UNKNOWN),
    "branch": ("branch", UNKNOWN),
    "provider": ("provider", UNKNOWN),
    "model": ("model", UNKNOWN),
    "model_family": ("model_family", UNKNOWN),
    "model_variant": ("model_variant", UNKNOWN),
    "client": ("client", UNKNOWN),
    "auth_mode": ("auth_mode", UNKNOWN),
    "route": ("route", UNKNOWN),
    "usage_source": ("usage_source", UNKNOWN),
    "agent": ("agent_id", UNKNOWN),
    "subagent": ("subagent_id", UNKNOWN),
    "parent_agent": ("parent_agent_id", UNKNOWN),
    "role": ("role", UNKNOWN),
    "skill": ("skill", UNKNOWN),
    "lane": ("lane", UNKNOWN),
    "workflow": ("workflow_id", UNKNOWN),
    "task_class": ("task_class", UNKNOWN),
    "status": ("status", UNKNOWN),
}
OUTCOME_LABELS: dict[str, tuple[str, str]] = {
    "kind": ("kind", UNKNOWN),
    "status": ("status", UNKNOWN),
    "evidence_source": ("evidence_source", UNKNOWN),
    "project": ("project_id", UNKNOWN),
    "repository": ("repository", UNKNOWN),
    "branch": ("branch", UNKNOWN),
    "correlation_basis": ("correlation_basis", "uncorrelated"),
}

NO_LABELS: tuple[str, ...] = ()
PROVIDER_LABELS = (
    "project", "provider", "model", "model_family", "model_variant", "client", "auth_mode",
    "route", "usage_source", "task_class",
)
CONTEXT_LABELS = tuple(EVENT_LABELS)


@dataclass(frozen=True)
class Family:
    """``value`` is the column that sum, avg and flag read; ``only`` keeps rows by column value."""

    name: str
    labels: tuple[str, ...]
    aggregate: str  # count, sum, avg, flag, ratio
    value: str | None = None
    only: tuple[str, tuple] | None = None
    source: str = "events"  # events, conflicts, outcomes

    @property
    def label_columns(self) -> dict[str, tuple[str, str]]:
        return OUTCOME_LABELS if self.source == "outcomes" else EVENT_LABELS


def _build() -> dict[str, Family]:
    families: list[Family] = [
        Family("events_total", NO_LABELS, "count"),
        Family("event_successes_total", NO_LABELS, "count", only=("status", SUCCESS)),
        Family("event_failures_total", NO_LABELS, "count", only=("status", FAILURE)),
        Family("event_conflicts_total", NO_LABELS, "count", source="conflicts"),
    ]
    # Overall counts of rows where a flag is set.
    for name, flag in (
        ("rate_limited_total", "rate_limited"),
        ("timeouts_total", "timeout"),
        ("tool_failures_total", "tool_failure"),
        ("agent_failures_total", "agent_failure"),
    ):
        families.append(Family(name, NO_LABELS, "count", only=(flag, (True,))))
    # Overall sums.
    for name, column in (
        ("retries_total", "retry_count"),
        ("input_tokens_total", "input_tokens"),
        ("output_tokens_total", "output_tokens"),
        ("cached_tokens_total", "cached_tokens"),
        ("cache_creation_tokens_total", "cache_creation_tokens"),
        ("cache_read_tokens_total", "cache_read_tokens"),
        ("reasoning_tokens_total", "reasoning_tokens"),
        ("compactions_total", "compaction_count"),
        ("cost_total", "cost"),
        ("tool_calls_total", "tool_call_count"),
        ("files_inspected_total", "files_inspected_count"),
        ("files_changed_total", "files_changed_count"),
        ("commands_executed_total", "commands_executed_count"),
        ("tests_invoked_total", "tests_invoked_count"),
        ("reassessments_total", "reassessment_count"),
        ("rework_loops_total", "rework_count"),
    ):
        families.append(Family(name, NO_LABELS, "sum", column))
    # Overall averages.
    for name, column in (
        ("latency_average_ms", "latency_ms"),
        ("time_to_first_token_average_ms", "time_to_first_token_ms"),
        ("duration_average_ms", "duration_ms"),
        ("context_size_average", "context_size"),
        ("context_utilization_average", "context_utilization"),
        ("concurrency_average", "concurrency"),
        ("parallel_utilization_average", "parallel_utilization"),
    ):
        families.append(Family(name, NO_LABELS, "avg", column))
    # Per provider and model, over model operations only.
    for name, aggregate, column in (
        ("events_by_provider_model_total", "count", None),
        ("success_rate_by_provider_model", "ratio", None),
        ("tokens_by_provider_model_total", "sum", "total_tokens"),
        ("cost_by_provider_model", "sum", "cost"),
        ("latency_average_by_provider_model_ms", "avg", "latency_ms"),
        ("retries_by_provider_model_total", "sum", "retry_count"),
        ("rate_limited_by_provider_model_total", "flag", "rate_limited"),
        ("timeouts_by_provider_model_total", "flag", "timeout"),
        ("tool_failures_by_provider_model_total", "flag", "tool_failure"),
        ("agent_failures_by_provider_model_total", "flag", "agent_failure"),
        ("reassessments_by_provider_model_total", "sum", "reassessment_count"),
        ("rework_loops_by_provider_model_total", "sum", "rework_count"),
        ("tool_calls_by_provider_model_total", "sum", "tool_call_count"),
        ("files_changed_by_provider_model_total", "sum", "files_changed_count"),
    ):
        families.append(
            Family(name, PROVIDER_LABELS, aggregate, column,
                   only=("event_type", ("model.operation",)))
        )
    # Per full context.
    for name, aggregate, column in (
        ("events_by_context_total", "count", None),
        ("input_tokens_by_context_total", "sum", "input_tokens"),
        ("output_tokens_by_context_total", "sum", "output_tokens"),
        ("cached_tokens_by_context_total", "sum", "cached_tokens"),
        ("reasoning_tokens_by_context_total", "sum", "reasoning_tokens"),
        ("tokens_by_context_total", "sum", "total_tokens"),
        ("cache_creation_tokens_by_context_total", "sum", "cache_creation_tokens"),
        ("cache_read_tokens_by_context_total", "sum", "cache_read_tokens"),
        ("compactions_by_context_total", "sum", "compaction_count"),
        ("cost_by_context", "sum", "cost"),
        ("latency_average_by_context_ms", "avg", "latency_ms"),
        ("time_to_first_token_average_by_context_ms", "avg", "time_to_first_token_ms"),
        ("duration_average_by_context_ms", "avg", "duration_ms"),
        ("context_size_average_by_context", "avg", "context_size"),
        ("context_utilization_average_by_context", "avg", "context_utilization"),
        ("concurrency_average_by_context", "avg", "concurrency"),
        ("parallel_utilization_average_by_context", "avg", "parallel_utilization"),
        ("retries_by_context_total", "sum", "retry_count"),
        ("rate_limited_by_context_total", "flag", "rate_limited"),
        ("timeouts_by_context_total", "flag", "timeout"),
        ("tool_failures_by_context_total", "flag", "tool_failure"),
        ("agent_failures_by_context_total", "flag", "agent_failure"),
        ("reassessments_by_context_total", "sum", "reassessment_count"),
        ("rework_loops_by_context_total", "sum", "rework_count"),
        ("tool_calls_by_context_total", "sum", "tool_call_count"),
        ("files_inspected_by_context_total", "sum", "files_inspected_count"),
        ("files_changed_by_context_total", "sum", "files_changed_count"),
        ("commands_executed_by_context_total", "sum", "commands_executed_count"),
        ("tests_invoked_by_context_total", "sum", "tests_invoked_count"),
    ):
        families.append(Family(name, CONTEXT_LABELS, aggregate, column))
    # Plain counts by a few labels.
    place = ("event_type", "project", "repository", "branch")
    for name, labels in (
        ("events_by_usage_source_total", ("usage_source",)),
        ("events_by_project_total", ("project",)),
        ("events_by_client_route_total", ("project", "client", "route", "auth_mode")),
        ("events_by_execution_total", (*place, "role", "skill", "lane")),
        ("events_by_workflow_total", (*place, "workflow")),
        ("events_by_agent_total", (*place, "agent", "subagent", "parent_agent")),
    ):
        families.append(Family(name, labels, "count"))
    families.append(
        Family("outcomes_by_kind_status_total", tuple(OUTCOME_LABELS), "count", source="outcomes")
    )
    return {family.name: family for family in families}


FAMILIES = _build()
LABEL_NAMES = tuple(sorted({"__name__", *(l for f in FAMILIES.values() for l in f.labels)}))
