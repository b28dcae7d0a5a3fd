"""Summaries, top-N dimension breakdowns and comparisons over the flat event table.

Every function is one hash aggregation (partial before the shuffle, final after it); the
top-N ones end in a bounded take-ordered step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .filters import apply_filters, first_rows

# Statuses counted as success and as failure.
SUCCESS = ("ok", "success", "succeeded")
FAILURE = ("error", "failed", "failure")


def _count_where(test: Column) -> Column:
    return F.count(F.when(test, True))


def _filled(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0))


def _measures() -> dict[str, Column]:
    """Measure name -> aggregate. Sums and averages stay NULL without a value; counters are 0-filled."""
    out: dict[str, Column] = {
        "count": F.count("*"),
        "successes": _count_where(F.col("status").isin(*SUCCESS)),
        "failures": _count_where(F.col("status").isin(*FAILURE)),
    }
    for name in (
        "input_tokens", "output_tokens", "cached_tokens", "cache_creation_tokens",
        "cache_read_tokens", "reasoning_tokens", "total_tokens", "cost",
    ):
        out[name] = F.sum(name)
    out["compactions"] = F.sum("compaction_count")
    for name in (
        "latency_ms", "time_to_first_token_ms", "duration_ms", "context_size",
        "context_utilization", "concurrency", "parallel_utilization",
    ):
        out[f"average_{name}"] = F.avg(name)
    for name, column in {
        "retries": "retry_count", "reassessments": "reassessment_count",
        "rework_loops": "rework_count", "tool_calls": "tool_call_count",
        "files_inspected": "files_inspected_count", "files_changed": "files_changed_count",
        "commands_executed": "commands_executed_count", "tests_invoked": "tests_invoked_count",
    }.items():
        out[name] = _filled(column)
    for name, column in {
        "rate_limited": "rate_limited", "timeouts": "timeout", "tool_failures": "tool_failure",
        "agent_failures": "agent_failure", "aborted": "aborted",
    }.items():
        out[name] = _count_where(F.col(column))
    return out


def measures(*names: str) -> list[Column]:
    known = _measures()
    return [known[name].alias(name) for name in names]


SUMMARY_MEASURES = (
    "successes", "failures", "input_tokens", "output_tokens", "cached_tokens",
    "cache_creation_tokens", "cache_read_tokens", "reasoning_tokens", "compactions", "cost",
    "average_latency_ms", "average_time_to_first_token_ms", "average_duration_ms",
    "average_context_size", "average_context_utilization", "average_concurrency",
    "average_parallel_utilization", "retries", "rate_limited", "timeouts", "tool_failures",
    "agent_failures", "reassessments", "rework_loops", "tool_calls", "files_inspected",
    "files_changed", "commands_executed", "tests_invoked", "aborted",
)


def summary(events: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    """One row with the 33 headline measures.

    The two distinct counts are taken over the (project, provider, model) groups of a first
    aggregation, so no row is expanded per distinct measure.
    """
    rows = apply_filters(events, filters)
    averages = [n for n in SUMMARY_MEASURES if n.startswith("average_")]
    additive = [n for n in SUMMARY_MEASURES if n not in averages]
    parts = rows.groupBy("project_id", "provider", "model").agg(
        *measures("count", *additive),
        *[F.sum(n[8:]).alias(f"s_{n}") for n in averages],
        *[F.count(n[8:]).alias(f"n_{n}") for n in averages],
    )
    zero_filled = {"successes", "failures", "rate_limited", "timeouts", "tool_failures",
                   "agent_failures", "aborted"}
    columns = [F.coalesce(F.sum("count"), F.lit(0)).alias("events")]
    for name in SUMMARY_MEASURES:
        if name in averages:
            mean = F.try_divide(F.sum(f"s_{name}"), F.sum(f"n_{name}"))
            columns.append(mean.alias(name))
        elif name in zero_filled:
            columns.append(F.coalesce(F.sum(name), F.lit(0)).alias(name))
        elif name in ("retries", "reassessments", "rework_loops", "tool_calls",
                      "files_inspected", "files_changed", "commands_executed", "tests_invoked"):
            columns.append(F.coalesce(F.sum(name), F.lit(0.0)).alias(name))
        else:
            columns.append(F.sum(name).alias(name))
    pair = F.when(
        F.col("provider").isNotNull() & F.col("model").isNotNull(),
        F.concat_ws(":", "provider", "model"),
    )
    return parts.agg(
        *columns,
        F.count_distinct("project_id").alias("projects"),
        F.count_distinct(pair).alias("models"),
    )


def usage_sources(events: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    return apply_filters(events, filters).groupBy("usage_source").agg(*measures("count"))


def outcome_breakdown(
    outcomes: DataFrame, events: DataFrame, filters: dict[str, str] | None = None,
) -> DataFrame:
    """Outcomes of the filtered events by kind and status (a semi join on event_id)."""
    wanted = apply_filters(events, filters).select("event_id")
    return (
        outcomes.join(wanted, "event_id", "left_semi")
        .groupBy("kind", "status")
        .agg(*measures("count"))
    )


_UNKNOWN = "unknown"
_PROVIDER_KEYS = {
    "project": "project_id", "provider": "provider", "model": "model",
    "model_family": "model_family", "model_variant": "model_variant", "client": "client",
    "auth_mode": "auth_mode", "route": "route", "usage_source": "usage_source",
    "task_class": "task_class",
}
_PLACE_KEYS = {
    "event_type": "event_type", "project": "project_id", "repository": "repository",
    "branch": "branch",
}
_CONTEXT_KEYS = {
    **_PLACE_KEYS, "provider": "provider", "model": "model", "model_family": "model_family",
    "model_variant": "model_variant", "client": "client", "auth_mode": "auth_mode",
    "route": "route", "usage_source": "usage_source", "agent": "agent_id",
    "subagent": "subagent_id", "parent_agent": "parent_agent_id", "role": "role",
    "skill": "skill", "lane": "lane", "workflow": "workflow_id", "task_class": "task_class",
    "status": "status",
}
_PROVIDER_MEASURES = (
    "successes", "failures", "total_tokens", "cost", "average_latency_ms", "retries",
    "rate_limited", "timeouts", "tool_failures", "agent_failures", "reassessments",
    "rework_loops", "tool_calls", "files_inspected", "files_changed", "commands_executed",
    "tests_invoked",
)
_CONTEXT_MEASURES = (
    "input_tokens", "output_tokens", "cached_tokens", "reasoning_tokens", "total_tokens",
    "cache_creation_tokens", "cache_read_tokens", "compactions", "cost", "average_latency_ms",
    "average_time_to_first_token_ms", "average_duration_ms", "average_context_size",
    "average_context_utilization", "average_concurrency", "average_parallel_utilization",
    "retries", "rate_limited", "timeouts", "tool_failures", "agent_failures", "reassessments",
    "rework_loops", "tool_calls", "files_inspected", "files_changed", "commands_executed",
    "tests_invoked",
)

# name -> (label -> column, extra measures, only model operations, label a NULL as 'unknown')
DIMENSIONS: dict[str, tuple[dict[str, str], tuple[str, ...], bool, bool]] = {
    "provider_model": (_PROVIDER_KEYS, _PROVIDER_MEASURES, True, False),
    "usage_source": ({"source": "usage_source"}, (), True, False),
    "project": ({"project": "project_id"}, (), False, False),
    "client_route": (
        {"project": "project_id", "client": "client", "route": "route", "auth_mode": "auth_mode"},
        (), False, False,
    ),
    "execution": ({**_PLACE_KEYS, "role": "role", "skill": "skill", "lane": "lane"}, (), False, True),
    "workflow": ({**_PLACE_KEYS, "workflow": "workflow_id"}, (), False, True),
    "agent": (
        {**_PLACE_KEYS, "agent": "agent_id", "subagent": "subagent_id",
         "parent_agent": "parent_agent_id"},
        (), False, True,
    ),
    "context": (_CONTEXT_KEYS, _CONTEXT_MEASURES, False, True),
}


def dimension(
    events: DataFrame, name: str, limit: int | None = None, filters: dict[str, str] | None = None,
) -> DataFrame:
    """Groups of one breakdown; with a limit the top ones, by count and then by every key."""
    keys, extra, model_only, relabel = DIMENSIONS[name]
    rows = apply_filters(events, filters)
    if model_only:
        rows = rows.where(F.col("event_type") == "model.operation")
    # Group on the raw keys: a NULL and a real 'unknown' stay two groups with one label.
    groups = rows.groupBy(*[F.col(c).alias(f"key_{label}") for label, c in keys.items()]).agg(
        *measures("count", *extra)
    )
    return _top_groups(groups, keys, extra, LABEL_ORDER.get(name, ()), limit, relabel)


# Labels that break ties first, where that is not the order of the keys.
LABEL_ORDER = {
    "context": ("project", "repository", "branch", "provider", "model", "model_variant", "client"),
    "outcome": ("project", "repository", "branch"),
}


def _top_groups(
    groups: DataFrame, keys: dict[str, str], extra: tuple[str, ...], first: tuple[str, ...],
    limit: int | None, relabel: bool,
) -> DataFrame:
    """Largest groups; ties by label in order, then by raw key so that the order is total."""
    def shown(label: str) -> Column:
        missing = "uncorrelated" if label == "correlation_basis" else _UNKNOWN
        raw = F.col(f"key_{label}")
        return F.coalesce(raw, F.lit(missing)) if relabel else raw

    labels = [*first, *[label for label in keys if label not in first]]
    ranking = [F.desc("count"), *[shown(label).asc_nulls_first() for label in labels]]
    if relabel:
        ranking += [F.asc_nulls_first(f"key_{label}") for label in labels]
    top = first_rows(groups, limit, *ranking)
    return top.select(*[shown(label).alias(label) for label in keys], "count", *extra)


def outcome_dimension(outcomes: DataFrame, events: DataFrame, limit: int | None = None) -> DataFrame:
    """Outcome groups (the top ones with a limit) joined to the place their event happened in."""
    joined = outcomes.select(
        "event_id", "kind", "status", "correlation_basis", "evidence_source"
    ).join(events.select("event_id", "project_id", "repository", "branch"), "event_id")
    keys = {
        "kind": "kind", "status": "status", "correlation_basis": "correlation_basis",
        "evidence_source": "evidence_source", "project": "project_id",
        "repository": "repository", "branch": "branch",
    }
    groups = joined.groupBy(*[F.col(c).alias(f"key_{label}") for label, c in keys.items()]).agg(
        *measures("count")
    )
    return _top_groups(groups, keys, (), LABEL_ORDER["outcome"], limit, relabel=True)


COMPARISON_KEYS = (
    "provider", "model", "model_family", "model_variant", "client", "auth_mode", "route",
    "usage_source",
)
# Ties: the five keys most readers look at, then the rest so that the order is total.
COMPARISON_ORDER = (
    "provider", "model", "model_variant", "client", "usage_source", "model_family", "auth_mode",
    "route",
)
COMPARISON_MEASURES = (
    "successes", "failures", "input_tokens", "output_tokens", "cached_tokens",
    "reasoning_tokens", "total_tokens", "cost", "average_latency_ms", "retries", "rate_limited",
    "timeouts", "tool_failures", "agent_failures", "reassessments", "rework_loops",
)


def comparison(
    events: DataFrame, filters: dict[str, str] | None = None, limit: int | None = None,
) -> DataFrame:
    """Like-for-like provider/model/client rows; with a limit those of most events."""
    groups = apply_filters(events, filters).groupBy(*COMPARISON_KEYS).agg(
        *measures("count", *COMPARISON_MEASURES)
    )
    ranking = [F.desc("events"), *[F.asc_nulls_first(k) for k in COMPARISON_ORDER]]
    return first_rows(groups.withColumnRenamed("count", "events"), limit, *ranking)


def table_counts(ledger: DataFrame, facts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Row counts of the three projection tables, as (table_name, rows)."""
    parts = []
    for name, df in (("ledger", ledger), ("facts", facts), ("outcomes", outcomes)):
        parts.append(df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
