"""Saved report queries: fixed compositions of the series operators.

User filters are whole-value patterns per label; a report applies those that its family knows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import series as S
from ..operators.families import FAMILIES

# Status sets the reports use.
SUCCEEDED = "success|succeeded|ok"
NOT_SUCCEEDED = "failed|failure|error|rejected|timeout|aborted"
OUTCOME_PASSED = "pass|passed|success|succeeded|accepted|complete|completed"
OUTCOME_FAILED = "fail|failed|failure|error|aborted|rejected|timeout"
OPERATIONS = "model.operation|tool.operation"

HIERARCHY = ("parent_agent", "agent", "subagent")
MODEL_LABELS = (
    "provider", "model", "model_family", "model_variant", "client", "auth_mode", "route",
    "usage_source", "task_class",
)


@dataclass
class Context:
    spark: SparkSession
    tables: dict[str, DataFrame]
    grid: S.Grid
    filters: dict[str, str] = field(default_factory=dict)

    def leaf(self, family: str, *fixed: S.Matcher) -> S.SeriesSet:
        labels = FAMILIES[family].labels
        user = [S.matches(l, p) for l, p in self.filters.items() if l in labels and p != ".*"]
        return S.series(family, self.tables, self.grid, *fixed, *user)

    def zero(self) -> S.SeriesSet:
        return S.zero_vector(self.spark, self.grid)


Build = Callable[[Context], S.SeriesSet]


@dataclass(frozen=True)
class Report:
    name: str
    board: str
    title: str
    build: Build
    spec: tuple = ()


def _build(spec: tuple) -> Build:
    """spec is (operator, argument, family, fixed matchers); see ``REPORTS``."""
    op, arg, family, fixed = spec

    def run(ctx: Context) -> S.SeriesSet:
        rows = ctx.leaf(family, *fixed)
        if op == "series":
            return rows
        if op == "topk":
            return rows.topk(arg)
        if op == "sum_or_zero":
            return rows.sum().or_else(ctx.zero())
        if op == "or_zero":
            return rows.or_else(ctx.zero())
        if op == "share":
            by, part, whole = arg
            top = ctx.leaf(family, *fixed, part).sum(*by)
            return top.divide(ctx.leaf(family, *fixed, whole).sum(*by))
        return rows.agg(op, arg)

    return run


_MODEL = (S.eq("event_type", "model.operation"),)
_FAILED = (S.matches("status", NOT_SUCCEEDED),)
_CTX = "events_by_context_total"

# name, board, title, (operator, argument, family, fixed matchers)
REPORTS: dict[str, Report] = {
    name: Report(name, board, title, _build(spec), spec)
    for name, board, title, spec in (
        ("hierarchy_volume", "agent-hierarchy", "Agent hierarchy volume",
         ("topk", 50, "events_by_agent_total", ())),
        ("hierarchy_tool_calls", "agent-hierarchy", "Agent behavior",
         ("sum", HIERARCHY, "tool_calls_by_context_total", ())),
        ("hierarchy_files_changed", "agent-hierarchy", "Agent behavior",
         ("sum", HIERARCHY, "files_changed_by_context_total", ())),
        ("hierarchy_commands", "agent-hierarchy", "Agent behavior",
         ("sum", HIERARCHY, "commands_executed_by_context_total", ())),
        ("hierarchy_tests", "agent-hierarchy", "Agent behavior",
         ("sum", HIERARCHY, "tests_invoked_by_context_total", ())),
        ("hierarchy_agent_failures", "agent-hierarchy", "Failures and rework by hierarchy",
         ("sum", HIERARCHY, "agent_failures_by_context_total", ())),
        ("hierarchy_rework", "agent-hierarchy", "Failures and rework by hierarchy",
         ("sum", HIERARCHY, "rework_loops_by_context_total", ())),
        ("efficiency_input_tokens", "efficiency", "Input tokens",
         ("sum_or_zero", None, "input_tokens_by_context_total", ())),
        ("efficiency_output_tokens", "efficiency", "Output tokens",
         ("sum_or_zero", None, "output_tokens_by_context_total", ())),
        ("efficiency_cached_tokens", "efficiency", "Cached tokens",
         ("sum_or_zero", None, "cached_tokens_by_context_total", ())),
        ("efficiency_cache_read_tokens", "efficiency", "Cache-read tokens",
         ("sum_or_zero", None, "cache_read_tokens_by_context_total", ())),
        ("efficiency_context_size", "efficiency", "Context size (avg)",
         ("avg", (), "context_size_average_by_context", ())),
        ("efficiency_context_utilization", "efficiency", "Context utilization (avg)",
         ("avg", (), "context_utilization_average_by_context", ())),
        ("efficiency_time_to_first_token", "efficiency", "Time to first token (ms)",
         ("avg", (), "time_to_first_token_average_by_context_ms", ())),
        ("efficiency_duration", "efficiency", "Duration (ms)",
         ("avg", (), "duration_average_by_context_ms", ())),
        ("efficiency_concurrency", "efficiency", "Concurrency (avg)",
         ("avg", (), "concurrency_average_by_context", ())),
        ("efficiency_parallel_utilization", "efficiency", "Parallel utilization (avg)",
         ("avg", (), "parallel_utilization_average_by_context", ())),
        ("efficiency_usage_evidence", "efficiency", "Usage evidence classes",
         ("sum", ("usage_source",), _CTX, ())),
        ("efficiency_volume", "efficiency", "Model operation volume", ("topk", 30, _CTX, ())),
        ("efficiency_ttft_by_context", "efficiency", "TTFT by model execution context",
         ("topk", 30, "time_to_first_token_average_by_context_ms", ())),
        ("efficiency_duration_by_context", "efficiency", "Duration by model execution context",
         ("topk", 30, "duration_average_by_context_ms", ())),
        ("efficiency_compactions_by_context", "efficiency", "Compactions by model execution context",
         ("topk", 30, "compactions_by_context_total", ())),
        ("efficiency_parallel_by_context", "efficiency",
         "Parallel utilization by model execution context",
         ("topk", 30, "parallel_utilization_average_by_context", ())),
        ("execution_volume", "execution-explorer", "Execution role/skill/lane volume",
         ("topk", 50, "events_by_execution_total", ())),
        ("execution_client_routes", "execution-explorer", "Client route/auth volume",
         ("topk", 50, "events_by_client_route_total", ())),
        ("execution_tool_calls", "execution-explorer", "Agent behavior counts",
         ("series", None, "tool_calls_by_context_total", ())),
        ("execution_files_changed", "execution-explorer", "Agent behavior counts",
         ("series", None, "files_changed_by_context_total", ())),
        ("execution_commands", "execution-explorer", "Agent behavior counts",
         ("series", None, "commands_executed_by_context_total", ())),
        ("execution_tests", "execution-explorer", "Agent behavior counts",
         ("series", None, "tests_invoked_by_context_total", ())),
        ("global_events", "global", "Observed events", ("sum", (), _CTX, ())),
        ("global_succeeded", "global", "Successful operations",
         ("sum", (), _CTX, (S.matches("event_type", OPERATIONS), S.matches("status", SUCCEEDED)))),
        ("global_failed", "global", "Failed operations",
         ("sum", (), _CTX,
          (S.matches("event_type", OPERATIONS), S.matches("status", NOT_SUCCEEDED)))),
        ("global_conflicts", "global", "Conflicting replays",
         ("or_zero", None, "event_conflicts_total", ())),
        ("global_operations", "global", "Observed operations by provider and model",
         ("topk", 20, _CTX, ())),
        ("global_usage_evidence", "global", "Usage evidence classes",
         ("sum", ("usage_source",), _CTX, ())),
        ("model_operations_observed", "model-comparison", "Observed model operations",
         ("sum", (), _CTX, _MODEL)),
        ("model_operations", "model-comparison", "Observed operations", ("sum", (), _CTX, _MODEL)),
        ("model_operations_by_evidence", "model-comparison", "Operations by evidence source",
         ("sum", ("usage_source",), _CTX, _MODEL)),
        ("model_volume", "model-comparison", "Provider/model volume", ("topk", 30, _CTX, _MODEL)),
        ("model_client_routes", "model-comparison", "Client route and auth",
         ("topk", 20, _CTX, _MODEL)),
        ("model_success_ratio", "model-comparison", "Success ratio by model and evidence source",
         ("share", (MODEL_LABELS, S.matches("status", SUCCEEDED), S.matches("status", ".+")),
          _CTX, _MODEL)),
        ("model_tokens", "model-comparison", "Tokens by model and evidence source",
         ("topk", 30, "tokens_by_context_total", _MODEL)),
        ("model_cost", "model-comparison", "Reported cost by execution context and evidence",
         ("topk", 30, "cost_by_context", _MODEL)),
        ("model_latency", "model-comparison", "Average latency by execution context and evidence",
         ("topk", 30, "latency_average_by_context_ms", _MODEL)),
        ("outcomes_correlated", "outcome-analysis", "Correlated outcomes",
         ("sum_or_zero", None, "outcomes_by_kind_status_total", ())),
        ("outcomes_passed", "outcome-analysis", "Passed outcome observations",
         ("sum", (), "outcomes_by_kind_status_total", (S.matches("status", OUTCOME_PASSED),))),
        ("outcomes_failed", "outcome-analysis", "Failed outcome observations",
         ("sum", (), "outcomes_by_kind_status_total", (S.matches("status", OUTCOME_FAILED),))),
        ("outcomes_by_kind", "outcome-analysis", "Tests/builds/CI/review outcomes",
         ("series", None, "outcomes_by_kind_status_total", ())),
        ("outcomes_execution", "outcome-analysis", "Observed execution dimensions",
         ("topk", 30, "events_by_execution_total", ())),
        ("project_volume", "project-view", "Project event volume",
         ("sum", (), "events_by_project_total", ())),
        ("project_count", "project-view", "Projects in scope",
         ("count", (), "events_by_project_total", ())),
        ("project_conflicts", "project-view", "Conflicting replays",
         ("or_zero", None, "event_conflicts_total", ())),
        ("project_client_routes", "project-view", "Project volume by client route",
         ("topk", 20, "events_by_client_route_total", ())),
        ("reliability_failed", "reliability", "Failed operations",
         ("sum_or_zero", None, _CTX, _FAILED)),
        ("reliability_retries", "reliability", "Retry attempts",
         ("sum_or_zero", None, "retries_by_context_total", ())),
        ("reliability_rate_limited", "reliability", "Rate-limited operations",
         ("sum_or_zero", None, "rate_limited_by_context_total", ())),
        ("reliability_timeouts", "reliability", "Timeout operations",
         ("sum_or_zero", None, "timeouts_by_context_total", ())),
        ("reliability_outcomes", "reliability", "Outcome status distribution",
         ("series", None, "outcomes_by_kind_status_total", ())),
        ("reliability_volume", "reliability", "Provider/model operational volume",
         ("topk", 30, _CTX, ())),
        ("reliability_agent_failures", "reliability", "Agent failure and rework loops",
         ("sum_or_zero", None, "agent_failures_by_context_total", ())),
        ("reliability_reassessments", "reliability", "Agent failure and rework loops",
         ("sum_or_zero", None, "reassessments_by_context_total", ())),
        ("reliability_rework", "reliability", "Agent failure and rework loops",
         ("sum_or_zero", None, "rework_loops_by_context_total", ())),
        ("skill_volume", "skill-workflow", "Skill / role / lane volume",
         ("topk", 50, "events_by_execution_total", ())),
        ("workflow_volume", "skill-workflow", "Workflow volume",
         ("topk", 50, "events_by_workflow_total", ())),
        ("agent_volume", "skill-workflow", "Agent volume",
         ("topk", 50, "events_by_agent_total", ())),
    )
}


def report(
    name: str, spark: SparkSession, tables: dict[str, DataFrame], grid: S.Grid,
    filters: dict[str, str] | None = None,
) -> S.SeriesSet:
    return REPORTS[name].build(Context(spark, tables, grid, dict(filters or {})))
