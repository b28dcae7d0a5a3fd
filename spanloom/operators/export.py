"""Text exports: canonical JSON lines and metric snapshot lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import aggregates as A
from .redact import canonical_payload


def canonical_lines(events: DataFrame) -> DataFrame:
    """Envelope rows as canonical JSON text, one per line (``write.text`` ready)."""
    return events.select(canonical_payload().alias("value"))


def _label(value: Column) -> Column:
    text = F.coalesce(value, F.lit("unknown"))
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def sample(value: Column) -> Column:
    """A number as text; whole numbers without a fraction, a missing one as NaN."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(value.isNull(), "NaN").when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def _lines(df: DataFrame, labels: list[str], metrics: dict[str, Column]) -> DataFrame:
    pairs = [F.concat(F.lit(f'{l}="'), _label(F.col(l)), F.lit('"')) for l in labels]
    tag = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")) if labels else F.lit("")
    entries = F.array(*[F.struct(F.lit(n).alias("name"), sample(v.cast("double")).alias("text")) for n, v in metrics.items()])
    rows = df.select(tag.alias("tag"), F.explode(entries).alias("m"))
    return rows.select(F.concat("m.name", "tag", F.lit(" "), "m.text").alias("value"))


_SUMMARY = {
    "events_total": "events", "event_successes_total": "successes", "event_failures_total": "failures",
    **{f"{n}_total": n for n in (
        "input_tokens", "output_tokens", "cached_tokens", "cache_creation_tokens", "cache_read_tokens",
        "reasoning_tokens", "compactions", "cost", "retries", "rate_limited", "timeouts", "tool_failures",
        "agent_failures", "reassessments", "rework_loops", "tool_calls", "files_inspected", "files_changed",
        "commands_executed", "tests_invoked")},
    "latency_average_ms": "average_latency_ms", "time_to_first_token_average_ms": "average_time_to_first_token_ms",
    "duration_average_ms": "average_duration_ms", "context_size_average": "average_context_size",
    "context_utilization_average": "average_context_utilization", "concurrency_average": "average_concurrency",
    "parallel_utilization_average": "average_parallel_utilization",
}
_PROVIDER = {
    "events_by_provider_model_total": "count", "tokens_by_provider_model_total": "total_tokens",
    "cost_by_provider_model": "cost", "latency_average_by_provider_model_ms": "average_latency_ms",
    **{f"{n}_by_provider_model_total": n for n in (
        "retries", "rate_limited", "timeouts", "tool_failures", "agent_failures", "reassessments", "rework_loops",
        "tool_calls", "files_changed")},
}
_CONTEXT = {
    "events_by_context_total": "count", "tokens_by_context_total": "total_tokens", "cost_by_context": "cost",
    **{f"{n}_by_context_total": n for n in (
        "input_tokens", "output_tokens", "cached_tokens", "reasoning_tokens", "cache_creation_tokens",
        "cache_read_tokens", "compactions", "retries", "rate_limited", "timeouts", "tool_failures", "agent_failures",
        "reassessments", "rework_loops", "tool_calls", "files_inspected", "files_changed", "commands_executed",
        "tests_invoked")},
    "latency_average_by_context_ms": "average_latency_ms",
    "time_to_first_token_average_by_context_ms": "average_time_to_first_token_ms",
    "duration_average_by_context_ms": "average_duration_ms", "context_size_average_by_context": "average_context_size",
    "context_utilization_average_by_context": "average_context_utilization",
    "concurrency_average_by_context": "average_concurrency",
    "parallel_utilization_average_by_context": "average_parallel_utilization",
}


def metric_lines(events: DataFrame, outcomes: DataFrame, conflicts: DataFrame, limit: int | None = None) -> DataFrame:
    """All data metrics as ``name{label="v"} value`` lines; with a limit breakdowns keep their top groups."""
    pick = lambda table: {name: F.col(column) for name, column in table.items()}
    parts = [
        _lines(A.summary(events), [], pick(_SUMMARY)),
        _lines(conflicts.agg(F.count("*").alias("n")), [], {"event_conflicts_total": F.col("n")}),
        _lines(outcomes.agg(F.count("*").alias("n")), [], {"outcomes_total": F.col("n")}),
    ]
    keys = lambda name: list(A.DIMENSIONS[name][0])
    rate = {"success_rate_by_provider_model": F.try_divide("successes", "count")}
    parts.append(_lines(A.dimension(events, "provider_model", limit), keys("provider_model"), {**pick(_PROVIDER), **rate}))
    parts.append(_lines(A.dimension(events, "context", limit), keys("context"), pick(_CONTEXT)))
    for name in ("usage_source", "project", "client_route", "execution", "workflow", "agent"):
        parts.append(_lines(A.dimension(events, name, limit), keys(name), {f"events_by_{name}_total": F.col("count")}))
    parts.append(_lines(
        A.outcome_dimension(outcomes, events, limit),
        ["kind", "status", "evidence_source", "project", "repository", "branch", "correlation_basis"],
        {"outcomes_by_kind_status_total": F.col("count")}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
