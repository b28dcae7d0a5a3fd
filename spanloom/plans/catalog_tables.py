"""Registered queries over the flat event table: filters, summaries, breakdowns, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as FL
from ..operators import projections as P
from . import inputs
from .registry import Registry

W = inputs.WITH
SUCC = "CAST(SUM(CASE WHEN status IN ('ok','success','succeeded') THEN 1 ELSE 0 END) AS BIGINT) AS successes"
FAIL = "CAST(SUM(CASE WHEN status IN ('error','failed','failure') THEN 1 ELSE 0 END) AS BIGINT) AS failures"


def _flag(column: str, name: str) -> str:
    return f"CAST(SUM(CASE WHEN {column} THEN 1 ELSE 0 END) AS BIGINT) AS {name}"


_SQL = {
    "successes": SUCC, "failures": FAIL, "compactions": "SUM(compaction_count) AS compactions",
    "retries": "COALESCE(SUM(retry_count), 0) AS retries",
    "reassessments": "COALESCE(SUM(reassessment_count), 0) AS reassessments",
    "rework_loops": "COALESCE(SUM(rework_count), 0) AS rework_loops",
    "tool_calls": "COALESCE(SUM(tool_call_count), 0) AS tool_calls",
    "rate_limited": _flag("rate_limited", "rate_limited"), "timeouts": _flag("timeout", "timeouts"),
    "tool_failures": _flag("tool_failure", "tool_failures"),
    "agent_failures": _flag("agent_failure", "agent_failures"), "aborted": _flag("aborted", "aborted"),
}
for _n in ("files_inspected", "files_changed", "commands_executed", "tests_invoked"):
    _SQL[_n] = f"COALESCE(SUM({_n}_count), 0) AS {_n}"


def _measure_sql(names) -> str:
    out = []
    for n in names:
        if n in _SQL:
            out.append(_SQL[n])
        elif n.startswith("average_"):
            out.append(f"AVG({n[8:]}) AS {n}")
        else:
            out.append(f"SUM({n}) AS {n}")
    return ", ".join(out)


def _ev(fn):
    return lambda spark, d: fn(inputs.events(spark, d))


def register(reg: Registry) -> None:
    summary_sql = (
        f"SELECT COUNT(*) AS events, {_measure_sql(A.SUMMARY_MEASURES)}, COUNT(DISTINCT project_id) AS projects, "
        "COUNT(DISTINCT provider || ':' || model) AS models FROM ev"
    )
    reg.add("summary", _ev(A.summary), f"{W} {summary_sql}")
    reg.add(
        "summary_filtered",
        _ev(lambda e: A.summary(e, {"project": "repo:1", "client": "cli-a", "start": "2024-01-05T02:00:00+02:00",
                                    "end": "2024-01-20T00:00:00Z"})),
        f"{W} {summary_sql} WHERE project_id = 'repo:1' AND client = 'cli-a' AND observed_at >= "
        "TIMESTAMP '2024-01-05 00:00:00' AND observed_at <= TIMESTAMP '2024-01-20 00:00:00'",
    )
    reg.add("usage_sources", _ev(A.usage_sources),
            f"{W} SELECT usage_source, COUNT(*) AS count FROM ev GROUP BY usage_source")
    reg.add(
        "outcome_breakdown",
        _ev(lambda e: A.outcome_breakdown(P.outcome_events(e), e, {"auth_mode": "api"})),
        f"{W} SELECT kind, status, COUNT(*) AS count FROM outcome_rows WHERE event_id IN "
        "(SELECT event_id FROM ev WHERE auth_mode = 'api') GROUP BY kind, status",
    )
    def top_sql(source, keys, extra, first, relabel, where=""):
        def shown(l):
            missing = "uncorrelated" if l == "correlation_basis" else "unknown"
            return f"COALESCE(key_{l}, '{missing}')" if relabel else f"key_{l}"

        more = f", {_measure_sql(extra)}" if extra else ""
        grouped = (
            "SELECT " + ", ".join(f"{c} AS key_{l}" for l, c in keys.items())
            + f", COUNT(*) AS count{more} FROM {source} {where} GROUP BY {', '.join(keys.values())}"
        )
        return (
            f"{W} SELECT {', '.join(f'{shown(l)} AS {l}' for l in keys)}, count"
            + "".join(f", {n}" for n in extra)
            + f" FROM ({grouped})"
        )

    for name, (keys, extra, model_only, relabel) in A.DIMENSIONS.items():
        where = "WHERE event_type = 'model.operation'" if model_only else ""
        reg.add(
            f"dimension_{name}",
            _ev(lambda e, n=name: A.dimension(e, n)),
            top_sql("ev", keys, extra, A.LABEL_ORDER.get(name, ()), relabel, where),
        )
    reg.add(
        "dimension_outcome",
        _ev(lambda e: A.outcome_dimension(P.outcome_events(e), e)),
        top_sql(
            "outcome_rows o JOIN ev e ON e.event_id = o.event_id",
            {"kind": "o.kind", "status": "o.status", "correlation_basis": "o.correlation_basis",
             "evidence_source": "o.evidence_source", "project": "e.project_id",
             "repository": "e.repository", "branch": "e.branch"},
            (), A.LABEL_ORDER["outcome"], True,
        ),
    )
    keys = ", ".join(A.COMPARISON_KEYS)
    comparison_sql = f"SELECT {keys}, COUNT(*) AS events, {_measure_sql(A.COMPARISON_MEASURES)} FROM ev"
    reg.add("comparison", _ev(A.comparison),
            f"{W} {comparison_sql} GROUP BY {keys}")
    reg.add(
        "comparison_filtered",
        _ev(lambda e: A.comparison(e, {"event_type": "model.operation", "start": "2024-01-03T00:00:00Z"})),
        f"{W} {comparison_sql} WHERE event_type = 'model.operation' AND observed_at >= TIMESTAMP '2024-01-03' "
        f"GROUP BY {keys}",
    )

    # Filters: one query that counts the matches of every filter name on its own.
    probes = {
        "project": "repo:2", "repository": "repo1", "provider": "google", "model": "model-1",
        "model_variant": "v2", "client": "cli-b", "event_type": "tool.operation", "status": "failed",
        "evidence_source": "ci", "usage_source": "client", "model_family": "family-2",
        "auth_mode": "api", "route": "gateway", "trace_id": "trace-16", "span_id": "span-17",
        "branch": "dev", "commit": "sha3", "worktree": "wt-6", "session_id": "session-9",
        "workflow_id": "wf-4", "agent_id": "agent-3", "subagent_id": "sub-3",
        "parent_agent": "agent-0", "role": "review", "skill": "skill-2", "lane": "primary",
        "task_id": "task-7", "task_class": "class-4", "outcome_kind": "tests",
        "outcome_status": "passed", "project_id": "repo:3", "commit_sha": "sha4",
        "parent_agent_id": "agent-0",
    }
    def counts():
        return [
            F.count(F.when(F.col(FL.ALIASES.get(k, k)) == v, True)).alias(f"n_{k}") for k, v in probes.items()
        ]

    reg.add(
        "filter_counts", _ev(lambda e: e.agg(*counts())),
        f"{W} SELECT " + ", ".join(
            f"COUNT(CASE WHEN {FL.ALIASES.get(k, k)} = '{v}' THEN 1 END) AS n_{k}" for k, v in probes.items()
        ) + " FROM ev",
    )
    listed = "event_id, event_type, observed_at, received_at, project_id, provider, model, status, session_id, total_tokens"
    cols = listed.split(", ")
    reg.add(
        "filter_combined",
        _ev(lambda e: FL.apply_filters(e, {"provider": "openai", "lane": "primary", "status": "succeeded"}).select(*cols)),
        f"{W} SELECT {listed} FROM ev WHERE provider = 'openai' AND lane = 'primary' AND status = 'succeeded'",
    )
    reg.add(
        "filter_time_range",
        _ev(lambda e: FL.in_range(e, "2024-01-10T00:00:00Z", "2024-01-12T12:00:00Z").select(*cols)),
        f"{W} SELECT {listed} FROM ev WHERE observed_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 12:00:00'",
    )
    reg.add("event_list", _ev(lambda e: FL.list_events(e, {"client": "cli-a"}).select(*cols)),
            f"{W} SELECT {listed} FROM ev WHERE client = 'cli-a'")
    reg.add("event_lookup", _ev(lambda e: FL.point_lookup(e, "evt-77").select(*cols)),
            f"{W} SELECT {listed} FROM ev WHERE event_id = 'evt-77'")
    reg.add("session_timeline", _ev(lambda e: FL.session_timeline(e, "session-1[0-9]$").select(*cols)),
            f"{W} SELECT {listed} FROM ev WHERE regexp_matches(session_id, 'session-1[0-9]$')")

    # Projections.
    fact_selects = " UNION ALL ".join(
        f"SELECT event_id, '{path}' AS field_path, CAST({column} AS DOUBLE) AS value, '{unit}' AS unit, "
        + {
            "usage": "COALESCE(pv_usage, usage_source, 'unknown')",
            "performance": ("COALESCE(pv_latency, pv_performance, 'unknown')" if column == "latency_ms"
                            else "COALESCE(pv_performance, 'unknown')"),
            "reliability": "'unknown'",
            "behavior": "COALESCE(pv_behavior, 'unknown')",
        }[path.split(".")[0]]
        + f" AS evidence_source, observed_at, received_at FROM ev WHERE {column} IS NOT NULL"
        for path, (column, unit) in P.MEASUREMENTS.items()
    )
    quality = (
        "CASE WHEN evidence_source IN ('observed','reported','inferred','estimated','derived') THEN evidence_source "
        "WHEN evidence_source IN ('provider','client','gateway') THEN 'reported' ELSE 'unknown' END"
    )
    reg.add(
        "measurement_facts", _ev(P.measurement_facts),
        f"{W} SELECT event_id, field_path, value, unit, concat('evidence:', event_id, ':', field_path) AS evidence_id, "
        f"evidence_source, {quality} AS evidence_quality, observed_at, received_at FROM ({fact_selects})",
    )
    reg.add(
        "evidence_quality_counts",
        _ev(lambda e: P.measurement_facts(e).groupBy("evidence_source", "evidence_quality", "unit").agg(
            F.count("*").alias("facts"), F.sum("value").alias("total"))),
        f"{W} SELECT evidence_source, {quality} AS evidence_quality, unit, COUNT(*) AS facts, SUM(value) AS total "
        f"FROM ({fact_selects}) GROUP BY ALL",
    )
    reg.add("outcome_events", _ev(P.outcome_events), f"{W} SELECT * FROM outcome_rows")
    edges = " UNION ALL ".join(
        f"SELECT event_id AS child_event_id, {'parent_event_id' if r == 'parent_event' else 'NULL'} AS parent_event_id, "
        f"'{r}' AS relation, {c} AS target_id, "
        + ("COALESCE(pv_session, pv_execution, 'unknown')" if r == "session" else "COALESCE(pv_execution, 'unknown')")
        + f" AS evidence_source, observed_at, received_at FROM ev WHERE {c} IS NOT NULL"
        for r, c in P.HIERARCHY.items()
    )
    reg.add("hierarchy_edges", _ev(P.hierarchy_edges), f"{W} {edges}")
    reg.add(
        "fact_listing",
        _ev(lambda e: P.fact_listing(P.measurement_facts(e))
            .select("event_id", "field_path", "value")),
        f"{W} SELECT event_id, field_path, value FROM ({fact_selects})",
    )
    reg.add(
        "outcome_listing",
        _ev(lambda e: P.outcome_listing(P.outcome_events(e))),
        f"{W} SELECT * FROM outcome_rows",
    )
