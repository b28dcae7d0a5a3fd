"""Registered queries of the series engine: families, operators, metadata and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as FL
from ..operators import series as S
from ..operators.families import FAMILIES, LABEL_NAMES
from ..operators.rollup import rollup
from . import inputs, series_sql as Q
from .registry import Registry
from .reports import REPORTS, report

START, END = "2024-01-01T00:00:00Z", "2024-01-31T00:00:00Z"
DAILY = S.range_grid(START, END, "1d")
WEEKLY = S.range_grid(START, END, "1w")
AT = S.instant_grid("2024-01-20T12:00:00Z")

# Results of divisions of averages are compared at 9 digits, as engines add doubles in their own order.
_ROUNDED = "ROUND(value, 9)"


def _grid_for(family: str) -> S.Grid:
    return WEEKLY if len(FAMILIES[family].labels) > 7 else DAILY


def _sum_column() -> dict:
    return {"value": F.round("value", 9)}


def register(reg: Registry) -> None:
    for name in FAMILIES:
        grid = _grid_for(name)
        reg.add(
            f"series_{name}",
            lambda spark, d, n=name, g=grid: S.series(n, inputs.tables(spark, d), g).matrix(),
            Q.matrix(*Q.leaf(name, grid), grid),
        )

    # The same series from stored minutes of three batches that hold the events in a shuffled order.
    def stored(spark, d):
        ev = inputs.events(spark, d)
        parts = [rollup(ev.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k)) for k in (2, 0, 1)]
        return {"events": ev.limit(0), "rollup": parts[0].unionByName(parts[1]).unionByName(parts[2])}

    for name in ("events_total", "event_failures_total", "timeouts_total", "input_tokens_total", "duration_average_ms", "success_rate_by_provider_model",
                 "agent_failures_by_provider_model_total", "events_by_workflow_total", "cost_by_context"):
        rounded = FAMILIES[name].aggregate in ("sum", "avg")
        reg.add(
            f"stored_series_{name}",
            lambda spark, d, n=name, g=_grid_for(name), r=rounded: (
                lambda m: m.withColumns(_sum_column()) if r else m)(S.series(n, stored(spark, d), g).matrix()),
            Q.matrix(*Q.leaf(name, _grid_for(name)), _grid_for(name), _ROUNDED if rounded else "value"),
        )

    for name, rep in REPORTS.items():
        op, _, family, _ = rep.spec
        grid = WEEKLY if op == "series" and len(FAMILIES[family].labels) > 7 else DAILY
        rounded = op == "avg"
        reg.add(
            f"report_{name}",
            lambda spark, d, n=name, g=grid, r=rounded: (
                lambda m: m.withColumns(_sum_column()) if r else m
            )(report(n, spark, inputs.tables(spark, d), g).matrix()),
            Q.report_sql(rep.spec, grid, _ROUNDED if rounded else "value"),
        )
    # The two trace panels.
    reg.add(
        "report_execution_traces",
        lambda spark, d: FL.trace_listing(inputs.events(spark, d)),
        f"{inputs.WITH} SELECT trace_id, MIN(observed_at) AS first_at, MAX(observed_at) AS last_at, "
        "COUNT(*) AS spans FROM ev WHERE trace_id IS NOT NULL GROUP BY trace_id",
    )
    reg.add(
        "report_session_traces",
        lambda spark, d: FL.trace_listing(inputs.events(spark, d), "session-1"),
        f"{inputs.WITH} SELECT trace_id, MIN(observed_at) AS first_at, MAX(observed_at) AS last_at, "
        "COUNT(*) AS spans FROM ev WHERE trace_id IS NOT NULL AND regexp_matches(session_id, 'session-1') "
        "GROUP BY trace_id",
    )

    # Operators on their own.
    def op(name, build, sql):
        reg.add(f"samples_{name}", lambda spark, d: build(spark, inputs.tables(spark, d)), sql)

    ctx, lat = "events_by_context_total", "latency_average_by_context_ms"
    by = ("provider", "model")
    for fn in ("sum", "avg", "max", "count"):
        for kind, family in (("total", ctx), ("average", lat)):
            value = _ROUNDED if fn in ("sum", "avg") else "value"
            op(
                f"{fn}_by_{kind}",
                lambda spark, t, fn=fn, family=family, v=value: (
                    lambda m: m.withColumns(_sum_column()) if v != "value" else m
                )(S.series(family, t, DAILY).agg(fn, by).matrix()),
                Q.matrix(*Q.agg(fn, by, Q.leaf(family, DAILY)[1]), DAILY, value),
            )
            op(
                f"{fn}_all_{kind}",
                lambda spark, t, fn=fn, family=family, v=value: (
                    lambda m: m.withColumns(_sum_column()) if v != "value" else m
                )(S.series(family, t, DAILY).agg(fn).matrix()),
                Q.matrix(*Q.agg(fn, (), Q.leaf(family, DAILY)[1]), DAILY, value),
            )
    for label, matcher in {
        "matcher_equal": S.eq("provider", "openai"),
        "matcher_equal_unknown": S.eq("model_family", "unknown"),
        "matcher_not_equal": S.ne("provider", "openai"),
        "matcher_regex": S.matches("model_family", "family-[01]|unk.*"),
        "matcher_not_regex": S.not_matches("task_class", "class-[1-3]"),
    }.items():
        op(
            label,
            lambda spark, t, m=matcher: S.series("events_by_provider_model_total", t, WEEKLY, m).matrix(),
            Q.matrix(*Q.leaf("events_by_provider_model_total", WEEKLY, (matcher,)), WEEKLY),
        )
    op(
        "instant_vector",
        lambda spark, t: S.series("success_rate_by_provider_model", t, AT).vector(),
        Q.matrix(*Q.leaf("success_rate_by_provider_model", AT), AT),
    )
    op(
        "topk_after_sum",
        lambda spark, t: S.series(ctx, t, DAILY).sum("project", "workflow").topk(7).matrix(),
        Q.matrix(*Q.topk(7, ("project", "workflow"), DAILY,
                         Q.agg("sum", ("project", "workflow"), Q.leaf(ctx, DAILY)[1])[1]), DAILY),
    )
    cost, tokens = "cost_by_provider_model", "tokens_by_provider_model_total"
    op(
        "divide_series",
        lambda spark, t: S.series(cost, t, WEEKLY).divide(S.series(tokens, t, WEEKLY)).matrix(),
        Q.matrix(*Q.divide(FAMILIES[cost].labels, Q.leaf(cost, WEEKLY)[1], Q.leaf(tokens, WEEKLY)[1]), WEEKLY),
    )
    nobody = S.eq("project", "repo:none")
    op(
        "or_fallback_taken",
        lambda spark, t: S.series(ctx, t, DAILY, nobody).sum().or_else(S.zero_vector(spark, DAILY)).matrix(),
        Q.matrix(*Q.or_zero(DAILY, Q.agg("sum", (), Q.leaf(ctx, DAILY, (nobody,))[1])[1]), DAILY),
    )
    op(
        "packed_range",
        lambda spark, t: S.series("events_by_project_total", t, DAILY).packed().select(
            "project", F.size("samples").cast("bigint").alias("samples"),
            F.element_at("samples", -1)["value"].alias("last_value"),
        ),
        f"{inputs.WITH} SELECT project, COUNT(*) AS samples, MAX(value) AS last_value FROM "
        f"({Q.leaf('events_by_project_total', DAILY)[1]}) GROUP BY project",
    )
    for label in ("provider", "skill", "correlation_basis", "status"):
        family_sources = sorted({
            ("outcomes" if f.source == "outcomes" else "events", f.only is not None)
            for f in FAMILIES.values() if label in f.labels
        })
        selects = []
        for source, only in family_sources:
            rows = "ev" if source == "events" else "(SELECT e.event_type, e.observed_at, o.* EXCLUDE (observed_at) FROM outcome_rows o JOIN ev e USING (event_id))"
            column = {"correlation_basis": "COALESCE(correlation_basis, 'uncorrelated')"}.get(label, f"COALESCE({label}, 'unknown')")
            cond = "event_type = 'model.operation' AND " if only else ""
            selects.append(
                f"SELECT DISTINCT {column} AS value FROM {rows} WHERE {cond}observed_at >= TIMESTAMP '2024-01-02' "
                "AND observed_at <= TIMESTAMP '2024-01-20'"
            )
        op(
            f"label_values_{label}",
            lambda spark, t, l=label: S.label_values(l, t, "2024-01-02T00:00:00Z", "2024-01-20T00:00:00Z"),
            f"{inputs.WITH} {' UNION '.join(selects)}",
        )
    op(
        "series_list",
        lambda spark, t: S.series_list(
            t, START, END, ("events_by_client_route_total", (S.eq("client", "cli-a"),)),
            ("events_by_project_total", ()),
        ),
        f"{inputs.WITH} SELECT DISTINCT 'events_by_client_route_total' AS metric, project_id AS project, client, route, auth_mode "
        "FROM ev WHERE client = 'cli-a' UNION ALL SELECT DISTINCT 'events_by_project_total', project_id, NULL, NULL, NULL FROM ev",
    )
