"""Registered queries of retention, exports, event detail and stream-shaped aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import correlate as C
from ..operators import export as X
from ..operators import intake as I
from ..operators import normalize as N
from ..operators import projections as P
from ..operators import retention as RT
from ..operators import tables as TB
from ..sources import jsonl
from ..streaming import intake as ST
from . import inputs
from .catalog_intake import CORRELATED, EDGES, PAIRS, lines
from .catalog_tables import _measure_sql
from .registry import Registry

W = inputs.WITH
CUT = "2024-01-12T06:00:00Z"


def _metric_rows(source: str, keys: dict[str, str], measures: str, metrics: dict[str, str], missing: str = "unknown") -> str:
    """SQL of (series, number) for each metric of each group, from one aggregation."""
    def label(name: str) -> str:
        text = f"COALESCE(key_{name}, '{missing if name == 'correlation_basis' else 'unknown'}')"
        for raw, escaped in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'")):
            text = f"replace({text}, {raw}, {escaped})"
        return f"'{name}=\"' || {text} || '\"'"

    tag = "'{' || " + " || ',' || ".join(map(label, keys)) + " || '}'" if keys else "''"
    columns = ", ".join([*[f"{c} AS key_{k}" for k, c in keys.items()], measures])
    group = f" GROUP BY {', '.join(keys.values())}" if keys else ""
    cells = ", ".join(f"{{'name': '{n}', 'number': CAST({c} AS DOUBLE)}}" for n, c in metrics.items())
    return (f"SELECT m.name || tag AS series, COALESCE(m.number, CAST('NaN' AS DOUBLE)) AS number FROM (SELECT {tag} AS tag, unnest([{cells}]) AS m "
            f"FROM (SELECT {columns} FROM {source}{group}))")


def _all_metrics_sql() -> str:
    parts = [
        _metric_rows("ev", {}, "COUNT(*) AS events, " + _measure_sql(A.SUMMARY_MEASURES), X._SUMMARY),
        _metric_rows("conflict_rows", {}, "COUNT(*) AS n", {"event_conflicts_total": "n"}),
        _metric_rows("outcome_rows", {}, "COUNT(*) AS n", {"outcomes_total": "n"}),
    ]
    more = {"provider_model": {**X._PROVIDER, "success_rate_by_provider_model": "successes / count"}, "context": X._CONTEXT}
    for name in ("provider_model", "context", "usage_source", "project", "client_route", "execution", "workflow", "agent"):
        keys, extra, model_only, _ = A.DIMENSIONS[name]
        source = "ev WHERE event_type = 'model.operation'" if model_only else "ev"
        measures = "COUNT(*) AS count" + (f", {_measure_sql(extra)}" if extra else "")
        parts.append(_metric_rows(source, keys, measures, more.get(name, {f"events_by_{name}_total": "count"})))
    parts.append(_metric_rows(
        "outcome_rows o JOIN ev e ON e.event_id = o.event_id",
        {"kind": "o.kind", "status": "o.status", "evidence_source": "o.evidence_source", "project": "e.project_id", "repository": "e.repository",
         "branch": "e.branch", "correlation_basis": "o.correlation_basis"},
        "COUNT(*) AS count", {"outcomes_by_kind_status_total": "count"}, "uncorrelated"))
    return f"{W} " + " UNION ALL ".join(parts)


def register(reg: Registry) -> None:
    def ev(fn):
        return lambda spark, d: fn(inputs.events(spark, d))

    def purged(e):
        tables = {
            "events": e, "measurement_facts": P.measurement_facts(e), "outcome_events": P.outcome_events(e),
            "attribution_edges": P.hierarchy_edges(e),
        }
        gone = RT.purge_selection(e, CUT, ["evt-9000", "evt-9008"], confirm=True)
        kept = RT.survivors(tables, gone)
        out = None
        for name, df in kept.items():
            part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
            out = part if out is None else out.unionByName(part)
        return out

    gone = f"(SELECT event_id FROM ev WHERE observed_at < TIMESTAMP '2024-01-12 06:00:00' OR event_id IN ('evt-9000', 'evt-9008'))"
    facts = " + ".join(f"COUNT({c})" for c, _ in P.MEASUREMENTS.values())
    # A parent_event edge goes when its parent is purged, the others when their child is.
    others = " + ".join(f"COUNT({c})" for r, c in P.HIERARCHY.items() if r != "parent_event")
    reg.add(
        "purge_survivors", ev(purged),
        f"""{W}, kept AS (SELECT * FROM ev WHERE event_id NOT IN {gone})
          SELECT 'events' AS table_name, COUNT(*) AS rows FROM kept UNION ALL SELECT 'measurement_facts', {facts} FROM kept
          UNION ALL SELECT 'outcome_events', COUNT(outcome_kind) FROM kept
          UNION ALL SELECT 'attribution_edges', {others} + COUNT(CASE WHEN parent_event_id NOT IN {gone} THEN 1 END) FROM kept""",
    )
    reg.add(
        "purge_audit",
        lambda spark, d: (lambda e: RT.audit_rows(spark, RT.purge_selection(e, CUT, confirm=True), CUT)
                          .select("action_type", "selector", "outcome", "affected_events", "detail"))(inputs.events(spark, d)),
        f"""{W}, n AS (SELECT COUNT(*) AS affected_events FROM ev WHERE observed_at < TIMESTAMP '2024-01-12 06:00:00')
          SELECT 'purge' AS action_type, '{{"before": "{CUT}", "event_ids": []}}' AS selector, o AS outcome, affected_events,
          CASE WHEN o = 'completed' THEN 'explicit operator retention/deletion' END AS detail FROM n, (SELECT unnest(['started', 'completed']) AS o)""",
    )
    reg.add(
        "class_retention",
        ev(lambda e: RT.expire(e, "logs", "2024-01-31T00:00:00Z").select("event_id")),
        f"{W} SELECT event_id FROM ev WHERE observed_at >= TIMESTAMP '2024-01-31' - INTERVAL 336 HOUR",
    )
    reg.add(
        "canonical_export",
        lambda spark, d: X.canonical_lines(N.accepted(jsonl.events_from_lines(lines(inputs.spread_events(spark, d))))).select(
            F.get_json_object("value", "$.event_id").alias("event_id"), F.get_json_object("value", "$.llm.model_family").alias("model_family"),
            F.regexp_extract("value", '"([a-z]+)":', 1).alias("first_key"), F.get_json_object("value", "$.observed_at").alias("observed_at"),
            F.get_json_object("value", "$.usage.cost").cast("double").alias("cost")),
        f"{W} SELECT event_id, model_family, 'attributes' AS first_key, strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS observed_at, cost FROM ev",
    )
    reg.add(
        "metric_export",
        lambda spark, d: (lambda t: X.metric_lines(t["events"], t["outcomes"], t["conflicts"]).where(
            F.col("value").rlike(r"^(events_total|input_tokens_total|event_conflicts_total|outcomes_total|events_by_project_total|events_by_usage_source_total|outcomes_by_kind_status_total|events_by_client_route_total)[ {]")))(inputs.tables(spark, d)),
        f"""{W} SELECT concat('events_total ', COUNT(*)) AS value FROM ev
          UNION ALL SELECT concat('input_tokens_total ', CAST(SUM(input_tokens) AS BIGINT)) FROM ev
          UNION ALL SELECT concat('event_conflicts_total ', COUNT(*)) FROM conflict_rows
          UNION ALL SELECT concat('outcomes_total ', COUNT(*)) FROM outcome_rows
          UNION ALL SELECT concat('events_by_project_total{{project="', project_id, '"}} ', COUNT(*)) FROM ev GROUP BY project_id
          UNION ALL SELECT concat('events_by_usage_source_total{{source="', usage_source, '"}} ', COUNT(*)) FROM ev WHERE event_type = 'model.operation' GROUP BY usage_source
          UNION ALL SELECT concat('events_by_client_route_total{{project="', project_id, '",client="', client, '",route="', route, '",auth_mode="', auth_mode, '"}} ', COUNT(*))
            FROM ev GROUP BY project_id, client, route, auth_mode
          UNION ALL SELECT concat('outcomes_by_kind_status_total{{kind="', kind, '",status="', o.status, '",evidence_source="', o.evidence_source, '",project="', project_id,
            '",repository="', COALESCE(repository, 'unknown'), '",branch="', COALESCE(branch, 'unknown'), '",correlation_basis="', COALESCE(o.correlation_basis, 'uncorrelated'), '"}} ', COUNT(*))
            FROM outcome_rows o JOIN ev USING (event_id) GROUP BY kind, o.status, o.evidence_source, project_id, repository, branch, o.correlation_basis""",
    )
    # Every line, as its series and its number, so that the check does not depend on how an engine writes a double.
    reg.add(
        "metric_export_all",
        lambda spark, d: (lambda t: X.metric_lines(t["events"], t["outcomes"], t["conflicts"]).select(
            F.regexp_extract("value", r"(?s)^(.*) ([^ ]+)$", 1).alias("series"),
            F.regexp_extract("value", r"(?s)^(.*) ([^ ]+)$", 2).cast("double").alias("number")))(inputs.tables(spark, d)),
        _all_metrics_sql(),
    )
    reg.add(
        "table_counts",
        ev(lambda e: A.table_counts(e, P.measurement_facts(e), P.outcome_events(e))),
        f"{W} SELECT 'ledger' AS table_name, COUNT(*) AS rows FROM ev UNION ALL SELECT 'facts', {facts} FROM ev UNION ALL SELECT 'outcomes', COUNT(*) FROM outcome_rows",
    )
    reg.add(
        "event_detail_parts",
        ev(lambda e: TB.event_detail({
            "events": e, "ledger": e.select("event_id", "arrival_seq", F.lit("inserted").alias("decision")),
            "facts": P.measurement_facts(e), "outcomes": P.outcome_events(e),
            "edges": C.edge_listing(e, ["evt-16"])}, "evt-16").groupBy("part").agg(F.count("*").alias("rows"))),
        f"""{W}, {PAIRS}, one AS (SELECT * FROM ev WHERE event_id = 'evt-16'), parts AS (
            SELECT 'event' AS part, COUNT(*) AS rows FROM one UNION ALL SELECT 'ledger', COUNT(*) FROM one
            UNION ALL SELECT 'measurements', {facts} FROM one UNION ALL SELECT 'outcomes', COUNT(outcome_kind) FROM one
            UNION ALL SELECT 'attribution', COUNT(*) FROM ({EDGES} UNION ALL {CORRELATED}) WHERE child_event_id = 'evt-16' OR parent_event_id = 'evt-16')
          SELECT part, rows FROM parts WHERE rows > 0""",
    )
    reg.add(
        "tumbling_counts",
        ev(lambda e: ST.tumbling_counts(e, "6 hours", "provider")),
        f"{W} SELECT time_bucket(INTERVAL 6 HOUR, observed_at, TIMESTAMP '1970-01-01') AS window_start, provider, COUNT(*) AS count FROM ev GROUP BY ALL",
    )
    reg.add(
        "arrival_lag",
        ev(lambda e: ST.arrival_lag(e, "provider")),
        f"""{W} SELECT provider, MIN(epoch_us(received_at) - epoch_us(observed_at)) / 1e6 AS min_lag_s, MAX(epoch_us(received_at) - epoch_us(observed_at)) / 1e6 AS max_lag_s,
          AVG((epoch_us(received_at) - epoch_us(observed_at)) / 1e6) AS avg_lag_s, COUNT(*) AS events FROM ev GROUP BY provider""",
    )
