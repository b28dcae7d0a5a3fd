"""Flat event rows derived from a click-stream style ``events`` table.

One SQL text with three engine-specific pieces serves Spark here and the SQL checks, so
that both sides start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TEMPLATE = """
SELECT
  event_id AS arrival_seq,
  '1.0' AS schema_version,
  'fixture' AS source_kind,
  concat('src-', CAST(event_id % 3 AS {string})) AS source_name,
  concat('sha', CAST(user_id % 10 AS {string})) AS commit_sha,
  CASE WHEN user_id % 6 = 0 THEN concat('wt-', CAST(user_id AS {string})) ELSE NULL END AS worktree,
  CASE WHEN k % 5 = 4 THEN NULL ELSE concat('skill-', CAST(k % 5 AS {string})) END AS skill,
  CASE WHEN k % 2 = 0 THEN 'primary' ELSE 'parallel-1' END AS lane,
  concat('trace-', CAST(event_id - event_id % 8 AS {string})) AS trace_id,
  concat('span-', CAST(event_id AS {string})) AS span_id,
  CASE WHEN event_id % 8 = 0 THEN NULL ELSE concat('evt-', CAST(event_id - event_id % 8 AS {string})) END AS parent_event_id,
  CASE WHEN event_type = 'signup' THEN 'ci' ELSE NULL END AS evidence_source,
  CASE WHEN event_type = 'view' THEN CAST(k * 2 AS DOUBLE) ELSE NULL END AS cached_tokens,
  CASE WHEN event_type = 'view' AND k % 2 = 0 THEN CAST(k AS DOUBLE) ELSE NULL END AS cache_creation_tokens,
  CASE WHEN event_type = 'view' AND k % 2 = 1 THEN CAST(k AS DOUBLE) ELSE NULL END AS cache_read_tokens,
  CASE WHEN event_type = 'purchase' THEN CAST(k * 4 AS DOUBLE) ELSE NULL END AS reasoning_tokens,
  CASE WHEN event_type IN ('signup','click') OR k < 5 THEN NULL ELSE CAST(floor(value * 10) + floor(value * 3) AS DOUBLE) END AS total_tokens,
  CASE WHEN event_type = 'view' THEN CAST(k * 1000 AS DOUBLE) ELSE NULL END AS context_size,
  CASE WHEN event_type = 'view' THEN CAST(k AS DOUBLE) / 128 ELSE NULL END AS context_utilization,
  CASE WHEN event_type = 'view' AND k > 90 THEN CAST(1 AS DOUBLE) ELSE NULL END AS compaction_count,
  CASE WHEN event_type = 'purchase' THEN CAST(k AS DOUBLE) ELSE NULL END AS time_to_first_token_ms,
  CAST(floor(value * 2) AS DOUBLE) AS duration_ms,
  CASE WHEN event_type = 'click' THEN CAST(floor(value) AS DOUBLE) ELSE NULL END AS tool_duration_ms,
  CAST(NULL AS DOUBLE) AS session_duration_ms,
  CAST(NULL AS DOUBLE) AS agent_duration_ms,
  CAST(NULL AS DOUBLE) AS workflow_duration_ms,
  CAST(NULL AS DOUBLE) AS wall_clock_ms,
  CASE WHEN k % 4 = 3 THEN CAST(k % 5 AS DOUBLE) ELSE NULL END AS concurrency,
  CASE WHEN k % 4 = 3 THEN CAST(k % 5 AS DOUBLE) / 4 ELSE NULL END AS parallel_utilization,
  CASE WHEN event_type = 'error' THEN k % 5 = 0 ELSE NULL END AS timeout,
  CASE WHEN event_type = 'click' THEN k % 9 = 0 ELSE NULL END AS tool_failure,
  CASE WHEN event_type = 'error' THEN k % 7 = 0 ELSE NULL END AS agent_failure,
  CASE WHEN event_type = 'error' THEN k % 13 = 0 ELSE NULL END AS aborted,
  CASE WHEN event_type = 'error' THEN CAST(k % 3 AS DOUBLE) ELSE NULL END AS reassessment_count,
  CASE WHEN event_type = 'error' THEN CAST(k % 2 AS DOUBLE) ELSE NULL END AS rework_count,
  CASE WHEN event_type = 'click' THEN CAST(1 + k % 3 AS DOUBLE) WHEN event_type = 'purchase' AND k % 3 = 0 THEN CAST(1 + k % 2 AS DOUBLE) ELSE NULL END AS tool_call_count,
  CASE WHEN event_type = 'click' THEN CAST(k % 8 AS DOUBLE) ELSE NULL END AS files_inspected_count,
  CASE WHEN event_type = 'click' THEN CAST(k % 4 AS DOUBLE) WHEN event_type = 'purchase' AND k % 3 = 0 THEN CAST(1 + k % 5 AS DOUBLE) ELSE NULL END AS files_changed_count,
  CASE WHEN event_type = 'click' THEN CAST(k % 6 AS DOUBLE) ELSE NULL END AS commands_executed_count,
  CASE WHEN event_type = 'click' THEN CAST(k % 2 AS DOUBLE) ELSE NULL END AS tests_invoked_count,
  concat('evt-', CAST(event_id AS {string})) AS event_id,
  CASE WHEN event_type = 'signup' THEN 'outcome.tests' WHEN event_type = 'click' THEN 'tool.operation' ELSE 'model.operation' END AS event_type,
  {observed} AS observed_at,
  {received} AS received_at,
  concat('repo:', CAST(user_id % 5 AS {string})) AS project_id,
  CASE WHEN user_id % 5 = 4 THEN NULL ELSE concat('repo', CAST(user_id % 5 AS {string})) END AS repository,
  CASE WHEN k % 3 = 0 THEN 'main' WHEN k % 3 = 1 THEN 'dev' ELSE NULL END AS branch,
  CASE event_id % 4 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN 'google' ELSE 'unknown' END AS provider,
  concat('model-', CAST(k % 3 AS {string})) AS model,
  CASE WHEN event_id % 4 = 3 THEN NULL ELSE concat('family-', CAST(event_id % 4 AS {string})) END AS model_family,
  CASE WHEN k % 5 = 0 THEN 'v2' ELSE NULL END AS model_variant,
  CASE WHEN k % 2 = 0 THEN 'cli-a' ELSE 'cli-b' END AS client,
  CASE WHEN user_id % 3 = 0 THEN 'subscription' ELSE 'api' END AS auth_mode,
  CASE WHEN event_id % 4 = 3 THEN 'gateway' ELSE 'direct' END AS route,
  CASE WHEN k % 4 = 1 THEN 'high' ELSE NULL END AS reasoning_effort,
  CASE event_id % 3 WHEN 0 THEN 'provider' WHEN 1 THEN 'client' ELSE 'unknown' END AS usage_source,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN k % 10 = 9 THEN 'unknown' ELSE 'succeeded' END AS status,
  CASE WHEN event_type = 'error' THEN 'provider_error' ELSE NULL END AS error_kind,
  concat('session-', CAST(user_id AS {string})) AS session_id,
  concat('wf-', CAST(user_id % 20 AS {string})) AS workflow_id,
  concat('agent-', CAST(k % 4 AS {string})) AS agent_id,
  CASE WHEN k % 4 = 3 THEN concat('sub-', CAST(k % 8 AS {string})) ELSE NULL END AS subagent_id,
  CASE WHEN k % 4 = 3 THEN 'agent-0' ELSE NULL END AS parent_agent_id,
  CASE WHEN k % 4 = 0 THEN 'implementation' WHEN k % 4 = 1 THEN 'review' ELSE NULL END AS role,
  CASE WHEN event_type = 'click' THEN NULL ELSE concat('task-', CAST(event_id % 500 AS {string})) END AS task_id,
  CASE WHEN k % 7 = 0 THEN NULL ELSE concat('class-', CAST(k % 7 AS {string})) END AS task_class,
  CASE WHEN event_type IN ('signup','click') OR k < 5 THEN NULL ELSE CAST(floor(value * 10) AS DOUBLE) END AS input_tokens,
  CASE WHEN event_type IN ('signup','click') OR k < 5 THEN NULL ELSE CAST(floor(value * 3) AS DOUBLE) END AS output_tokens,
  CASE WHEN event_type = 'purchase' THEN CAST(k AS DOUBLE) ELSE NULL END AS cost,
  CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(floor(value) AS DOUBLE) END AS latency_ms,
  CASE WHEN event_type = 'error' THEN CAST(k % 4 AS DOUBLE) ELSE NULL END AS retry_count,
  CASE WHEN event_type = 'error' THEN k % 6 = 0 ELSE NULL END AS rate_limited,
  CASE WHEN event_type = 'signup' THEN 'tests' ELSE NULL END AS outcome_kind,
  CASE WHEN event_type = 'signup' THEN CASE WHEN k % 2 = 0 THEN 'passed' ELSE 'failed' END ELSE NULL END AS outcome_status,
  CASE WHEN event_type = 'signup' AND k % 3 = 0 THEN 'session_id' WHEN event_type = 'signup' AND k % 12 = 1 THEN 'event_id' ELSE NULL END AS correlation_basis,
  CASE WHEN event_type = 'signup' AND k % 6 = 0 THEN concat('session-', CAST(user_id AS {string}))
       WHEN event_type = 'signup' AND k % 12 = 1 THEN concat('evt-', CAST(event_id + 20 - (k % 5) * 10 AS {string})) ELSE NULL END AS correlation_id,
  CASE WHEN event_id % 4 = 0 THEN 'provider' ELSE NULL END AS pv_usage,
  CASE WHEN event_id % 2 = 0 THEN 'observed' ELSE NULL END AS pv_performance,
  CASE WHEN event_id % 5 = 0 THEN 'client' ELSE NULL END AS pv_latency,
  CASE WHEN event_id % 3 = 0 THEN 'inferred' ELSE NULL END AS pv_execution,
  CASE WHEN event_id % 7 = 0 THEN 'client' ELSE NULL END AS pv_session,
  CASE WHEN k % 2 = 0 THEN 'derived' ELSE NULL END AS pv_behavior
FROM (SELECT *, CAST({k} AS {integer}) AS k FROM {table}) raw
"""


def envelope_sql(engine: str, table: str = "events") -> str:
    """SELECT text of the derivation for ``engine`` ('spark' or 'duckdb')."""
    if engine == "spark":
        return _TEMPLATE.format(
            string="STRING", integer="INT", table=table,
            k="get_json_object(props,'$.k')",
            observed="CAST(ts AS TIMESTAMP)",
            received="CAST(ts AS TIMESTAMP) + make_dt_interval(0,0,CAST(event_id % 7 AS INT),0)",
        )
    if engine == "duckdb":
        return _TEMPLATE.format(
            string="VARCHAR", integer="INTEGER", table=table,
            k="regexp_extract(props,'[0-9]+')",
            observed="ts", received="ts + to_minutes(CAST(event_id % 7 AS BIGINT))",
        )
    raise ValueError(f"unknown engine: {engine}")


PROVENANCE_SQL = (
    "map('usage', pv_usage, 'performance', pv_performance, 'performance.latency_ms', pv_latency, "
    "'execution', pv_execution, 'execution.session', pv_session, 'behavior', pv_behavior)"
)


def flat_events(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """Flat event rows from a raw ``events`` frame, with their provenance map."""
    sql = envelope_sql("spark", "{raw}")
    return (
        spark.sql(f"SELECT *, {PROVENANCE_SQL} AS provenance_fields FROM ({sql})", raw=raw)
        .drop("pv_usage", "pv_performance", "pv_latency", "pv_execution", "pv_session", "pv_behavior")
    )
