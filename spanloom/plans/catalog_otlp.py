"""Registered queries of the OTLP sources: payloads are built from the events and decoded again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import normalize as N
from ..sources import collector, otlp
from . import inputs
from .registry import Registry

W = inputs.WITH
NS = "telemetry"


def attribute(key: str, member: str, value: Column) -> Column:
    """{key, value: {member: value}} or NULL; all five scalar members share one struct type."""
    members = ("stringValue", "intValue", "doubleValue", "boolValue")
    parts = [(value.cast("boolean" if m == "boolValue" else "double" if m == "doubleValue" else "string")
              if m == member else F.lit(None).cast("boolean" if m == "boolValue" else "double" if m == "doubleValue" else "string")).alias(m)
             for m in members]
    return F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), F.struct(*parts).alias("value")))


def nanos(column: str, plus_ms: Column | None = None) -> Column:
    us = F.unix_micros(column)
    value = us * 1000 if plus_ms is None else us * 1000 + plus_ms.cast("bigint") * 1_000_000
    return value.cast("string")


def attributes() -> Column:
    c = F.col
    return F.array_compact(F.array(
        attribute("gen_ai.request.model", "stringValue", c("model")),
        attribute("gen_ai.system", "stringValue", F.nullif(c("provider"), F.lit("unknown"))),
        attribute("gen_ai.usage.input_tokens", "intValue", c("input_tokens").cast("bigint")),
        attribute("output_tokens", "doubleValue", c("output_tokens")),
        attribute(f"{NS}.session.id", "stringValue", c("session_id")),
        attribute("workflow.run_id", "stringValue", c("workflow_id")),
        attribute(f"{NS}.agent.id", "stringValue", c("agent_id")),
        attribute(f"{NS}.task.id", "stringValue", c("task_id")),
        attribute(f"{NS}.operation.kind", "stringValue", F.when(c("event_type") == "tool.operation", "Tool")),
        attribute(f"{NS}.tool.call.count", "stringValue", c("tool_call_count").cast("bigint").cast("string")),
        attribute(f"{NS}.agent.failure", "boolValue", c("agent_failure")),
        attribute("attempt", "intValue", (c("retry_count") + 1).cast("bigint")),
        attribute("error.type", "stringValue", F.when(c("rate_limited"), "rate_limit_exceeded").when(c("timeout"), "deadline_exceeded")),
        attribute("http.status_code", "intValue", F.when(c("aborted"), 504)),
        attribute("success", "stringValue", F.when(c("tool_failure"), "no")),
        attribute("my.password", "stringValue", c("skill")), attribute("my.lane", "stringValue", c("lane")),
    ))


def resource() -> Column:
    return F.struct(F.array_compact(F.array(
        attribute("service.name", "stringValue", F.col("client")),
        attribute(f"{NS}.project.id", "stringValue", F.when(F.col("auth_mode") == "api", F.col("project_id"))),
        attribute(f"{NS}.project.root", "stringValue", F.concat(F.lit("C:\\Work\\"), F.col("project_id"))),
    )).alias("attributes"))


def span_payloads(e: DataFrame) -> DataFrame:
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"),
        F.when(F.col("parent_event_id").isNotNull(), F.concat(F.lit("p-"), "parent_event_id")).alias("parentSpanId"),
        F.when(F.col("provider") == "unknown", "work").otherwise("chat").alias("name"),
        F.when(F.col("branch") == "dev", nanos("observed_at")).when(F.col("lane") == "primary", nanos("observed_at")).alias("startTimeUnixNano"),
        nanos("observed_at", F.col("duration_ms")).alias("endTimeUnixNano"), attributes().alias("attributes"),
        F.struct(F.when(F.col("status") == "failed", "STATUS_CODE_ERROR").when(F.col("status") == "succeeded", "1").alias("code")).alias("status"),
    )
    body = F.struct(F.array(F.struct(resource().alias("resource"), F.array(F.struct(
        F.struct(F.lit("sdk").alias("name"), F.lit("9").alias("version")).alias("scope"), F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    return e.select("arrival_seq", F.to_json(body).alias("payload"))


def log_payloads(e: DataFrame) -> DataFrame:
    record = F.struct(
        F.when(F.col("lane") == "primary", nanos("observed_at")).alias("timeUnixNano"), nanos("observed_at").alias("observedTimeUnixNano"),
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), attributes().alias("attributes"))
    body = F.struct(F.array(F.struct(resource().alias("resource"), F.array(F.struct(
        F.struct(F.lit("sdk").alias("name")).alias("scope"), F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    return e.select("arrival_seq", F.to_json(body).alias("payload"))


def metric_payloads(e: DataFrame) -> DataFrame:
    point = lambda value, agent: F.struct(
        nanos("observed_at").alias("timeUnixNano"), value.alias("asDouble"),
        F.array(attribute(f"{NS}.agent.id", "stringValue", agent)).alias("attributes"))
    points = F.array(point(F.col("duration_ms"), F.col("agent_id")), point(F.col("duration_ms") + 1, F.lit("agent-0")),
                     point(F.col("duration_ms") + 2, F.col("agent_id")))
    metric = F.struct(F.lit("op.duration").alias("name"), F.lit("ms").alias("unit"),
                      F.struct(F.when(F.col("status") != "failed", points).alias("dataPoints")).alias("gauge"))
    body = F.struct(F.array(F.struct(resource().alias("resource"), F.array(F.struct(
        F.struct(F.lit("sdk").alias("name")).alias("scope"), F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    return e.select("arrival_seq", F.to_json(body).alias("payload"))




def shown(rows: DataFrame, *more) -> DataFrame:
    return rows.select(
        "event_type", "observed_at", F.col("source.name").alias("source_name"), F.col("project.project_id").alias("project_id"),
        F.col("project.worktree").alias("worktree"), "execution.session_id", "execution.workflow_id", "execution.agent_id",
        "execution.task_id", "llm.provider", "llm.model", "llm.client", "usage.input_tokens", "usage.output_tokens",
        "performance.duration_ms", "reliability.status", "reliability.error_kind", "reliability.retry_count",
        "reliability.rate_limited", "reliability.timeout", "reliability.agent_failure", "behavior.tool_call_count", "extensions",
        F.try_element_at("provenance.fields", F.lit("reliability.error_kind")).alias("error_evidence"),
        F.try_element_at("provenance.fields", F.lit("reliability.rate_limited")).alias("rate_evidence"), *more,
    )


_ROOT = "sha256(lower(concat('C:/Work/', project_id)))"
_COMMON = f"""client AS source_name, CASE WHEN auth_mode = 'api' THEN project_id ELSE concat('local_sha256:', {_ROOT}) END AS project_id,
  concat('worktree_sha256:', {_ROOT}) AS worktree, session_id, workflow_id, agent_id, task_id, provider, model, client,
  input_tokens, output_tokens, retry_count, agent_failure, tool_call_count,
  concat('{{"unknown_attributes":{{', CASE WHEN input_tokens IS NULL THEN '' ELSE concat('"gen_ai.usage.input_tokens":', CAST(CAST(input_tokens AS BIGINT) AS VARCHAR), ',') END, CASE WHEN aborted THEN '"http.status_code":504,' ELSE '' END, '"my.lane":"', lane, '"',
    CASE WHEN skill IS NULL THEN '' ELSE ',"my.password":"[REDACTED]"' END, ',"telemetry.project.root":"[PATH_REDACTED]"}}}}') AS extensions,
  CASE WHEN rate_limited THEN 'rate_limit_exceeded' WHEN timeout THEN 'deadline_exceeded' WHEN aborted THEN @FB@ END AS error_kind,
  CASE WHEN rate_limited OR timeout THEN 'client' WHEN aborted THEN 'derived' ELSE 'unknown' END AS error_evidence,
  CASE WHEN rate_limited THEN TRUE WHEN timeout THEN FALSE END AS rate_limited,
  CASE WHEN rate_limited THEN 'client' ELSE 'unknown' END AS rate_evidence"""


def register(reg: Registry) -> None:
    def ev(fn):
        return lambda spark, d: fn(inputs.spread_events(spark, d))

    reg.add(
        "otlp_trace_events",
        ev(lambda e: shown(N.accepted(otlp.events_from_spans(span_payloads(e), "arrival_seq", ns=NS)), "event_id", "execution.parent_event_id")),
        f"""{W} SELECT concat('otel:', trace_id, ':', span_id) AS event_id,
          CASE WHEN parent_event_id IS NULL THEN NULL ELSE concat('otel:', trace_id, ':p-', parent_event_id) END AS parent_event_id,
          CASE WHEN event_type = 'tool.operation' THEN 'tool.operation' WHEN provider <> 'unknown' THEN 'model.operation' ELSE 'otel.span' END AS event_type,
          observed_at, duration_ms, {_COMMON.replace('@FB@', "'timeout'")},
          CASE WHEN NOT COALESCE(rate_limited, FALSE) AND NOT COALESCE(timeout, FALSE) AND COALESCE(aborted, FALSE) THEN TRUE END AS timeout,
          CASE WHEN status = 'failed' OR agent_failure OR tool_failure OR aborted OR rate_limited THEN 'failed'
            WHEN status = 'succeeded' THEN 'succeeded' ELSE 'unknown' END AS status
          FROM ev WHERE branch = 'dev' OR lane = 'primary'""",
    )
    reg.add(
        "otlp_trace_rejects",
        ev(lambda e: N.rejected(otlp.events_from_spans(span_payloads(e), "arrival_seq", ns=NS), "arrival_seq").select("arrival_seq", "reason")),
        f"{W} SELECT arrival_seq, 'timestamp must be an integer number of nanoseconds' AS reason FROM ev "
        "WHERE NOT (COALESCE(branch, '') = 'dev' OR lane = 'primary')",
    )
    reg.add(
        "otlp_log_events",
        ev(lambda e: shown(N.accepted(otlp.events_from_logs(log_payloads(e), "arrival_seq", ns=NS)), "arrival_seq")),
        f"""{W} SELECT arrival_seq,
          CASE WHEN event_type = 'tool.operation' THEN 'tool.operation' ELSE 'model.operation' END AS event_type,
          observed_at, CAST(NULL AS DOUBLE) AS duration_ms, {_COMMON.replace('@FB@', "'timeout'")},
          CASE WHEN COALESCE(timeout AND NOT rate_limited, FALSE) OR COALESCE(aborted, FALSE) THEN TRUE END AS timeout,
          CASE WHEN rate_limited OR timeout OR aborted OR agent_failure OR tool_failure THEN 'failed'
            WHEN provider <> 'unknown' THEN 'succeeded' ELSE 'unknown' END AS status FROM ev""",
    )
    reg.add(
        "otlp_metric_events",
        ev(lambda e: N.accepted(otlp.events_from_metrics(metric_payloads(e), "arrival_seq", ns=NS)).select(
            "arrival_seq", "event_type", "observed_at", "execution.agent_id", F.col("source.name").alias("source_name"),
            F.get_json_object("attributes", "$['metric.points'][0].value").cast("double").alias("first_value"),
            F.get_json_object("attributes", "$['metric.points'][2].value").cast("double").alias("third_value"))),
        f"""{W} SELECT arrival_seq, 'telemetry.metric' AS event_type, observed_at, agent_id, client AS source_name, duration_ms AS first_value,
          CASE WHEN agent_id = 'agent-0' THEN duration_ms + 2 END AS third_value FROM ev WHERE status <> 'failed'
          UNION ALL BY NAME SELECT arrival_seq, 'telemetry.metric' AS event_type, observed_at, 'agent-0' AS agent_id, client AS source_name,
          duration_ms + 1 AS first_value, CAST(NULL AS DOUBLE) AS third_value FROM ev WHERE status <> 'failed' AND agent_id <> 'agent-0'""",
    )
    reg.add(
        "otlp_metric_rejects",
        ev(lambda e: N.rejected(otlp.events_from_metrics(metric_payloads(e), "arrival_seq", ns=NS), "arrival_seq").select("arrival_seq", "reason")),
        f"{W} SELECT arrival_seq, 'malformed metric' AS reason FROM ev WHERE status = 'failed'",
    )

    # Bad elements at every level leave their siblings alone and say where they stood.
    def spoiled(rows: DataFrame, names: tuple[str, str, str]) -> DataFrame:
        text = F.col("payload")
        for name, bad in zip(names, ("null,", '"x",', '7,["y"],')):
            text = F.replace(text, F.lit(f'"{name}":['), F.lit(f'"{name}":[{bad}'))
        return rows.withColumn("payload", text)

    signals = {
        "trace": (otlp.events_from_spans, span_payloads, ("resourceSpans", "scopeSpans", "spans"), "traces",
                  "CASE WHEN NOT (COALESCE(branch, '') = 'dev' OR lane = 'primary') THEN 'timestamp must be an integer number of nanoseconds' END"),
        "log": (otlp.events_from_logs, log_payloads, ("resourceLogs", "scopeLogs", "logRecords"), "logs", "NULL"),
        "metric": (otlp.events_from_metrics, metric_payloads, ("resourceMetrics", "scopeMetrics", "metrics"), "metrics",
                   "CASE WHEN status = 'failed' THEN 'malformed metric' END"),
    }
    for signal, (decode, make, names, plural, own) in signals.items():
        outer, middle, inner = names
        places = (f"{outer}[0]", f"{outer}[1].{middle}[0]", f"{outer}[1].{middle}[1].{inner}[0]", f"{outer}[1].{middle}[1].{inner}[1]")
        bad = ", ".join(f"'malformed {plural} record: {p} must be an object'" for p in places)
        copies = "CASE WHEN status <> 'failed' AND agent_id <> 'agent-0' THEN 2 ELSE 1 END" if signal == "metric" else "1"
        reg.add(
            f"otlp_{signal}_siblings",
            ev(lambda e, d=decode, m=make, n=names: d(spoiled(m(e), n), "arrival_seq", ns=NS).select(
                "arrival_seq", F.get("reasons", F.lit(0)).alias("reason"), F.col("event_id").startswith("malformed:").alias("part"))),
            f"""{W} SELECT arrival_seq, {own} AS reason, FALSE AS part FROM ev, range({copies}) UNION ALL
              SELECT arrival_seq, unnest([{bad}]) AS reason, TRUE AS part FROM ev""",
        )
    deep = ('{"key":"custom.deep","value":{"arrayValue":{"values":[{"kvlistValue":{"values":[{"key":"lane","value":'
            '{"arrayValue":{"values":[{"stringValue":"%s"},{"intValue":"%d"}]}}}]}},{"boolValue":true}]}}}')
    nested = ('{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"t","spanId":"%s","startTimeUnixNano":"1754575200000000000",'
              f'"attributes":[{deep}]' "}]}]}]}")
    reg.add(
        "otlp_nested_values",
        ev(lambda e: otlp.events_from_spans(e.select("arrival_seq", F.format_string(
            nested, F.col("arrival_seq").cast("string"), "lane", "arrival_seq").alias("payload")), "arrival_seq", ns=NS).select("arrival_seq", "extensions")),
        f"""{W} SELECT arrival_seq, concat('{{"unknown_attributes":{{"custom.deep":[{{"lane":["', lane, '",', arrival_seq, ']}},true]}}}}') AS extensions FROM ev""",
    )

    # Shared attribute policy ahead of the mapping.
    def bags(e: DataFrame) -> DataFrame:
        c = F.col
        return e.select("arrival_seq", F.map_filter(F.create_map(
            F.lit("service.name"), c("client"), F.lit("session.id"), c("session_id"), F.lit("custom.key"), c("lane"),
            F.lit("process.cwd"), F.concat(F.lit("/w/"), c("project_id")), F.lit("error.message"), c("error_kind"),
            F.lit(f"{NS}.skill"), c("skill"), F.lit("model"), F.concat(F.lit("Bearer "), c("model"))),
            lambda k, v: v.isNotNull()).alias("bag"))

    def policed(e: DataFrame) -> DataFrame:
        with_id = collector.with_project_id(F.col("bag"), NS)
        out = collector.drop_private(collector.stamp(collector.allow(with_id, NS), NS), NS)
        return bags(e).select("arrival_seq", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(out)))).alias("bag"))

    reg.add(
        "collector_policy", ev(policed),
        f"""{W} SELECT arrival_seq, concat('{{"model":"****","service.name":"', client, '","session.id":"', session_id, '","telemetry.normalization.version":"1.0","telemetry.project.id":"local_sha256:',
          sha256(concat('/w/', project_id)), CASE WHEN skill IS NULL THEN '"' ELSE concat('","telemetry.skill":"', skill, '"') END,
          ',"telemetry.telemetry_plane":"out_of_band"}}') AS bag FROM ev""",
    )

    # The same policy on whole payloads, between receiving and mapping.
    pair = lambda key, value: '{"key":"%s","value":{"stringValue":"%s"}}' % (key, value)
    sent = '{"resourceX":[{"resource":{"attributes":[%s]},"scopeX":[{"X":[%s]}]},null]}' % (
        ",".join([pair("service.name", "%1$s"), pair("process.cwd", "/w/%2$s"), pair("custom.key", "%1$s"), pair(f"{NS}.telemetry_plane", "in_band")]), "RECORD")
    own = ",".join([pair("gen_ai.request.model", "Bearer %3$s"), pair("session.id", "%4$s"), pair("gen_ai.prompt", "words"), pair("my.lane", "x"),
                    '{"key":"gen_ai.usage.input_tokens","value":{"intValue":"7"}}'])
    time = '"timeUnixNano":"1754575200000000000"'
    noted = ",".join([pair("event.name", "sk-abcdefgh12345"), pair("gen_ai.prompt", "words"), pair("other", "x")])
    forms = {
        "traces": ("resourceSpans", "scopeSpans", "spans", otlp.events_from_spans, "events[0].attributes",
                   '{"traceId":"t","spanId":"%5$s","startTimeUnixNano":"1754575200000000000","attributes":[' + own + '],"events":[{"name":"e","attributes":[' + noted + "]}]}",
                   '[{"key":"event.name","value":{"stringValue":"****"}}]'),
        "logs": ("resourceLogs", "scopeLogs", "logRecords", otlp.events_from_logs, "body.stringValue",
                 "{" + time + ',"attributes":[' + own + '],"body":{"stringValue":"my words %5$s"}}', "[CONTENT_REDACTED]"),
        "metrics": ("resourceMetrics", "scopeMetrics", "metrics", otlp.events_from_metrics, "sum.dataPoints[0].asInt",
                    '{"name":"m","sum":{"dataPoints":[{' + time + ',"asInt":"3","attributes":[' + own + "]}]}}", "3"),
    }
    for signal, (outer, middle, inner, decode, place, record, left) in forms.items():
        text = sent.replace("RECORD", record).replace("resourceX", outer).replace("scopeX", middle).replace('"X"', f'"{inner}"')

        def through(e: DataFrame, signal=signal, text=text, decode=decode, path=f"$.{outer}[0].{middle}[0].{inner}[0].{place}") -> DataFrame:
            c = F.col
            made = e.select("arrival_seq", F.format_string(
                text, c("client"), c("project_id"), c("model"), c("session_id"), c("arrival_seq").cast("string")).alias("payload"))
            got = decode(collector.police(made, signal, ns=NS), "arrival_seq", "payload", ns=NS)
            return got.where(F.size("reasons") == 0).select(
                "arrival_seq", c("project.project_id").alias("project_id"), c("llm.model").alias("model"), c("execution.session_id").alias("session_id"),
                c("usage.input_tokens").alias("input_tokens"), F.get_json_object("extensions", "$.unknown_attributes").alias("unknown"),
                F.get_json_object("payload", path).alias("policed"),
                F.get_json_object("payload", f"$.{path.split('.')[1].split('[')[0]}[0].resource.attributes[*].key").alias("resource_keys"))

        keys = '["service.name","telemetry.project.id","telemetry.telemetry_plane","telemetry.normalization.version"]'
        # The metric mapping takes usage and session from other keys; what it does not know is kept as unknown.
        stamps = '"telemetry.normalization.version":"1.0","telemetry.telemetry_plane":"out_of_band"'
        own_rest = "" if signal == "metrics" else "\"gen_ai.usage.input_tokens\":7,\"session.id\":\"' || session_id || '\","
        reg.add(
            f"otlp_policy_{signal}", ev(through),
            f"""{W} SELECT arrival_seq, 'local_sha256:' || sha256('/w/' || project_id) AS project_id, '****' AS model,
              {"NULL::VARCHAR" if signal == "metrics" else "session_id"} AS session_id, {"NULL" if signal == "metrics" else "7.0"}::DOUBLE AS input_tokens,
              '{{{own_rest}{stamps}}}' AS unknown, '{left}' AS policed, '{keys}' AS resource_keys FROM ev""",
        )
