"""Raw formats: malformed parts, rule details, and the registered queries at the smallest scale."""

import json

import pytest

from spanloom.operators import normalize as N
from spanloom.plans.catalog import catalog
from spanloom.sources import collector, hooks, otlp, outcomes, responses
from pyspark.sql import functions as F


def payloads(spark, *docs):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "n long, payload string")


def attrs(**values):
    out = []
    for key, v in values.items():
        member = "boolValue" if isinstance(v, bool) else "intValue" if isinstance(v, int) else "doubleValue" if isinstance(v, float) else "stringValue"
        out.append({"key": key.replace("__", "."), "value": {member: str(v) if member == "intValue" else v}})
    return out


def trace(*spans, resource=()):
    return {"resourceSpans": [{"resource": {"attributes": list(resource)}, "scopeSpans": [{"scope": {"name": "sdk"}, "spans": list(spans)}]}]}


def span(i, *, start="1754575200000000000", **more):
    return {"traceId": "t", "spanId": f"s{i}", "name": "chat", "startTimeUnixNano": start, **more}


def test_bad_spans_do_not_stop_their_siblings(spark):
    docs = [trace(span(1), span(2, start="x"), span(3, attributes=attrs(input_tokens="7"))), {"resourceSpans": 5}, {"resourceSpans": [{"scopeSpans": []}]}, {}]
    rows = otlp.events_from_spans(payloads(spark, *docs), "n")
    got = [(r.n, r.event_id, bool(r.reasons)) for r in rows.collect()]
    assert sorted((n, bad) for n, _, bad in got) == [(0, False), (0, True), (0, True), (1, True), (2, True), (3, True)]
    assert N.accepted(rows).first().event_id == "otel:t:s1"


def test_span_status_errors_and_lists(spark):
    many = {"key": "telemetry.tool.names", "value": {"arrayValue": {"values": [{"stringValue": "a"}, {"stringValue": "b"}]}}}
    reasons = {"key": "gen_ai.response.finish_reasons", "value": {"arrayValue": {"values": [{"stringValue": "stop"}, {"stringValue": "rate_limit"}]}}}
    spans = [
        span(1, attributes=attrs(http__status_code=504), endTimeUnixNano="1754575200002500000"),
        span(2, attributes=[many, reasons], status={"code": "STATUS_CODE_OK"}),
        span(3, attributes=attrs(error__code="429", attempt=3), parentSpanId="s1"),
        span(4, attributes=attrs(telemetry__rate_limited="maybe", success="no", a="1", service__name="x")),
    ]
    rows = {r.execution.span_id: r for r in otlp.events_from_spans(payloads(spark, trace(*spans, resource=attrs(service__name="Claude-Code")))).collect()}
    a, b, c, d = (rows[f"s{i}"] for i in range(1, 5))
    assert (a.reliability.error_kind, a.reliability.timeout, a.reliability.status, a.performance.duration_ms) == ("timeout", True, "failed", 2.5)
    assert a.llm.provider == "anthropic" and a.event_type == "model.operation" and a.reliability.retry_count is None
    assert b.behavior.tool_names == ["a", "b"] and b.behavior.tool_call_count == 2.0 and b.reliability.rate_limited is True and b.reliability.status == "failed"
    assert (c.reliability.error_kind, c.reliability.rate_limited, c.reliability.retry_count) == ("rate_limited", True, 2.0)
    assert c.execution.parent_event_id == "otel:t:s1" and c.provenance.fields["reliability.rate_limited"] == "derived"
    assert d.reliability.rate_limited is None and d.reliability.status == "failed" and b.performance.duration_ms is None


def test_metric_points_group_by_context(spark):
    point = lambda v, agent, **kw: {"timeUnixNano": "1754575200000000000", "asInt": str(v), "attributes": attrs(telemetry__agent__id=agent), **kw}
    body = lambda *points: {"resourceMetrics": [{"scopeMetrics": [{"scope": {}, "metrics": [
        {"name": "m", "gauge": {"dataPoints": list(points)}}, {"name": "bad", "sum": {"dataPoints": [{"timeUnixNano": "1", "asDouble": "x"}]}}]}]}]}
    rows = otlp.events_from_metrics(payloads(spark, body(point(1, "a"), point(2, "b"), point(3, "a"), *[point(9, "c")] * 70)), "n").collect()
    good = {r.execution.agent_id: json.loads(r.attributes)["metric.points"] for r in rows if not r.reasons}
    assert [p["value"] for p in good["a"]] == [1.0, 3.0] and len(good["b"]) == 1 and len(good["c"]) == 70
    assert sum(1 for r in rows if r.reasons) == 1 and len({r.event_id for r in rows if not r.reasons}) == 3


def test_response_status_rules(spark):
    docs = [{"id": "r", "error": "boom"}, {"error": {"type": "Rate-Limit"}}, {"status": "504"}, {"error": {}}, {"status": 200, "rate_limited": False}, {"agent_failed": True}]
    rows = payloads(spark, *docs).select(
        "n", F.col("payload").alias("response_json"), *[F.lit(v).alias(k) for k, v in dict(provider="x", client="c", route="direct", auth_mode="api", usage_source="provider").items()],
        F.timestamp_seconds(F.lit(0)).alias("observed_at"), F.lit(1.0).alias("latency_ms"), F.lit(None).cast("double").alias("duration_ms"))
    got = {r.n: (r.reliability.status, r.reliability.error_kind, r.reliability.rate_limited, r.reliability.timeout)
           for r in responses.events_from_responses(rows, "n").collect()}
    assert got[0] == ("failed", "provider_error", None, None)
    assert got[1] == ("failed", "rate_limited", True, None)
    assert got[2] == ("failed", "timeout", None, True)
    assert got[3] == ("succeeded", None, None, None)
    assert got[4] == ("succeeded", None, False, None)
    assert got[5] == ("failed", "provider_error", None, None)


def test_hook_fields(spark):
    docs = [{"hook_event_name": "Pre Tool", "params": {"sessionId": "s/1", "tool": "a b"}, "error": 0}, {"event": "interrupt", "session": "bad id!"}]
    rows = payloads(spark, *docs).select("n", F.lit("GEMINI-cli ").alias("client"), F.col("payload").alias("payload_json"))
    a, b = hooks.events_from_hooks(rows, "n").orderBy("n").collect()
    assert (a.event_type, a.execution.session_id, a.behavior.tool_names, a.reliability.tool_failure) == ("tool.operation", "s/1", ["a_b"], True)
    assert (a.llm.client, a.llm.provider) == ("gemini-cli", "google")
    assert (b.event_type, b.execution.session_id, b.reliability.status, b.reliability.aborted) == ("agent.lifecycle", None, "aborted", True)


def test_outcome_records_need_kind_and_status(spark):
    rows = spark.createDataFrame([("tests", "PASSED"), (" ", "x")], "kind string, status string").withColumn("observed_at", F.timestamp_seconds(F.lit(0)))
    got = outcomes.events_from_outcomes(rows).orderBy("outcome.kind").collect()
    assert [bool(r.reasons) for r in got] == [True, False] and got[1].reliability.status == "succeeded"


def test_span_event_mask_and_record_delete_list(spark):
    bag = F.create_map(*[F.lit(x) for kv in {"gen_ai.prompt": "p", "telemetry.tool_input": "x", "k": "v"}.items() for x in kv])
    row = spark.range(1).select(collector.mask_span_event(bag).alias("a"), collector.drop_private(bag, record=True).alias("b"), collector.mask_body(F.lit("x")).alias("c")).first()
    assert row.a["gen_ai.prompt"] == collector.BODY_MASK and row.b == {"k": "v"} and row.c == collector.BODY_MASK


@pytest.mark.parametrize("name", ["comparison", "dimension_context", "measurement_facts", "series_events_by_agent_total", "report_model_success_ratio",
                                  "correlation_degrees", "samples_avg_by_average", "masked_documents"])
def test_queries_match_their_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as E
    from tools.check_queries import rows_of

    con = duckdb.connect()
    for table in ("events", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    cur = con.execute(E.oracle_sql()[name])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    df = E.queries()[name](spark, sf)
    assert rows_of(df.columns, df.collect()) == want


def test_every_query_has_a_check(spark):
    import __spark_entry__ as E

    own = catalog()
    assert set(own.callables()) == set(own.checks()) and set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).count() > 0


def test_registry_needs_no_session():
    """The contract functions run before any session exists."""
    import subprocess
    import sys

    code = ("import __spark_entry__ as E; from spanloom.plans.catalog import catalog; own = catalog(); "
            "assert len(own.callables()) == len(own.checks()) > 200 and set(E.oracle_sql()) <= set(E.queries())")
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0


def test_queries_of_one_registry_do_not_share_names(spark, tmp_path):
    from pyspark.sql import Row

    rows = [Row(event_id=i, user_id=i, event_type="view", value=1.0, props='{"k": %d}' % i) for i in range(20)]
    made = spark.createDataFrame(rows).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id")))
    made.write.parquet(str(tmp_path / "events.parquet"))
    queries = catalog().callables()
    assert queries["otlp_log_events"](spark, str(tmp_path)).count() == 20
    got = {r.sent_id: r.reasons for r in queries["jsonl_rejects"](spark, str(tmp_path)).collect()}
    assert got["evt-9"] == "invalid JSON" and got["evt-1"].startswith("observed_at must be ISO-8601") and "evt-0" not in got


def test_hook_numbers_come_from_every_place_once(spark):
    docs = [
        {"id": "a", "data": {"usage": {"input_tokens": 5}}}, {"id": "b", "input_tokens": -1, "usage": {"input_tokens": 6}},
        {"id": "c", "event": "Stop", "params": {"inputTokens": 7}}, {"id": "d", "input_tokens": "8"}, {"id": "e", "data": None, "input_tokens": None},
    ]
    rows = spark.createDataFrame([(json.dumps(d), "x") for d in docs], "payload_json string, client string")
    out = hooks.events_from_hooks(rows)
    assert {r.event_id: r.usage.input_tokens for r in out.collect()} == {"a": 5.0, "b": 6.0, "c": 7.0, "d": None, "e": None}
    # Every nested object is taken from the payload once.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$['data']['usage']") == 0


def test_policy_of_metrics_keeps_kinds_apart(spark):
    point = {"timeUnixNano": "1754575200000000000", "asInt": "3", "attributes": attrs(model="m", secret__key="x")}
    metric = {"name": "n", "gauge": {"dataPoints": [point]}, "sum": {"dataPoints": [point, point]}}
    doc = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [metric, {"name": "o"}, None]}]}]}
    out = collector.police(payloads(spark, doc), "metrics")
    one, two, bad = json.loads(out.first().payload)["resourceMetrics"][0]["scopeMetrics"][0]["metrics"]
    assert [len(one[k]["dataPoints"]) for k in ("gauge", "sum")] == [1, 2] and "histogram" not in one
    assert [a["key"] for a in one["sum"]["dataPoints"][1]["attributes"]] == ["model"]
    assert two == {"name": "o"} and bad is None
    # One reading of each kind, whatever the number of kinds: 904,132 characters when kinds were nested in each other, 115,917 now.
    assert len(out._jdf.queryExecution().analyzed().toString()) < 300_000


def test_unused_fields_of_an_envelope_are_not_computed(spark):
    rows = N.accepted(otlp.events_from_spans(payloads(spark, trace(span(1), span(2, start="x"))), "n"))
    plan = rows.select("event_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "unknown_attributes" not in plan and [r.event_id for r in rows.collect()] == ["otel:t:s1"]


def test_secret_hint_misses_no_secret(spark):
    from spanloom.functions import privacy as P

    texts = ["Bearer\tabcd12345", "BASIC abcd12345", "SK-abcdefgh1", "xAI-abcdefgh1", "gsk-abcdefgh1", "aIzA" + "x" * 16, "AIZAabcdefghijklmnop",
             "AKIA" + "A" * 16, "ASIA" + "0" * 16, "token=abcdefgh1", "password : abcdefgh1", "session-12 4567", "plainwords"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.a == r.b for r in df.select(P.looks_secret(F.col("t")).alias("a"), F.col("t").rlike(P.SECRET_VALUE).alias("b")).collect())
