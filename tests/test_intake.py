"""Normalization, redaction, intake and correlation on small literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import privacy as P
from spanloom.operators import aggregates as A
from spanloom.operators import correlate as C
from spanloom.operators import filters as FL
from spanloom.operators import intake as I
from spanloom.operators import normalize as N
from spanloom.operators import redact as R
from spanloom.operators import retention as RT
from spanloom.operators import skew as K
from spanloom.operators.tables import Tables, ingest
from spanloom.sources import jsonl
from spanloom.streaming.intake import read_text_stream, start_intake, tumbling_counts


def event(event_id, at="2026-08-07T14:00:00Z", **sections):
    return {"schema_version": "1.0", "event_id": event_id, "event_type": "model.operation", "observed_at": at, **sections}


def frame(spark, docs):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "arrival_seq long, line string")


DAY = [
    event("e1", usage={"input_tokens": 12, "source": "provider"}, project={"project_id": "p:a"}, llm={"provider": "anthropic", "model": "m1"},
          execution={"session_id": "s1", "task_id": "t1"}, behavior={"tool_call_count": 3, "files_changed_count": 2},
          reliability={"status": "succeeded"}, provenance={"fields": {"usage": "provider", "execution": "client"}}),
    event("e2", "2026-08-07T14:01:00Z", project={"project_id": "p:a"}, llm={"provider": "openai", "model": "m2"},
          execution={"session_id": "s1", "parent_event_id": "e1"}, behavior={"tool_calls": [{"name": "x"}, "y"]},
          reliability={"status": "failed", "agentFailure": True, "rework": [1], "rate_limited": False}),
    event("o1", "2026-08-07T14:02:00Z", event_type="outcome.tests", project={"project_id": "p:a"}, execution={"session_id": "s1"},
          outcome={"kind": "tests", "status": "passed", "correlation_basis": "session_id", "evidence_source": "ci"}),
    event("e3", "2026-08-07T14:03:00Z", execution={"session_id": "s1"}),
    event("o2", "2026-08-07T14:04:00Z", outcome={"kind": "review", "status": "failed", "correlation_basis": "event_id", "correlation_id": "late"}),
    event("late", "2026-08-07T13:59:00Z", received_at="2026-08-07T15:00:00Z", custom={"cwd": "/home/me"}),
]


def test_ingest_twice_and_again_after_failure(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "store"))
    replay = [{**DAY[0], "received_at": "2026-08-07T16:00:00Z"}, {**DAY[1], "performance": {"latency_ms": 5}}, event("n1"), event("n1"),
              "not json", {"event_id": "x"}]
    first = ingest(tables, jsonl.events_from_lines(frame(spark, DAY), "arrival_seq"), 0).first()
    assert (first.inserted, first.duplicate, first.conflict, first.rejected, first.verdict) == (6, 0, 0, 0, "accepted")
    for _ in range(2):  # the second run stands for a retry of the same batch
        second = ingest(tables, jsonl.events_from_lines(frame(spark, replay), "arrival_seq"), 1).first()
        assert (second.inserted, second.duplicate, second.conflict, second.rejected) == (1, 2, 1, 2)
        assert second.verdict == "accepted_with_rejections"
    stored = tables.read("events")
    assert stored.count() == 7 and tables.read("ingest_ledger").count() == 10
    assert tables.read("event_conflicts").count() == 1 and tables.read("rejects").count() == 2
    s = A.summary(stored).first()
    assert (s.events, s.failures, s.agent_failures, s.tool_calls, s.files_changed, s.rework_loops) == (7, 1, 1, 5.0, 2.0, 1.0)
    facts = {(r.event_id, r.field_path): r for r in tables.read("measurement_facts").collect()}
    assert facts["e1", "usage.input_tokens"].evidence_quality == "reported" and facts["e2", "behavior.tool_call_count"].value == 2.0
    assert [r.event_id for r in FL.list_events(stored, {"project": "p:a"}, 2).collect()] == ["e1", "e2"]
    assert json.loads(stored.where("event_id = 'late'").first().payload_json)["extensions"] == {
        "unknown_top_level": {"custom": {"cwd": "[PATH_REDACTED]"}}}
    pairs = {(r.later_id, r.earlier_id) for r in C.correlated_pairs(
        stored, [d["event_id"] for d in DAY], ("ingest_batch", "arrival_seq")).collect()}
    # o1 falls back to its own session; e3 sees no stated session; 'late' meets the outcome that named it.
    assert pairs == {("o1", "e1"), ("o1", "e2"), ("late", "o2")}
    degrees = {r.event_id: (r.earlier_partners, r.later_partners) for r in C.correlation_degrees(stored, ("ingest_batch", "arrival_seq")).collect()}
    assert degrees == {"o1": (2, 0), "e1": (0, 1), "e2": (0, 1), "late": (1, 0), "o2": (0, 1)}


def test_rules_for_types_times_and_ids(spark):
    docs = [
        event("a", usage={"input_tokens": "1"}), event("b", usage={"input_tokens": True}), event("c", usage={"input_tokens": -1}),
        event("d", reliability={"timeout": "yes"}), event("e", "2026-08-07T14:00:00"), event("f", llm=5), event("g", llm={"provider": 5}),
        event("h", behavior={"tool_names": [1]}), event("i", provenance={"fields": []}), event(" "), event("k", received_at=None),
        event("ok", usage={"x": {"input_tokens": "nested is fine"}}, llm={"provider": "  ", "model": " m "}, execution={"parent_agent": "pa"}),
    ]
    rows = {r.arrival_seq: r for r in jsonl.events_from_lines(frame(spark, docs), "arrival_seq").collect()}
    bad = {docs[i]["event_id"] for i, r in rows.items() if r.reasons}
    assert bad == set("abcdefghi") | {"k"}
    assert rows[9].event_id.startswith("evt_sha256_")
    ok = rows[11]
    assert ok.llm.provider == "unknown" and ok.llm.model == "m" and ok.execution.parent_agent_id == "pa"
    assert json.loads(ok.extensions)["unknown_fields"] == {"usage": {"x": {"input_tokens": "nested is fine"}}}
    strict = N.normalize(frame(spark, [event(" ")]).select(F.try_parse_json("line").alias("doc")))
    assert strict.first().reasons == ["event_id is required"]


def test_ids_ignore_content_and_receipt(spark):
    base = {"event_type": "t", "observed_at": "2026-08-07T14:00:00Z", "llm": {"model": "m"}, "attributes": {"prompt": "y"}}
    docs = [base, {**base, "received_at": "2026-08-07T15:00:00Z"}, {**base, "attributes": {"prompt": "x"}}, {**base, "llm": {"model": "n"}}]
    ids = [r.event_id for r in jsonl.events_from_lines(frame(spark, docs), "arrival_seq").orderBy("arrival_seq").collect()]
    assert ids[0] == ids[1] == ids[2] != ids[3]


def test_masks(spark):
    deep = {}
    for _ in range(40):
        deep = {"n": deep}
    bag = {"prompt": "p", "my_token": "t", "note": "Bearer abcdefgh", "spot": "/etc/x", "list": list(range(300)), "deep": deep, "long": "x" * 600}
    docs = [event("a", attributes=bag, project={"remote": "https://u:p@H.com:8443/a/?q#f", "root": "/r", "project_id": "/home/x"},
                  provenance={"fields": {"access_token": "v", "usage": "client"}}, behavior={"tool_names": ["~/x", "ok"]})]
    rows = N.accepted(jsonl.events_from_lines(frame(spark, docs), "arrival_seq"))
    r = R.redact(rows).first()
    got = json.loads(r.attributes)
    assert got["prompt"] == P.CONTENT_MASK and got["my_token"] == P.SECRET_MASK and got["note"] == P.SECRET_MASK
    assert got["spot"] == P.PATH_MASK and len(got["list"]) == 300 and len(got["long"]) == 600
    assert got["deep"] == deep
    assert r.project.remote == "https://h.com:8443/a" and r.project.root is None and r.project.project_id.startswith("project_sha256:")
    assert r.provenance.fields == {"access_token": P.SECRET_MASK, "usage": "client"} and r.behavior.tool_names == [P.PATH_MASK, "ok"]
    open_ = R.redact(rows, P.Policy(content_capture=True, keep_paths=True)).first()
    assert json.loads(open_.attributes)["prompt"] == "p" and json.loads(open_.attributes)["note"] == P.SECRET_MASK
    assert open_.project.root == "/r" and open_.provenance.content_capture == "enabled"
    with pytest.raises(ValueError):
        P.Policy(max_text=8)


def test_hot_id_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(K, "MIN_HOT_ROWS", 1000)
    n = 30_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), F.col("id").cast("string"))).alias("event_id"),
        F.when(F.col("id") < 15_000, "d1").otherwise("d2").alias("payload_digest"), F.col("id").alias("arrival_seq"))
    got = {r.decision: r["count"] for r in I.classify(rows).groupBy("decision").count().collect()}
    assert got == {"inserted": 20_001, "duplicate": 4_999, "conflict": 5_000}
    hot = K.hot_keys(rows.groupBy("event_id").agg(F.count("*").alias("n")), "event_id").collect()
    assert [r.event_id for r in hot] == ["hot"]


def test_degrees_match_brute_force_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_BITS", 2)
    raw = spark.range(200).select(
        F.concat(F.lit("e"), F.col("id").cast("string")).alias("event_id"), (F.col("id") * 7 % 211).alias("arrival_seq"),
        F.when(F.col("id") % 5 == 0, "tests").alias("outcome_kind"), F.lit(None).cast("string").alias("outcome_status"),
        F.when(F.col("id") % 10 == 0, "session_id").when(F.col("id") % 15 == 5, "task_id").when(F.col("id") % 7 == 3, "agent_id").alias("correlation_basis"),
        F.when(F.col("id") % 20 == 0, "s1").when(F.col("id") % 15 == 5, "t2").when(F.col("id") % 7 == 3, "a1").alias("correlation_id"),
        F.concat(F.lit("t"), (F.col("id") % 4).cast("string")).alias("task_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("session_id"),
        F.concat(F.lit("a"), (F.col("id") % 2).cast("string")).alias("agent_id"),
        *[F.lit(None).cast("string").alias(c) for c in ("workflow_id", "subagent_id", "trace_id", "worktree")])
    data = [r.asDict() for r in raw.collect()]
    pairs = set()
    for e in data:
        for y in data:
            if y["arrival_seq"] >= e["arrival_seq"]:
                continue
            basis = e["correlation_basis"]
            if e["outcome_kind"]:
                if basis:
                    hit = y[basis] == (e["correlation_id"] or e[basis])
                else:
                    hit = y["task_id"] == e["task_id"]
            else:
                row = y["outcome_kind"] or y["correlation_id"] or y["correlation_basis"]
                stated = y["correlation_basis"] and y["correlation_id"] and e[y["correlation_basis"]] == y["correlation_id"]
                hit = row and (y["task_id"] == e["task_id"] or stated)
            if hit:
                pairs.add((e["event_id"], y["event_id"]))
    got = {r.event_id: (r.earlier_partners, r.later_partners) for r in C.correlation_degrees(raw).collect()}
    want = {}
    for later, earlier in pairs:
        a, b = want.get(later, (0, 0))
        want[later] = (a + 1, b)
        a, b = want.get(earlier, (0, 0))
        want[earlier] = (a, b + 1)
    assert got == want
    asked = {(r.later_id, r.earlier_id) for r in C.correlated_pairs(raw, ["e10", "e3"]).collect()}
    assert asked == {p for p in pairs if {"e10", "e3"} & set(p)}


def test_purge_guards_and_cascade(spark):
    ev = spark.createDataFrame([("a", "2026-08-07 10:00:00"), ("b", "2026-08-07 12:00:00"), ("c", "2026-08-07 13:00:00")], "event_id string, t string")
    ev = ev.select("event_id", F.col("t").cast("timestamp").alias("observed_at"))
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", None)], "child_event_id string, parent_event_id string")
    with pytest.raises(ValueError):
        RT.purge_selection(ev, "2026-08-07T12:00:00Z")
    with pytest.raises(ValueError):
        RT.purge_selection(ev, confirm=True)
    gone = RT.purge_selection(ev, "2026-08-07T14:00:00+02:00", confirm=True)
    assert [r.event_id for r in gone.collect()] == ["a"]
    kept = RT.survivors({"events": ev, "attribution_edges": edges}, gone)
    assert kept["events"].count() == 2 and kept["attribution_edges"].count() == 2
    assert [r.affected_events for r in RT.audit_rows(spark, gone, "2026-08-07T12:00:00Z").collect()] == [1, 1]


def test_filter_guards(spark):
    ev = spark.createDataFrame([("a",)], "event_id string").withColumn("observed_at", F.current_timestamp())
    with pytest.raises(ValueError):
        FL.apply_filters(ev, {"nope": "x"})
    with pytest.raises(ValueError):
        FL.in_range(ev, "2026-08-07T12:00:00Z", "2026-08-07T11:00:00Z")
    with pytest.raises(ValueError):
        FL.bounded_limit(True, 10)


def test_stream_equals_batch_and_keeps_late_events(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    tables = Tables(spark, str(tmp_path / "store"))

    def run():
        query = start_intake(read_text_stream(spark, str(folder), max_files=1), tables, checkpoint=str(tmp_path / "cp"))
        query.awaitTermination(240)
        assert query.exception() is None

    (folder / "1.jsonl").write_text("\n".join(json.dumps(d) for d in DAY[:4]))
    run()
    (folder / "2.jsonl").write_text("\n".join(json.dumps(d) for d in [DAY[0], DAY[4], DAY[5]]) + "\n{bad")
    run()
    run()  # nothing new
    stored = tables.read("events")
    assert sorted(r.event_id for r in stored.select("event_id").collect()) == sorted(d["event_id"] for d in DAY)
    assert tables.read("ingest_ledger").where("decision = 'duplicate'").count() == 1
    assert tables.read("rejects").count() == 1
    assert stored.orderBy("observed_at").first().event_id == "late"
    counts = {r.window_start.minute: r["count"] for r in tumbling_counts(stored, "5 minutes").collect()}
    assert counts == {0: 5, 55: 1}
