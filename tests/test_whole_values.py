"""Nothing of a value is cut: ids, texts, bags and lists of any size and depth."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from spanloom import session
from spanloom.functions import identity, privacy as P


def test_long_texts_and_ids_stay_whole(spark):
    a, b = "x" * 600 + "a", "x" * 600 + "b"
    rows = spark.createDataFrame([(a,), (b,), ("/work/1",), ("/work/2",)], "t string").select(
        P.mask_text(F.col("t")).alias("text"), P.safe_id(F.col("t")).alias("id")).collect()
    assert [r["text"] for r in rows[:2]] == [a, b] and [r["id"] for r in rows[:2]] == [a, b]
    assert rows[2]["id"] != rows[3]["id"] and rows[2]["id"].startswith("redacted:sha256:")


def test_every_entry_at_every_depth_is_masked(spark):
    bag = {f"k{i}": i for i in range(300)} | {"password": "p", "many": ["v"] * 300}
    deep = inner = {}
    for _ in range(60):
        inner["next"] = inner = {}
    inner["api_key"] = "abc"
    bag["deep"] = deep
    got = json.loads(spark.createDataFrame([(json.dumps(bag),)], "b string").select(P.redact_bag(F.col("b"))).first()[0])
    assert len(got) == len(bag) and got["password"] == "[REDACTED]" and len(got["many"]) == 300
    at = got["deep"]
    for _ in range(60):
        at = at["next"]
    assert at == {"api_key": "[REDACTED]"}
    wide = spark.range(1).select(F.map_from_arrays(
        F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("secret_"), i.cast("string"))),
        F.array_repeat(F.lit("v"), 300)).alias("m")).select(P.mask_map(F.col("m")).alias("m")).first()["m"]
    assert len(wide) == 300 and set(wide.values()) == {"[REDACTED]"}


@pytest.mark.parametrize("key,kind", [
    ("promptText", "content"), ("a.body", "content"), ("my_prompt", "content"), ("a.api-key", "secret"), ("private_note", "secret"),
    ("x.token", "secret"), ("idToken", "secret"), ("filePath", "ordinary"), ("a.cwd", "path"), ("a.secret_b", "ordinary"), ("name", "ordinary")])
def test_key_classes_agree_in_spark_and_python(spark, key, kind):
    assert P._kind_of_key(key) == kind
    assert spark.range(1).select(P.key_class(F.lit(key))).first()[0] == kind


def test_ids_see_the_whole_safe_part():
    doc = lambda end: {"source": {"name": "n" * 300 + end, "prompt": "no"}, "received_at": "x", "span": [{"id": 1}] * 70 + [{"id": end}]}
    a, b = identity.identity_part(doc("a")), identity.identity_part(doc("b"))
    assert a["source"]["name"] != b["source"]["name"] and a["span"] != b["span"]
    assert "prompt" not in a["source"] and "received_at" not in a


def test_stage_wants_a_shared_folder_on_a_cluster():
    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        session.stage(SimpleNamespace(sparkSession=cluster), "x")


def test_otlp_keeps_every_attribute_point_and_level(spark):
    from spanloom.sources import otlp

    value = inner = {"arrayValue": {"values": []}}
    for _ in range(9):
        nxt = {"arrayValue": {"values": []}}
        inner["arrayValue"]["values"].append(nxt)
        inner = nxt
    inner["arrayValue"]["values"].append({"stringValue": "end"})
    attributes = [{"key": f"a{i}", "value": {"intValue": str(i)}} for i in range(300)]
    attributes += [{"key": "deep", "value": value}, {"key": "long", "value": {"stringValue": "y" * 700}}, "bad", {"key": "empty", "value": {"kvlistValue": {}}}]
    span = {"traceId": "t", "spanId": "s", "startTimeUnixNano": 1754575200000000000, "attributes": attributes}
    point = lambda i: {"timeUnixNano": str(1754575200000000000 + i), "asInt": str(i), "attributes": [{"key": "model", "value": {"stringValue": f"m{i % 3}"}}]}
    docs = [json.dumps(d) for d in (
        {"resourceSpans": [{"scopeSpans": [{"spans": ["x", span]}]}]},
        {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "m", "sum": {"dataPoints": [point(i) for i in range(100)]}}]}]}]})]
    rows = spark.createDataFrame([(d,) for d in docs], "payload string")
    good, bad = sorted(otlp.events_from_spans(rows.limit(1)).collect(), key=lambda r: bool(r.reasons))
    bag = json.loads(good.extensions)["unknown_attributes"]
    assert len(bag) == 303 and bag["a299"] == 299 and bag["long"] == "y" * 700 and bag["empty"] == {} and '"end"' in json.dumps(bag["deep"])
    assert bad.reasons == ["malformed traces record: resourceSpans[0].scopeSpans[0].spans[0] must be an object"]
    got = otlp.events_from_metrics(rows.where("payload LIKE '%resourceMetrics%'")).collect()
    assert sorted(len(json.loads(r.attributes)["metric.points"]) for r in got) == [33, 33, 34]
    assert [p["value"] for p in json.loads(next(r for r in got if r.llm.model == "m1").attributes)["metric.points"]] == [float(i) for i in range(1, 100, 3)]
    texts = spark.createDataFrame([("not json",), ("{}",), ('{"resourceSpans": [{}]}',)], "payload string")
    ids = {r.event_id: r.reasons[0] for r in otlp.events_from_spans(texts).collect()}
    assert sorted(ids.values()) == ["malformed traces record: invalid JSON", "malformed traces record: resourceSpans has no records",
                                    "malformed traces record: resourceSpans[0].scopeSpans has no records"] and len(ids) == 3


def test_no_ceiling_on_limits_and_requested_ids(spark):
    from spanloom.operators import aggregates, correlate, filters

    rows = spark.range(1500).withColumn("n", F.col("id") % 700)
    assert filters.first_rows(rows, None).count() == 1500 and filters.first_rows(rows, 1200, "id").count() == 1200
    with pytest.raises(ValueError):
        filters.first_rows(rows, 0, "id")
    listed = [str(i) for i in range(1200)]
    named = rows.select(F.col("id").cast("string").alias("e"))
    assert correlate._with_ids(named, "e", listed).count() == 1200 and correlate._with_ids(named, "e", listed, "left_anti").count() == 300
    assert correlate._with_ids(named, "e", listed[:5]).count() == 5
    groups = rows.groupBy(F.col("n").alias("key_n")).agg(F.count("*").alias("count"))
    assert aggregates._top_groups(groups, {"n": "n"}, (), (), None, False).count() == 700
