"""Work that must be done once, in many tasks: read from plans and from how rows are dealt."""

import re

from pyspark.sql import functions as F

from spanloom.functions import variants as V
from spanloom.operators import normalize as N
from spanloom.operators import retention as RT
from spanloom.session import spread
from spanloom.sources import jsonl, otlp


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_is_not_computed_below_the_repartition(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    rows = spread(spark.read.parquet(str(tmp_path / "t"))).withColumn("text", F.sha2(F.col("id").cast("string"), 256))
    kept = rows.where(F.col("text").rlike("^[0-7]"))
    below = optimized(kept).split("Repartition", 1)[1]
    assert "Filter" not in below and "sha2" not in below
    assert kept.count() == sum(1 for r in rows.collect() if r["text"][0] in "01234567")


def test_many_splits_of_one_row_group_are_spread(spark, tmp_path):
    spark.range(20_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        table = spark.read.parquet(str(tmp_path / "t"))
        cores = spark.sparkContext.defaultParallelism
        assert table.rdd.getNumPartitions() >= cores
        filled = [r["n"] for r in spread(table).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(filled) == 20_000 and len(filled) >= cores and max(filled) < 20_000 // 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_a_made_line_is_made_once(spark):
    made = spark.range(3).select(F.to_json(F.struct("id")).alias("line"))
    assert optimized(jsonl.parse_lines(made)).count("StructsToJson") == 1
    lines = spark.createDataFrame([(" ",), ("{}",), ("[1]",), ("{bad",)], ["line"])
    got = sorted((r["line"], r["line_error"]) for r in jsonl.parse_lines(lines).collect())
    assert got == [("[1]", "record must be an object"), ("{bad", "invalid JSON"), ("{}", None)]


def test_reasons_are_made_outside_the_generator(spark):
    payloads = spark.createDataFrame([("{}",)], ["payload"])
    plan = optimized(otlp.events_from_spans(payloads).where(F.size("reasons") == 0))
    assert not re.search(r"Generate explode\(array\([^\n]*concat_ws", plan)


def test_plain_sections(spark):
    texts = spark.createDataFrame([
        ("provenance", '{"fields": {"usage": "client", "performance.latency_ms": "x"}}', True),
        ("provenance", '{"adapter": 1}', False), ("behavior", '{"tool_call_count": 1, "tests_invoked_count": 2.5}', True),
        ("behavior", '{"tool_calls": [1]}', False), ("reliability", '{"status": null, "timeout": true, "retry_count": 1}', True),
        ("reliability", '{"timeout": "true"}', False), ("execution", "{}", True), ("execution", "[]", False),
    ], ["section", "text", "plain"])
    rows = texts.withColumn("type", V.kind(V.parse("text"))).collect()
    for r in rows:
        found = spark.createDataFrame([(r["type"],)], ["t"]).select(F.col("t").rlike(N._plain_type(r["section"]))).first()[0]
        assert found == r["plain"], r


def test_sections_that_are_not_plain_are_read_as_before(spark):
    head = '"event_id": "%s", "observed_at": "2026-01-01T00:00:00Z"'
    lines = spark.createDataFrame([
        ('{%s, "provenance": {"fields": {"a": {"b": "c"}, "adapter": 1}}}' % (head % "a"),),
        ('{%s, "behavior": {"tool_calls": ["x", {"name": "y"}], "odd": 1}, "more": 2}' % (head % "b"),),
        ('{%s, "execution": {"parentAgentId": "p"}, "reliability": {"rework": 2}}' % (head % "c"),),
        ('{%s, "usage": {"cost": -1}, "reliability": {"timeout": "no"}}' % (head % "d"),),
    ], ["line"])
    got = {r["event_id"]: r for r in jsonl.events_from_lines(lines).collect()}
    assert got["a"]["reasons"] == [] and got["a"]["extensions"] == "{}"
    assert got["b"]["behavior"]["tool_call_count"] == 2 and got["b"]["behavior"]["tool_names"] == ["x", "y"]
    assert got["b"]["extensions"] == '{"unknown_fields":{"behavior":{"odd":1}},"unknown_top_level":{"more":2}}'
    assert got["c"]["execution"]["parent_agent_id"] == "p" and got["c"]["reliability"]["rework_count"] == 2
    assert set(got["d"]["reasons"]) == {"reliability.timeout must be boolean or null", "usage.cost must be a non-negative number or null"}


def test_edges_without_a_parent_are_dealt_over_all_tasks(spark):
    edges = spark.range(4_000).select(
        F.concat(F.lit("e"), "id").alias("child_event_id"),
        F.when(F.col("id") % 8 == 0, F.concat(F.lit("e"), F.col("id") + 1)).alias("parent_event_id"),
        F.timestamp_seconds("id").alias("observed_at"))
    gone = spark.createDataFrame([("e1",), ("e8",)], ["event_id"])
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        kept = RT.survivors({"attribution_edges": edges}, gone)["attribution_edges"]
        assert kept.columns == edges.columns
        rows = kept.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["child_event_id"] for r in rows} == {f"e{i}" for i in range(4_000)} - {"e0", "e1", "e8"}
    orphans = [r["task"] for r in rows if r["parent_event_id"] is None]
    assert max(orphans.count(t) for t in set(orphans)) < len(orphans) // 2


def test_a_larger_table_has_more_tasks_and_not_longer_ones(spark, tmp_path, monkeypatch):
    from spanloom import session
    spark.range(20_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    rows = spread(spark.read.parquet(str(tmp_path / "t"))).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in rows) == 20_000 and max(r["n"] for r in rows) <= 600


def test_plain_documents_are_not_taken_apart(spark):
    head = '"event_id": "%s", "observed_at": "2026-01-01T00:00:00Z"'
    lines = spark.createDataFrame([
        ('{%s, "usage": {"cost": 1.5, "source": " client "}, "attributes": {"a": 1, "b": "x"}, "extensions": {"c": true}}' % (head % "a"), True),
        ('{%s, "provenance": {"adapter": "x", "fields": {"usage": "client", "performance": null}}, "behavior": null}' % (head % "b"), True),
        ('{"observed_at": "2026-01-01T00:00:00Z", "source": {"name": "s"}}', True),
        ('{%s, "source": {"name": null}}' % (head % "d"), False), ('{%s, "attributes": {"rework": 3}}' % (head % "e"), False),
        ('{%s, "attributes": {"a": {"b": 1}}}' % (head % "f"), False), ('{%s, "other": 1}' % (head % "g"), False),
        ('{%s, "received_at": null}' % (head % "h"), False), ('{%s, "usage": {"cost": -1}}' % (head % "i"), True),
    ], ["line", "plain"])
    kinds = lines.select("line", "plain", V.kind(V.parse("line")).rlike(N._plain_document()).alias("found")).collect()
    assert [r["line"] for r in kinds if r["found"] != r["plain"]] == []
    rows = jsonl.events_from_lines(lines).collect()
    got = {r["event_id"]: r for r in rows}
    assert got["a"]["usage"]["cost"] == 1.5 and got["a"]["usage"]["source"] == "client"
    assert (got["a"]["attributes"], got["a"]["extensions"]) == ('{"a":1,"b":"x"}', '{"c":true}')
    assert got["b"]["provenance"]["fields"] == {"usage": "client", "performance": None} and got["b"]["provenance"]["adapter"] == "x"
    unnamed = next(r for r in rows if r["event_id"].startswith("evt_sha256_"))
    assert (unnamed["source"]["kind"], unnamed["source"]["name"], unnamed["schema_version"]) == ("adapter", "s", "1.0")
    assert got["d"]["source"]["name"] == "unknown" and got["e"]["reliability"]["rework_count"] == 3
    assert got["f"]["attributes"] == '{"a":{"b":1}}' and got["g"]["extensions"] == '{"unknown_top_level":{"other":1}}'
    assert got["h"]["reasons"] == ["received_at must be ISO-8601 with a timezone"]
    assert got["i"]["reasons"] == ["usage.cost must be a non-negative number or null"]
    assert all(got[k]["reasons"] == [] for k in "abdefg")
    plan = optimized(jsonl.events_from_lines(lines))
    assert re.search(r"CASE WHEN [^\n]{0,40}_plain", plan)


def test_usual_keys_of_provenance_are_masked_like_any_other(spark):
    from spanloom.functions import privacy as P
    from spanloom.operators import redact as R
    keys = [*R._USUAL_KEYS, "execution.session", "api_key", "my.prompt", "cwd"]
    texts = ["client", "/home/x", "c:\\temp", " ~/a", "token=abcdefgh1", None]
    rows = spark.createDataFrame([({k: t for k in keys},) for t in texts], "bag map<string,string>")
    got = rows.select(P.mask_map(F.col("bag")).alias("a"), P.mask_map(F.col("bag"), usual=R._USUAL_KEYS).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)
    assert got[0]["b"]["api_key"] == "[REDACTED]" and got[1]["b"]["usage"] == "[PATH_REDACTED]" and got[2]["b"]["usage"] == "[PATH_REDACTED]"
