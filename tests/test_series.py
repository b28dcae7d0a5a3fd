"""Event-time series on small literal rows."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import series as S
from spanloom.operators.families import FAMILIES, LABEL_NAMES
from spanloom.functions.times import parse_instant, parse_step
from spanloom.plans import inputs
from spanloom.plans.reports import REPORTS, report

COLUMNS = sorted({c for f in FAMILIES.values() for c, _ in f.label_columns.values()} - {"kind", "evidence_source", "correlation_basis"})


def events(spark, rows):
    """rows: (id, time, overrides)."""
    numbers = sorted({f.value for f in FAMILIES.values() if f.aggregate in ("sum", "avg")})
    flags = ["rate_limited", "timeout", "tool_failure", "agent_failure"]
    df = spark.createDataFrame([(i, t, o) for i, t, o in rows], "event_id string, at string, o map<string,string>")
    cols = [F.try_element_at("o", F.lit(c)).alias(c) for c in COLUMNS]
    cols += [F.try_element_at("o", F.lit(c)).cast("double").alias(c) for c in numbers]
    cols += [F.try_element_at("o", F.lit(c)).cast("boolean").alias(c) for c in flags]
    return df.select("event_id", F.col("at").cast("timestamp").alias("observed_at"), *cols)


def values(df):
    return [r.value for r in df.orderBy("sample_us").collect()]


def test_cumulative_counts_every_five_minutes(spark):
    rows = [("a", "2026-08-07 14:00:00", {}), ("b", "2026-08-07 14:05:00", {}), ("c", "2026-08-07 14:09:00", {})]
    out = S.range_matrix("events_total", {"events": events(spark, rows)}, "2026-08-07T14:00:00Z", "2026-08-07T14:10:00Z", 300)
    assert values(out) == [1.0, 2.0, 3.0]


def test_average_is_missing_before_its_first_value(spark):
    rows = [("a", "2026-08-07 14:00:00", {}), ("b", "2026-08-07 14:04:00", {"latency_ms": "10"}),
            ("c", "2026-08-07 14:08:00", {"latency_ms": "20"})]
    t = {"events": events(spark, rows)}
    out = S.range_matrix("latency_average_ms", t, "2026-08-07T14:00:00Z", "2026-08-07T14:10:00Z", "5m")
    assert values(out) == [None, 10.0, 15.0]
    assert S.range_matrix("cost_total", t, "2026-08-07T14:00:00Z", "2026-08-07T14:10:00Z", "5m").count() == 0


def test_null_label_merges_with_unknown_and_conflicts_count_per_replay(spark):
    rows = [("a", "2026-08-07 14:00:00", {"provider": "unknown"}), ("b", "2026-08-07 14:01:00", {})]
    ev = events(spark, rows)
    conflicts = spark.createDataFrame([("a",), ("a",), ("zz",)], "event_id string")
    t = {"events": ev, "conflicts": conflicts}
    out = S.instant_vector("events_by_context_total", t, "2026-08-07T15:00:00Z", S.eq("provider", "unknown"))
    assert [r.value for r in out.collect()] == [2.0]
    assert [r.value for r in S.instant_vector("event_conflicts_total", t, "2026-08-07T15:00:00Z").collect()] == [2.0]


def test_or_zero_topk_and_packed(spark):
    rows = [(str(i), "2026-08-07 14:00:00", {"project_id": p}) for i, p in enumerate("aabbbc")]
    t = {"events": events(spark, rows)}
    grid = S.range_grid("2026-08-07T14:00:00Z", "2026-08-07T14:02:00Z", 60)
    top = S.series("events_by_project_total", t, grid).topk(2)
    assert {r.project for r in top.matrix().collect()} == {"a", "b"}
    assert top.packed().count() == 2
    nobody = S.series("events_by_project_total", t, grid, S.eq("project", "zz")).sum().or_else(S.zero_vector(spark, grid))
    assert values(nobody.matrix()) == [0.0, 0.0, 0.0]
    somebody = S.series("events_by_project_total", t, grid).sum().or_else(S.zero_vector(spark, grid))
    assert values(somebody.matrix()) == [6.0, 6.0, 6.0]


def test_bad_requests(spark):
    t = {"events": events(spark, [("a", "2026-08-07 14:00:00", {})])}
    grid = S.range_grid("2026-08-07T14:00:00Z", "2026-08-07T14:02:00Z", 60)
    with pytest.raises(S.SeriesError):
        S.series("no_such_metric", t, grid)
    with pytest.raises(S.SeriesError):
        S.series("events_total", t, grid, S.eq("provider", "x"))
    with pytest.raises(S.SeriesError):
        S.series("events_by_project_total", t, grid, S.matches("project", "(")).matrix()
    with pytest.raises(S.SeriesError):
        S.range_grid("2026-08-07T14:00:00Z", "2026-08-08T14:00:00Z", "1s")
    with pytest.raises(S.SeriesError):
        S.series("events_by_project_total", t, grid).topk(501)
    with pytest.raises(S.SeriesError):
        S.series("events_by_project_total", t, grid).check_caps(max_series=0)
    with pytest.raises(S.SeriesError):
        S.label_values("nope", t, "2026-08-07T14:00:00Z", "2026-08-07T14:02:00Z")


def test_times():
    assert parse_instant("1970-01-01T00:00:01+00:00") == 1_000_000
    assert parse_instant(1.5) == 1_500_000
    assert parse_step("10ms", 0, 0) == 10_000 and parse_step("2h", 0, 0) == 7_200_000_000
    assert parse_step(None, 0, 240_000_000_000) == 1_000_000_000
    for bad in ("2026-08-07T14:00:00", "x", "inf"):
        with pytest.raises(ValueError):
            parse_instant(bad)
    with pytest.raises(ValueError):
        parse_step("0s", 0, 1)


def test_catalogue(spark):
    assert len(FAMILIES) == 81 and len(LABEL_NAMES) == 25 and len(REPORTS) == 65
    assert S.family_metadata(spark).count() == 81 and S.label_names(spark).count() == 25
    assert S.scalar_query(spark, "-2.5", 10).first().value == -2.5


def test_report_filters_apply_where_the_family_has_the_label(spark, sf):
    t = inputs.tables(spark, sf)
    grid = S.range_grid("2024-01-01T00:00:00Z", "2024-01-31T00:00:00Z", "10d")
    one = report("project_volume", spark, t, grid, {"project": "repo:1", "model": "model-1"}).matrix()
    expected = t["events"].where("project_id = 'repo:1' and observed_at <= '2024-01-31'").count()
    assert values(one)[-1] == expected


def test_plans_prune_and_never_multiply_rows(spark, sf):
    t = inputs.tables(spark, sf)
    grid = S.range_grid("2024-01-01T00:00:00Z", "2024-01-31T00:00:00Z", "1d")
    plan = S.series("events_by_provider_model_total", t, grid).topk(5).matrix()._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
