import re

from spanloom.operators import export
from spanloom.plans.catalog import catalog


def test_a_registered_export_returns_every_metric(spark, sf):
    want = {
        *export._SUMMARY, *export._PROVIDER, *export._CONTEXT, "success_rate_by_provider_model", "event_conflicts_total", "outcomes_total",
        "outcomes_by_kind_status_total", *[f"events_by_{n}_total" for n in (
            "usage_source", "project", "client_route", "execution", "workflow", "agent")]}
    rows = catalog().callables()["metric_export_all"](spark, sf).collect()
    assert {re.match(r"\w+", r["series"]).group() for r in rows} == want and len(want) > 8
    assert "metric_export_all" in catalog().checks() and all(r["number"] is not None for r in rows)
