"""Outcome records as envelope rows of type ``outcome.<kind>``.

Input columns: kind, status, observed_at (timestamp), and optionally correlation_id,
correlation_basis, evidence_source, task_id, task_class, project_id, source_name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import struct_id
from .otlp import _envelope

# ---- Fixed values
PASSED = ("pass", "passed", "success", "succeeded", "accepted", "complete", "completed")
FAILED = ("fail", "failed", "failure", "rejected", "error", "aborted", "timeout")
# ---- end of fixed values


def status_class(status: Column) -> Column:
    word = F.lower(status)
    return F.when(word.isin(*PASSED), "succeeded").when(word.isin(*FAILED), "failed").otherwise("unknown")


def events_from_outcomes(rows: DataFrame, *carry: str) -> DataFrame:
    def given(name: str, default: str | None = None) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in rows.columns else F.lit(default).cast("string")

    kind, status = F.trim("kind"), F.trim("status")
    evidence = F.coalesce(F.nullif(given("evidence_source"), F.lit("")), F.lit("unknown"))
    source = given("source_name", "outcome-collector")
    ids = {n: given(n) for n in ("task_id", "task_class", "correlation_id", "correlation_basis", "project_id")}
    values = {
        "event_id": struct_id(kind=kind, status=status, observed=F.col("observed_at"), source=source, evidence=evidence, **ids),
        "event_type": F.concat(F.lit("outcome."), kind), "observed_at": F.col("observed_at"),
        "source.kind": F.lit("collector"), "source.name": source, "project.project_id": ids["project_id"],
        "execution.task_id": ids["task_id"], "execution.task_class": ids["task_class"],
        "reliability.status": status_class(F.col("status")),
        "reliability.timeout": F.lower("status") == "timeout", "reliability.aborted": F.lower("status") == "aborted",
        "outcome.kind": kind, "outcome.status": status, "outcome.correlation_id": ids["correlation_id"],
        "outcome.correlation_basis": ids["correlation_basis"], "outcome.evidence_source": evidence,
        "provenance.adapter": source, "provenance.semantic_conventions": F.lit("outcome/v1"),
        "provenance.content_capture": F.lit("disabled"),
        "provenance.fields": F.create_map(F.lit("outcome.status"), evidence),
    }
    empty = F.coalesce((kind == "") | (status == ""), F.lit(True))
    return _envelope(rows, values, [F.when(empty, "outcome kind and status are required")], carry)
