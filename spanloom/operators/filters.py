"""Row filters, listings and their guards over the flat event table."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.times import parse_instant

# Filter names that map to a column of another name; every other name is its own column.
ALIASES = {
    "project": "project_id",
    "commit": "commit_sha",
    "parent_agent": "parent_agent_id",
}
FILTER_COLUMNS = (
    "project_id", "repository", "provider", "model", "model_variant", "client", "event_type",
    "status", "evidence_source", "usage_source", "model_family", "auth_mode", "route", "trace_id",
    "span_id", "branch", "commit_sha", "worktree", "session_id", "workflow_id", "agent_id",
    "subagent_id", "parent_agent_id", "role", "skill", "lane", "task_id", "task_class",
    "outcome_kind", "outcome_status",
)


def bounded_limit(limit: int | None, maximum: int | None = None) -> int | None:
    """``limit`` when it is None or a positive integer, up to ``maximum`` if given; else ValueError."""
    if limit is None:
        return None
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1 or (maximum is not None and limit > maximum):
        raise ValueError("limit must be a positive integer" + ("" if maximum is None else f" up to {maximum}"))
    return limit


def first_rows(df: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
    """The first ``limit`` rows in order; with None all of them, unsorted, as a sort of everything is the caller's choice."""
    return df if bounded_limit(limit) is None else df.orderBy(*order).limit(limit)


def in_range(
    df: DataFrame, start: datetime | str | None = None, end: datetime | str | None = None,
) -> DataFrame:
    """Rows with start <= observed_at <= end. Also bounds the date partition, if there is one."""
    lo, hi = (None if v is None else parse_instant(v) for v in (start, end))
    if lo is not None and hi is not None and lo > hi:
        raise ValueError("start must be before or equal to end")
    dated = "observed_date" in df.columns
    for bound, test in ((lo, Column.__ge__), (hi, Column.__le__)):
        if bound is None:
            continue
        moment = F.timestamp_micros(F.lit(bound))
        df = df.where(test(F.col("observed_at"), moment))
        if dated:
            df = df.where(test(F.col("observed_date"), F.to_date(moment)))
    return df


def apply_filters(df: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    """AND of equality filters plus the two time bounds ``start`` and ``end``."""
    filters = dict(filters or {})
    df = in_range(df, filters.pop("start", None), filters.pop("end", None))
    tests = []
    for name, value in filters.items():
        column = ALIASES.get(name, name)
        if column not in FILTER_COLUMNS:
            raise ValueError(f"unsupported filter: {name}")
        tests.append(F.col(column) == value)
    return df.where(reduce(and_, tests)) if tests else df


def list_events(df: DataFrame, filters: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """Matching events; with a limit the first of them by (observed_at, event_id)."""
    return first_rows(apply_filters(df, filters), limit, "observed_at", "event_id")


def point_lookup(df: DataFrame, event_id: str) -> DataFrame:
    return df.where(F.col("event_id") == event_id)


def session_timeline(df: DataFrame, pattern: str) -> DataFrame:
    """Events whose session id contains a match of ``pattern``, in time order."""
    return df.where(F.col("session_id").rlike(pattern)).orderBy("observed_at", "event_id")


def trace_listing(df: DataFrame, session_pattern: str | None = None) -> DataFrame:
    """One row per trace, newest first; optionally only traces of matching sessions."""
    rows = df.where(F.col("trace_id").isNotNull())
    if session_pattern is not None:
        rows = rows.where(F.col("session_id").rlike(session_pattern))
    return (
        rows.groupBy("trace_id")
        .agg(
            F.min("observed_at").alias("first_at"),
            F.max("observed_at").alias("last_at"),
            F.count("*").alias("spans"),
        )
        .orderBy(F.desc("first_at"), "trace_id")
    )
