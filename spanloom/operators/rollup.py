"""Stored steps of the metric families: one additive table from which all event series are answered.

A row holds, for one set of label values and one minute, the number of events and the sums, counts and flag counts that the families need. Rows of different
batches simply add up, so late and shuffled batches need no repair, and a range query reads minutes instead of events. ``edge`` tells
events at a minute's start apart, because a sample at that time treats them in a way of its own: exactly at it, less than a millisecond later, or later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .aggregates import SUCCESS
from .families import EVENT_LABELS, FAMILIES, Family

MINUTE_US = 60_000_000
SLACK_US = 1000

_COLUMNS = tuple(dict.fromkeys(column for column, _ in EVENT_LABELS.values()))
_OWN = [f for f in FAMILIES.values() if f.source == "events"]
_VALUES = tuple(dict.fromkeys(f.value for f in _OWN if f.aggregate in ("sum", "avg")))
_FLAGS = tuple(dict.fromkeys([f.value for f in _OWN if f.aggregate == "flag"] + [f.only[0] for f in _OWN if f.only and f.only[1] == (True,)]))


def rollup(events: DataFrame) -> DataFrame:
    """minute, edge, the label columns, and events, sum_x, n_x, true_x for every measure."""
    us = F.unix_micros("observed_at")
    inside = F.pmod(us, F.lit(MINUTE_US))
    edge = F.when(inside == 0, 0).when(inside < SLACK_US, 1).otherwise(2)
    return events.groupBy(F.floor(us / MINUTE_US).alias("minute"), edge.alias("edge"), *_COLUMNS).agg(
        F.count("*").alias("events"),
        *[F.sum(F.col(v).cast("double")).alias(f"sum_{v}") for v in _VALUES], *[F.count(v).alias(f"n_{v}") for v in _VALUES],
        *[F.count(F.when(F.col(f), True)).alias(f"true_{f}") for f in _FLAGS])


def answers(family: Family, start_us: int, step_us: int, first_us: int, points: int) -> bool:
    """Whether stored minutes give the series of a family on a grid exactly: samples and range lie on whole minutes."""
    whole = [start_us, first_us] + ([step_us] if points > 1 else [])
    return family.source == "events" and all(x % MINUTE_US == 0 for x in whole)


def within(rows: DataFrame, first_us: int, end_us: int) -> DataFrame:
    """Rows of first <= observed_at <= end, both whole minutes."""
    last = end_us // MINUTE_US
    return rows.where((F.col("minute") >= first_us // MINUTE_US) & ((F.col("minute") < last) | ((F.col("minute") == last) & (F.col("edge") == 0))))


def sample(start_us: int, step_us: int, points: int) -> Column:
    """Index of the first sample at or after the rows' events, with the same slack as for single events."""
    if points == 1:
        return F.lit(0)
    minute = F.when(F.col("edge") == 2, F.col("minute")).otherwise(F.col("minute") - 1)
    index = F.floor((minute * MINUTE_US - start_us) / F.lit(step_us)) + 1
    return F.least(F.greatest(index, F.lit(0)), F.lit(points - 1)).cast("int")


def measure(family: Family) -> tuple[Column, Column, Column]:
    """(num, den, whether a group of rows counts at all), as the families define them on single events."""
    total, present = F.sum("events"), F.sum("events") > 0
    if family.only is not None and family.only[1] == (True,):
        hits = F.sum(f"true_{family.only[0]}")
        return hits, hits, hits > 0
    if family.aggregate == "count":
        return total, total, present
    if family.aggregate == "flag":
        return F.sum(f"true_{family.value}"), total, present
    if family.aggregate == "ratio":
        return F.coalesce(F.sum(F.when(F.col("status").isin(*SUCCESS), F.col("events"))), F.lit(0)), total, present
    count = F.sum(f"n_{family.value}")
    return F.sum(f"sum_{family.value}"), count, count > 0
