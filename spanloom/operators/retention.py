"""Purging by event time, id or signal class, with its cascade and audit rows; of frames and of the stored tables.

A purge of stored tables is copy-on-write: whole date partitions before a time cut leave the list of folders unread, folders that hold a purged
row are written anew without it, and all others stay. One commit swaps them, with the row that says so.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.times import parse_instant
from ..session import stage
from .commits import Part, Snapshot
from .tables import Tables, Written, _projected, located

# How long each signal is kept.
CLASS_RETENTION = {"metrics": timedelta(days=30), "traces": timedelta(hours=720), "logs": timedelta(hours=336)}
# Tables that follow their event by event_id.
FOLLOWERS = ("measurement_facts", "outcome_events", "ingest_ledger", "event_conflicts", "correlation_keys", "events")
# An id list up to this size is sent along with the plan; longer ones become a frame, with the same result.
MAX_INLINE_IDS = 10_000
DETAIL = "explicit operator retention/deletion"


def purge_selection(
    events: DataFrame, before: datetime | str | None = None,
    event_ids: list[str] | DataFrame | None = None, *, confirm: bool = False,
) -> DataFrame:
    """event_id of the events to purge: older than ``before`` (strictly), or listed."""
    if not confirm:
        raise ValueError("purge requires explicit confirm=True")
    parts = []
    if before is not None:
        moment = F.timestamp_micros(F.lit(parse_instant(before)))
        old = events.where(F.col("observed_at") < moment)
        if "observed_date" in events.columns:
            old = old.where(F.col("observed_date") <= F.to_date(moment))
        parts.append(old.select("event_id"))
    if isinstance(event_ids, DataFrame):
        parts.append(events.join(event_ids.select("event_id").distinct(), "event_id", "left_semi").select("event_id"))
    elif event_ids:
        ids = [i.strip() for i in event_ids if isinstance(i, str) and i.strip()]
        if len(ids) > MAX_INLINE_IDS:
            listed = events.sparkSession.createDataFrame([(i,) for i in set(ids)], "event_id string")
            parts.append(events.join(listed, "event_id", "left_semi").select("event_id"))
        elif ids:
            parts.append(events.where(F.col("event_id").isin(*ids)).select("event_id"))
    if not parts:
        raise ValueError("purge requires before or at least one event id")
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return chosen.distinct()


def _without(df: DataFrame, selection: DataFrame, side: str, spread: str) -> DataFrame:
    """Rows whose ``side`` names no purged event.

    Rows without a value there match nothing; the column ``spread`` deals them over all tasks of the join, else one would get them all.
    A task holds its part of the distinct ids and streams the rows past them: a sort would hold the rows, many for each event.
    """
    salt = F.when(F.col(side).isNull(), F.xxhash64(spread) if spread in df.columns else F.lit(0)).otherwise(0).cast("long")
    # No literal: the optimizer would take the equality with it out of the keys that deal the rows.
    plain = F.col("event_id").isNull().cast("long").alias("_salt")
    gone = selection.select(F.col("event_id").alias(side), plain).hint("shuffle_hash")
    return df.withColumn("_salt", salt).join(gone, [side, "_salt"], "left_anti").select(*df.columns)


def survivors(tables: dict[str, DataFrame], selection: DataFrame) -> dict[str, DataFrame]:
    """Every given table without the rows of purged events."""
    out = {}
    for name, df in tables.items():
        if name == "attribution_edges":
            df = _without(_without(df, selection, "child_event_id", "observed_at"), selection, "parent_event_id", "child_event_id")
        elif name in FOLLOWERS:
            df = _without(df, selection, "event_id", "observed_at")
        out[name] = df
    return out


def audit_rows(spark: SparkSession, selection: DataFrame, before=None, event_ids: list[str] | None = None) -> DataFrame:
    """The started and completed rows of one purge."""
    action = f"maintenance:{uuid.uuid4()}"
    return _audit_row(selection, action, before, event_ids, "started").unionByName(_audit_row(selection, action, before, event_ids, "completed"))


def _audit_row(selection: DataFrame, action: str, before, event_ids, outcome: str, kind: str = "purge") -> DataFrame:
    ids = ["(a table of ids)"] if isinstance(event_ids, DataFrame) else sorted(event_ids or [])
    selector = json.dumps({"before": None if before is None else str(before), "event_ids": ids}, sort_keys=True)
    done = outcome == "completed"
    return selection.agg(F.count("*").alias("affected_events")).select(
        F.lit(action + (":completed" if done else "")).alias("action_id"), F.lit(kind).alias("action_type"), F.lit(selector).alias("selector"),
        F.current_timestamp().alias("requested_at"), F.lit(outcome).alias("outcome"), "affected_events",
        F.lit(DETAIL if done else None).cast("string").alias("detail"))


AUDIT = -1  # batch number of audit rows

# Table -> columns that name an event; a row goes when any of them is purged.
_NAMED = {
    **{name: ("event_id",) for name in FOLLOWERS}, "id_index": ("event_id",),
    "attribution_edges": ("child_event_id", "parent_event_id"), "correlation_edges": ("child_event_id", "parent_event_id"),
}
_SPLIT = {"correlation_keys": "key_bucket", "id_index": "bucket", "ingest_ledger": None, "event_conflicts": None, "correlation_edges": None}
# Tables whose rows have the date of their event.
_OF_DATE = ("events", "measurement_facts", "outcome_events", "attribution_edges")


def purge(tables: Tables, before: datetime | str | None = None, event_ids: list[str] | DataFrame | None = None, *, confirm: bool = False) -> int:
    """Purge stored events, all rows made from them and their index entries; returns the number of events.

    The started row is committed first, the completed one together with the change.
    """
    seen = tables.snapshot()
    events = _candidates(tables, seen, before, event_ids)
    selection = stage(purge_selection(events, before, event_ids, confirm=confirm), "purge")
    cut = None if before is None else datetime.fromtimestamp(parse_instant(before) // 1_000_000, timezone.utc).date().isoformat()
    return _take_out(tables, selection, cut, ("purge", before, event_ids))


def expire_stored(tables: Tables, now: datetime | str) -> dict[str, int]:
    """Purge the stored events of each signal class that are beyond its retention; returns their numbers by class."""
    done = {}
    for name in CLASS_RETENTION:
        oldest = parse_instant(now) - CLASS_RETENTION[name] // timedelta(microseconds=1)
        events = tables.read("events")
        moment = F.timestamp_micros(F.lit(oldest))
        old = events.where((signal() == name) & (F.col("observed_at") < moment) & (F.col("observed_date") <= F.to_date(moment)))
        done[name] = _take_out(tables, stage(old.select("event_id").distinct(), f"expire-{name}"), None, (f"expire:{name}", oldest, None))
    return done


def signal() -> Column:
    """Signal class of a stored event: metrics, traces or logs of OTLP; null for other sources."""
    metric = F.col("event_type") == "telemetry.metric"
    span = F.col("event_id").startswith("otel:") | (F.col("event_type") == "otel.span")
    return F.when(F.col("source_kind") == "native_otel", F.when(metric, "metrics").when(span, "traces").otherwise("logs"))


def _candidates(tables: Tables, seen: Snapshot, before, event_ids) -> DataFrame:
    """Stored events among which the selection lies. For ids alone these are the batches that the index names."""
    if before is None and event_ids is not None:
        ids = event_ids
        if not isinstance(ids, DataFrame):
            ids = tables.spark.createDataFrame([(i.strip(),) for i in ids if isinstance(i, str)], "event_id string")
        held = located(tables, ids, seen)
        if held is not None:
            owners = {r[0] for r in held.join(ids.select("event_id").distinct(), "event_id", "left_semi").select("owner").distinct().collect()}  # batches
            return tables.read("events", seen, [p for p in seen.of("events") if p.batch in owners])
    return tables.read("events", seen)


def _take_out(tables: Tables, selection: DataFrame, cut: str | None, said: tuple) -> int:
    kind, before, event_ids = said
    action = f"maintenance:{uuid.uuid4()}"
    seen = tables.snapshot()
    started = tables.write("maintenance_actions", _audit_row(selection, action, before, event_ids, "started", kind), AUDIT)
    seen = tables.commit(seen, [started], [], "audit")
    written: list[Written] = []
    drop: list[Part] = []
    for name, columns in _NAMED.items():
        live = seen.of(name)
        whole = [p for p in live if cut is not None and name in _OF_DATE and p.marks.get("observed_date", cut) < cut]
        rest = [p for p in live if p not in whole]
        touched = _touched(tables, seen, name, columns, rest, selection) if rest else []
        drop += [*whole, *touched]
        new = _rewritten(tables, seen, name, columns, touched, selection) if touched else []
        # The folders of one write know their number, so that backfill can tell a purged one from a lost one.
        for batch in {p.batch for p in [*whole, *touched]}:
            kept = [p for p in live if p.batch == batch and p not in whole and p not in touched]
            made = [p for p in new if p.batch == batch]
            for p in [*kept, *made]:
                p.marks["of"] = str(len(kept) + len(made))
            new += kept
        written.append(Written(new, {}))
        if name == "events":  # the stored minutes of these batches add up their events, so they are made anew
            for batch in {p.batch for p in [*whole, *touched]}:
                drop += [p for p in seen.of("event_rollup") if p.batch == batch]
                if any(p.batch == batch for p in new):
                    rows = tables.read("events", seen, [p for p in new if p.batch == batch])
                    written.append(_projected(tables, "event_rollup", rows, batch))
    written.append(tables.write("maintenance_actions", _audit_row(selection, action, before, event_ids, "completed", kind), AUDIT))
    tables.commit(seen, written, drop, kind)
    return selection.count()


def _anti(df: DataFrame, columns: tuple[str, ...], selection: DataFrame, how: str) -> DataFrame:
    for column in columns:
        df = df.join(selection.withColumnRenamed("event_id", column), column, how)
    return df


def _touched(tables: Tables, seen: Snapshot, name: str, columns: tuple[str, ...], parts: list[Part], selection: DataFrame) -> list[Part]:
    """Folders that hold a purged row; only their ids are read."""
    by = _SPLIT.get(name, "observed_date")
    rows = tables.read(name, seen, parts)
    found: set[tuple] = set()
    for column in columns:
        hit = rows.join(selection.withColumnRenamed("event_id", column), column, "left_semi")
        found |= {tuple(r) for r in hit.select("attempt", *([F.col(by).cast("string")] if by else [])).distinct().collect()}  # folders
    place = lambda p: (p.folder.split("attempt=")[1].split("/")[0], *([p.marks.get(by)] if by else []))
    return [p for p in parts if place(p) in found]


def _rewritten(tables: Tables, seen: Snapshot, name: str, columns: tuple[str, ...], parts: list[Part], selection: DataFrame) -> list[Part]:
    """The rows of some folders that stay, in new folders of the same batches: one job for all."""
    by = _SPLIT.get(name, "observed_date")
    attempt = uuid.uuid4().hex
    kept = _anti(tables.read(name, seen, parts), columns, selection, "left_anti").withColumn("attempt", F.lit(attempt))
    kept.write.mode("append").partitionBy("ingest_batch", "attempt", *([by] if by else [])).parquet(tables.path(name))
    out = []
    for batch in sorted({p.batch for p in parts}):
        old = next(p for p in parts if p.batch == batch)
        top = f"{name}/ingest_batch={batch}/attempt={attempt}"
        new = tables.folders(name, batch, top, old.version, by) if tables.has(top) else []
        for p in new:
            p.marks.update({k: v for k, v in old.marks.items() if k == "filter"})
        out += [p for p in new if by is None or by in p.marks]
    return out


def expire(df: DataFrame, signal: str, now: datetime | str, column: str = "observed_at") -> DataFrame:
    """Rows of one signal class that are still within its retention."""
    oldest = parse_instant(now) - CLASS_RETENTION[signal] // timedelta(microseconds=1)
    return df.where(F.col(column) >= F.timestamp_micros(F.lit(oldest)))
