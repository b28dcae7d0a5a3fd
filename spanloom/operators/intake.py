"""Idempotent intake: first arrival of an event id wins; every attempt is kept in a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .filters import first_rows
from .skew import hot_keys, salted_lookup

CONFLICT_REASON = "event_id replay has a different payload"
BACKFILL_REASON = "projection backfill during schema initialization"


def classify(
    attempts: DataFrame, existing: DataFrame | None = None, order: tuple[str, ...] = ("arrival_seq",),
) -> DataFrame:
    """Adds ``decision`` (inserted, duplicate, conflict) and ``reason`` to every attempt.

    ``attempts`` needs event_id, payload_digest and the order columns; ``existing`` is the stored
    (event_id, payload_digest), one row per id. The first copy per id is found by a partially
    aggregated minimum, so a much-repeated id reaches the shuffle as one row per task; looking the
    winner up again spreads hot ids over salts.
    """
    position = F.struct(*order)
    first = attempts.groupBy("event_id").agg(
        F.min(position).alias("_first"),
        F.min_by("payload_digest", position).alias("_first_digest"),
        F.count("*").alias("n"),
    )
    winners = first.select("event_id", "_first", "_first_digest")
    if existing is not None:
        stored = existing.select("event_id", F.col("payload_digest").alias("_stored"))
        winners = winners.join(stored, "event_id", "left")
    else:
        winners = winners.withColumn("_stored", F.lit(None).cast("string"))
    rows = salted_lookup(attempts, winners, "event_id", hot_keys(first, "event_id"), position)
    new = F.col("_stored").isNull() & (position == F.col("_first"))
    same = F.col("payload_digest") == F.coalesce("_stored", "_first_digest")
    decision = F.when(new, "inserted").when(same, "duplicate").otherwise("conflict")
    return rows.withColumn("decision", decision).withColumn(
        "reason", F.when(F.col("decision") == "conflict", CONFLICT_REASON)
    ).drop("_first", "_first_digest", "_stored")


def inserted(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("decision") == "inserted").drop("decision", "reason")


def conflicts(classified: DataFrame, payload: Column | None = None) -> DataFrame:
    """Differing replays; the stored event is not touched."""
    return classified.where(F.col("decision") == "conflict").select(
        "event_id", F.col("payload_digest").alias("conflict_digest"),
        *([] if payload is None else [payload.alias("conflict_payload_json")]),
        "arrived_at",
    )


def ledger(classified: DataFrame, *carry: str) -> DataFrame:
    """One row per attempt. ``received_at`` is the arrival time of the attempt."""
    return classified.select(
        "event_id", "observed_at", F.col("arrived_at").alias("received_at"), "source_kind",
        "source_name", "payload_digest", "decision", "reason", *carry,
    )


def batch_counts(classified: DataFrame, rejects: DataFrame | None = None, batch: str = "ingest_batch") -> DataFrame:
    """Per batch: inserted, duplicate, conflict, rejected and the verdict."""
    rows = classified.select(batch, "decision")
    if rejects is not None:
        rows = rows.unionByName(rejects.select(batch, F.lit("rejected").alias("decision")))
    kinds = ("inserted", "duplicate", "conflict", "rejected")
    counts = rows.groupBy(batch).agg(
        *[F.count(F.when(F.col("decision") == k, True)).alias(k) for k in kinds]
    )
    return counts.withColumn("verdict", batch_verdict())


def batch_verdict() -> Column:
    kept = F.col("inserted") + F.col("duplicate") + F.col("conflict")
    return (
        F.when(F.col("rejected") == 0, "accepted")
        .when(kept > 0, "accepted_with_rejections")
        .otherwise("rejected")
    )


def conflict_count(conflict_rows: DataFrame, event_id: str | None = None) -> DataFrame:
    rows = conflict_rows if event_id is None else conflict_rows.where(F.col("event_id") == event_id)
    return rows.agg(F.count("*").alias("conflicts"))


def ledger_listing(ledger_rows: DataFrame, event_id: str | None = None, limit: int | None = None,
                   order: tuple[str, ...] = ("ledger_id",)) -> DataFrame:
    """Attempts; with a limit the newest ones."""
    rows = ledger_rows if event_id is None else ledger_rows.where(F.col("event_id") == event_id)
    return first_rows(rows, limit, *[F.desc(c) for c in order])


def backfill_ledger(events: DataFrame, ledger_rows: DataFrame) -> DataFrame:
    """Ledger rows for stored events that have none."""
    return events.join(ledger_rows.select("event_id"), "event_id", "left_anti").select(
        "event_id", "observed_at", "received_at", "source_kind", "source_name", "payload_digest",
        F.lit("backfill").alias("decision"), F.lit(BACKFILL_REASON).alias("reason"),
    )


def missing_projection(rebuilt: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """Rebuilt projection rows whose key is not stored yet."""
    return rebuilt.join(stored.select(*keys), list(keys), "left_anti")
