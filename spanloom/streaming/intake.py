"""Continuous intake and event-time counts with Structured Streaming.

No watermark is set on the intake: late events are accepted forever. Exactly-once comes from the
stream checkpoint together with tables that take a batch in one commit and replace it when it is repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.privacy import Policy
from ..operators.tables import Tables, ingest
from ..session import checkpoint_root
from ..sources.collector import police
from ..sources.hooks import events_from_hooks
from ..sources.jsonl import events_from_lines
from ..sources.otlp import events_from_logs, events_from_metrics, events_from_spans
from ..sources.outcomes import events_from_outcomes
from ..sources.responses import events_from_responses

# Adapter name -> function from raw rows (and columns to carry) to envelope rows with reasons.
ADAPTERS: dict[str, Callable[..., DataFrame]] = {
    "jsonl": events_from_lines,
    "otlp-traces": events_from_spans,
    "otlp-logs": events_from_logs,
    "otlp-metrics": events_from_metrics,
    "responses": events_from_responses,
    "hooks": events_from_hooks,
    "outcomes": events_from_outcomes,
}


def read_text_stream(spark: SparkSession, folder: str, column: str = "line", max_files: int | None = None) -> DataFrame:
    """New text files of a folder, one row per line."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder).withColumnRenamed("value", column)


def start_intake(
    stream: DataFrame, tables: Tables, adapter: str = "jsonl", *, name: str = "intake",
    policy: Policy = Policy(), checkpoint: str | None = None, trigger: dict | None = None, collector: bool = True,
) -> StreamingQuery:
    """Run every micro-batch through the adapter and into the tables. OTLP payloads pass the collector's attribute policy first."""
    decode = ADAPTERS[adapter]
    signal = adapter.removeprefix("otlp-") if collector and adapter.startswith("otlp-") else None

    def one(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("arrival_seq", F.monotonically_increasing_id())
        if signal is not None:
            rows = police(rows, signal)
        ingest(tables, decode(rows, "arrival_seq"), batch_id, policy)

    folder = checkpoint or f"{checkpoint_root(stream.sparkSession)}/{name}"
    return (
        stream.writeStream.queryName(name).foreachBatch(one)
        .option("checkpointLocation", folder)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def tumbling_counts(events: DataFrame, step: str, *labels: str, late: str | None = None) -> DataFrame:
    """Events per tumbling event-time window and labels; works on a stream or a table.

    ``late`` bounds the state of a stream by dropping windows that old; without it every window is
    kept, as late events are accepted forever. Cumulative series are made from the counts in batch.
    """
    if late is not None:
        events = events.withWatermark("observed_at", late)
    return events.groupBy(F.window("observed_at", step), *labels).agg(F.count("*").alias("count")).select(
        F.col("window.start").alias("window_start"), *labels, "count")


def arrival_lag(events: DataFrame, *labels: str) -> DataFrame:
    """How long after the event its record arrived, in seconds."""
    lag: Column = (F.unix_micros("received_at") - F.unix_micros("observed_at")) / F.lit(1_000_000)
    return events.groupBy(*labels).agg(
        F.min(lag).alias("min_lag_s"), F.max(lag).alias("max_lag_s"), F.avg(lag).alias("avg_lag_s"),
        F.count("*").alias("events"))
