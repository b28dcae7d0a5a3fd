"""Input frames of the registered queries, derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.projections import outcome_events
from ..session import spread
from ..sources.derived import envelope_sql, flat_events


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_events(spark, read(spark, sf_dir, "events"))


def spread_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, over all cores even when the table is one small file."""
    return flat_events(spark, spread(read(spark, sf_dir, "events")))


def attempts(events_df: DataFrame) -> DataFrame:
    """Intake attempts: every event once, views sent again unchanged, errors again with a change."""
    first = events_df.withColumn("arrival_seq", F.col("arrival_seq") * 4)
    again = first.where(F.col("event_type") == "model.operation").where(
        F.col("context_size").isNotNull()
    ).withColumn("arrival_seq", F.col("arrival_seq") + 1)
    changed = first.where(F.col("status") == "failed").withColumns({
        "arrival_seq": F.col("arrival_seq") + 2,
        "duration_ms": F.col("duration_ms") + 1,
    })
    return first.unionByName(again).unionByName(changed)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    ev = events(spark, sf_dir)
    return {
        "events": ev,
        "outcomes": outcome_events(ev),
        "conflicts": ev.where(F.col("status") == "failed").select("event_id"),
    }


# The same inputs for the SQL checks.
EV = f"ev AS ({envelope_sql('duckdb')})"
OUTCOMES = """outcome_rows AS (
  SELECT event_id, outcome_kind AS kind, outcome_status AS status, correlation_id, correlation_basis,
         COALESCE(evidence_source, 'unknown') AS evidence_source, observed_at, received_at
  FROM ev
  WHERE outcome_kind IS NOT NULL OR outcome_status IS NOT NULL
     OR correlation_id IS NOT NULL OR correlation_basis IS NOT NULL)"""
CONFLICTS = "conflict_rows AS (SELECT event_id FROM ev WHERE status = 'failed')"
WITH = f"WITH {EV}, {OUTCOMES}, {CONFLICTS}"
ATTEMPTS = """attempts AS (
  SELECT * REPLACE (arrival_seq * 4 AS arrival_seq) FROM ev
  UNION ALL BY NAME
  SELECT * REPLACE (arrival_seq * 4 + 1 AS arrival_seq) FROM ev
  WHERE event_type = 'model.operation' AND context_size IS NOT NULL
  UNION ALL BY NAME
  SELECT * REPLACE (arrival_seq * 4 + 2 AS arrival_seq, duration_ms + 1 AS duration_ms) FROM ev
  WHERE status = 'failed')"""
