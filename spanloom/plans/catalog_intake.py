"""Registered queries of normalization, redaction, intake and correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import privacy as P
from ..operators import correlate as C
from ..operators import intake as I
from ..operators import normalize as N
from ..operators import redact as R
from ..operators.projections import HIERARCHY
from ..schema import FLAG_FIELDS, NUMBER_FIELDS, SECTIONS, TEXT_FIELDS, RENAMED, flat_columns
from ..session import stage
from ..sources import jsonl
from . import inputs
from .registry import Registry

W = inputs.WITH
WA = f"WITH {inputs.EV}, {inputs.ATTEMPTS}"

FLAT = [name for name, _ in flat_columns() if name not in ("source_version",)]
FLAT_SQL = ", ".join(FLAT)


def iso(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def envelope_struct(**replaced: Column) -> Column:
    """Nested envelope struct of flat rows; ``replaced`` maps section__field to another column."""
    sections = []
    for s in SECTIONS:
        parts = []
        for group in (TEXT_FIELDS, NUMBER_FIELDS, FLAG_FIELDS):
            for n in group.get(s, ()):
                flat = RENAMED.get((s, n), n)
                if f"{s}__{n}" in replaced:
                    parts.append(replaced[f"{s}__{n}"].alias(n))
                elif s != "provenance" and flat in FLAT:
                    parts.append(F.col(flat).alias(n))
        if s == "provenance":
            parts.append(F.map_filter("provenance_fields", lambda k, v: v.isNotNull()).alias("fields"))
        sections.append(F.struct(*parts).alias(s))
    return F.struct(
        "schema_version", "event_id", "event_type", iso("observed_at").alias("observed_at"),
        iso("received_at").alias("received_at"), *sections,
        *[replaced[k].alias(k) for k in ("attributes", "extensions", "stray") if k in replaced],
    )


def lines(flat: DataFrame, *carry: str, **replaced: Column) -> DataFrame:
    return flat.select(*carry, F.to_json(envelope_struct(**replaced)).alias("line"))


def digested(flat: DataFrame) -> DataFrame:
    """Attempts through the whole path: text, parse, normalize, redact, digest, flatten."""
    rows = jsonl.events_from_lines(lines(flat, "arrival_seq"), "arrival_seq")
    safe = R.with_digest(R.redact(N.accepted(rows)))
    flat_rows = R.flatten(safe, "arrival_seq", "payload_digest").withColumn("arrived_at", F.col("received_at"))
    return stage(flat_rows, "attempts")


# Check SQL of correlation: every pair, then every edge.
PAIRS = """
      stored AS (SELECT *, (outcome_kind IS NOT NULL OR outcome_status IS NOT NULL) AS is_outcome,
        (outcome_kind IS NOT NULL OR outcome_status IS NOT NULL OR correlation_id IS NOT NULL OR correlation_basis IS NOT NULL) AS is_row
        FROM ev),
      vals AS (SELECT event_id, arrival_seq, UNNEST([
        {'b': 'task_id', 'v': task_id}, {'b': 'session_id', 'v': session_id}, {'b': 'workflow_id', 'v': workflow_id},
        {'b': 'agent_id', 'v': agent_id}, {'b': 'subagent_id', 'v': subagent_id}, {'b': 'trace_id', 'v': trace_id},
        {'b': 'worktree', 'v': worktree}, {'b': 'event_id', 'v': event_id}]) AS bv FROM stored),
      claims AS (SELECT o.event_id, o.arrival_seq, COALESCE(correlation_basis, 'task_id') AS b,
        CASE WHEN correlation_basis IS NULL THEN task_id ELSE COALESCE(correlation_id, CASE WHEN correlation_basis <> 'event_id' THEN v.bv.v END) END AS v
        FROM stored o LEFT JOIN vals v ON v.event_id = o.event_id AND v.bv.b = o.correlation_basis WHERE is_outcome),
      pairs AS (
        SELECT c.event_id AS later_id, v.event_id AS earlier_id FROM claims c JOIN vals v ON v.bv.b = c.b AND v.bv.v = c.v
        WHERE v.arrival_seq < c.arrival_seq
        UNION
        SELECT e.event_id, y.event_id FROM stored e JOIN stored y ON y.task_id = e.task_id
        WHERE NOT e.is_outcome AND y.is_row AND y.arrival_seq < e.arrival_seq
        UNION
        SELECT e.event_id, y.event_id FROM stored e JOIN vals v ON v.event_id = e.event_id
          JOIN stored y ON y.correlation_basis = v.bv.b AND y.correlation_id = v.bv.v
        WHERE NOT e.is_outcome AND y.is_row AND y.arrival_seq < e.arrival_seq)"""
EDGES = " UNION ALL ".join(
    f"SELECT event_id AS child_event_id, {'parent_event_id' if r == 'parent_event' else 'NULL'} AS parent_event_id, "
    f"'{r}' AS relation, {c} AS target_id, "
    + ("COALESCE(pv_session, pv_execution, 'unknown')" if r == "session" else "COALESCE(pv_execution, 'unknown')")
    + f" AS evidence_source, observed_at, received_at FROM ev WHERE {c} IS NOT NULL"
    for r, c in HIERARCHY.items()
)
CORRELATED = """SELECT later_id AS child_event_id, earlier_id AS parent_event_id, 'outcome_correlation' AS relation, earlier_id AS target_id,
    COALESCE(pv_execution, 'unknown') AS evidence_source, observed_at, received_at FROM pairs JOIN ev ON event_id = later_id
    UNION ALL SELECT earlier_id, later_id, 'outcome_correlation', later_id, COALESCE(pv_execution, 'unknown'), observed_at, received_at
    FROM pairs JOIN ev ON event_id = later_id"""


def register(reg: Registry) -> None:
    def ev(fn):
        return lambda spark, d: fn(inputs.spread_events(spark, d))

    # Normalization.
    reg.add(
        "jsonl_events",
        ev(lambda e: R.flatten(N.accepted(jsonl.events_from_lines(lines(e, "arrival_seq"), "arrival_seq"))).select(*FLAT)),
        f"{W} SELECT {FLAT_SQL} FROM ev",
    )

    def broken(e: DataFrame) -> DataFrame:
        """Lines with a wrong type or a missing value, by what kind of event it is."""
        docs = e.select("event_id", "role", "skill", "branch", "status", F.to_json(envelope_struct()).alias("line"))
        text = F.col("line")
        for test, pattern, other in (
            (F.col("role") == "review", '"duration_ms":([0-9.]+)', '"duration_ms":"$1"'),
            (F.col("skill") == "skill-1", '"observed_at":"([^"Z]+)Z"', '"observed_at":"$1"'),
            (F.col("skill") == "skill-2", '"duration_ms":"?([0-9.]+)"?', '"duration_ms":-5'),
            (F.col("branch") == "dev", '"timeout":(true|false)', '"timeout":"$1"'),
            (F.col("status") == "unknown", "^.", "["),
        ):
            text = F.regexp_replace(text, F.when(test, pattern).otherwise("(?!)"), F.lit(other))
        return docs.select("event_id", text.alias("line"))

    reg.add(
        "jsonl_rejects",
        ev(lambda e: N.rejected(jsonl.events_from_lines(broken(e).withColumnRenamed("event_id", "sent_id"), "sent_id"), "sent_id")
           .select("sent_id", F.array_join("reasons", "; ").alias("reasons"))),
        f"""{W} SELECT event_id AS sent_id, CASE WHEN status = 'unknown' THEN 'invalid JSON' ELSE array_to_string(list_filter([
          CASE WHEN skill = 'skill-1' THEN 'observed_at must be ISO-8601 with a timezone' END,
          CASE WHEN skill = 'skill-2' OR role = 'review' THEN 'performance.duration_ms must be a non-negative number or null' END,
          CASE WHEN branch = 'dev' AND timeout IS NOT NULL THEN 'reliability.timeout must be boolean or null' END
          ], lambda x: x IS NOT NULL), '; ') END AS reasons
        FROM ev WHERE status = 'unknown' OR skill IN ('skill-1','skill-2') OR role = 'review' OR (branch = 'dev' AND timeout IS NOT NULL)""",
    )

    def aliased(e: DataFrame) -> DataFrame:
        """Other spellings: counts as lists, hoisted attributes, camelCase parents, unknown keys."""
        names = F.transform(F.sequence(F.lit(1), F.greatest(F.coalesce("tool_call_count", F.lit(1)), F.lit(1)).cast("int")),
                            lambda i: F.struct(F.concat(F.lit("tool-"), (i % 2).cast("string")).alias("name")))
        doc = F.struct(
            "schema_version", "event_id", "event_type", iso("observed_at").alias("observed_at"),
            F.struct(F.col("agent_id"), F.col("parent_agent_id").alias("parentAgentId")).alias("execution"),
            F.struct(F.when(F.col("tool_call_count").isNotNull(), names).alias("tool_calls"),
                     F.col("files_changed_count").alias("files_changed")).alias("behavior"),
            F.struct("status", F.col("agent_failure").alias("agentFailure"), F.col("rework_count").alias("reworkCount"),
                     F.col("lane").alias("lane_hint")).alias("reliability"),
            F.struct(F.col("reassessment_count").alias("reassessments"), F.col("commands_executed_count").alias("commands_executed"))
            .alias("attributes"),
            F.col("skill").alias("stray"),
        )
        return e.select(F.to_json(doc).alias("line"))

    reg.add(
        "normalize_aliases",
        ev(lambda e: N.accepted(jsonl.events_from_lines(aliased(e))).select(
            "event_id", "execution.parent_agent_id", "behavior.tool_call_count",
            F.array_join("behavior.tool_names", ",").alias("tool_names"), "behavior.files_changed_count",
            "behavior.commands_executed_count", "reliability.agent_failure", "reliability.rework_count",
            "reliability.reassessment_count", F.col("project.project_id").alias("project_id"), F.col("llm.provider").alias("provider"),
            "extensions")),
        f"""{W} SELECT event_id, parent_agent_id, tool_call_count,
          CASE WHEN tool_call_count IS NULL THEN '' WHEN tool_call_count >= 2 THEN 'tool-1,tool-0' ELSE 'tool-1' END AS tool_names,
          files_changed_count, commands_executed_count, agent_failure, rework_count, reassessment_count,
          'project:unknown' AS project_id, 'unknown' AS provider,
          concat('{{"unknown_fields":{{"reliability":{{', CASE WHEN agent_failure IS NULL THEN '' ELSE concat('"agentFailure":', CAST(agent_failure AS VARCHAR), ',') END,
            '"lane_hint":"', lane, '"}}}}', CASE WHEN skill IS NULL THEN '' ELSE concat(',"unknown_top_level":{{"stray":"', skill, '"}}') END, '}}') AS extensions
        FROM ev""",
    )
    reg.add(
        "assigned_ids",
        ev(lambda e: N.accepted(jsonl.events_from_lines(e.select("arrival_seq", F.to_json(F.struct(
            "event_type", iso("observed_at").alias("observed_at"), F.struct("trace_id", "span_id").alias("execution"),
            F.struct(F.col("session_id").alias("prompt")).alias("attributes"))).alias("line")), "arrival_seq"))
           .select("arrival_seq", "event_id")),
        f"""{W} SELECT arrival_seq, concat('evt_sha256_', sha256(concat('{{"attributes":{{}},"event_type":"', event_type,
          '","execution":{{"span_id":"', span_id, '","trace_id":"', trace_id, '"}},"observed_at":"',
          strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%f'), 'Z","schema_version":"1.0","source":{{"kind":"adapter","name":"jsonl"}}}}'))) AS event_id
        FROM ev""",
    )
    reg.add(
        "body_documents",
        lambda spark, d: jsonl.explode_bodies(
            lines(inputs.spread_events(spark, d), "trace_id", "arrival_seq").select(
                "trace_id", "arrival_seq", F.concat(F.lit("["), "line", F.lit(",5,"), "line", F.lit("]")).alias("body")),
            "trace_id", "arrival_seq",
        ).select("arrival_seq", F.col("index").cast("bigint").alias("index"), F.get_json_object(F.to_json("doc"), "$.event_id").alias("event_id")),
        f"{W} SELECT arrival_seq, CAST(i AS BIGINT) AS index, CASE WHEN i = 1 THEN NULL ELSE event_id END AS event_id "
        "FROM ev, (SELECT unnest([0, 1, 2]) AS i)",
    )

    # Intake.
    decisions_sql = """
      SELECT event_id, arrival_seq, CASE WHEN arrival_seq = first_seq THEN 'inserted'
        WHEN duration_ms = first_duration THEN 'duplicate' ELSE 'conflict' END AS decision FROM (
        SELECT *, MIN(arrival_seq) OVER (PARTITION BY event_id) AS first_seq,
          FIRST_VALUE(duration_ms) OVER (PARTITION BY event_id ORDER BY arrival_seq) AS first_duration FROM attempts)"""
    classified = lambda e: I.classify(digested(inputs.attempts(e)))
    reg.add("intake_decisions", ev(lambda e: classified(e).select("event_id", "arrival_seq", "decision")),
            f"{WA} {decisions_sql}")
    reg.add(
        "intake_ledger",
        ev(lambda e: I.ledger(classified(e), "arrival_seq").select(
            "event_id", "arrival_seq", "observed_at", "source_kind", "source_name", "decision", "reason")),
        f"""{WA} SELECT d.event_id, d.arrival_seq, observed_at, source_kind, source_name, decision,
          CASE WHEN decision = 'conflict' THEN 'event_id replay has a different payload' END AS reason
          FROM ({decisions_sql}) d JOIN attempts a ON a.arrival_seq = d.arrival_seq""",
    )
    def unreadable(e: DataFrame) -> DataFrame:
        """Rejects: lines that are no JSON, some in batches of their own."""
        lost = e.where((F.col("status") == "unknown") & F.pmod("arrival_seq", F.lit(5)).isin(1, 4))
        rows = jsonl.events_from_lines(lost.select("arrival_seq", F.lit("{bad").alias("line")), "arrival_seq")
        return N.rejected(rows, "arrival_seq").withColumn("ingest_batch", F.pmod("arrival_seq", F.lit(5)))

    reg.add(
        "intake_batch_counts",
        ev(lambda e: I.batch_counts(classified(e).withColumn("ingest_batch", F.pmod("arrival_seq", F.lit(4))), unreadable(e))),
        f"""{WA}, kept AS (SELECT arrival_seq % 4 AS b, COUNT(*) FILTER (decision = 'inserted') AS inserted,
            COUNT(*) FILTER (decision = 'duplicate') AS duplicate, COUNT(*) FILTER (decision = 'conflict') AS conflict FROM ({decisions_sql}) GROUP BY 1),
          lost AS (SELECT arrival_seq % 5 AS b, COUNT(*) AS n FROM ev WHERE status = 'unknown' AND arrival_seq % 5 IN (1, 4) GROUP BY 1)
          SELECT COALESCE(kept.b, lost.b) AS ingest_batch, COALESCE(inserted, 0) AS inserted, COALESCE(duplicate, 0) AS duplicate,
          COALESCE(conflict, 0) AS conflict, COALESCE(n, 0) AS rejected,
          CASE WHEN n IS NULL THEN 'accepted' WHEN kept.b IS NULL THEN 'rejected' ELSE 'accepted_with_rejections' END AS verdict
          FROM kept FULL JOIN lost ON kept.b = lost.b""",
    )
    reg.add(
        "intake_against_stored",
        ev(lambda e: I.classify(digested(inputs.attempts(e)), digested(e).select("event_id", "payload_digest"))
           .groupBy("decision").agg(F.count("*").alias("attempts"))),
        f"""{WA} SELECT CASE WHEN arrival_seq % 4 = 2 THEN 'conflict' ELSE 'duplicate' END AS decision, COUNT(*) AS attempts
          FROM attempts GROUP BY 1""",
    )
    reg.add("conflict_rows", ev(lambda e: I.conflicts(classified(e)).select("event_id", "arrived_at")),
            f"{W} SELECT event_id, received_at AS arrived_at FROM ev WHERE status = 'failed'")
    reg.add("conflict_count", ev(lambda e: I.conflict_count(I.conflicts(classified(e)))),
            f"{W} SELECT COUNT(*) AS conflicts FROM ev WHERE status = 'failed'")
    reg.add(
        "ledger_listing",
        ev(lambda e: I.ledger_listing(I.ledger(classified(e), "arrival_seq"), order=("arrival_seq",))
           .select("event_id", "arrival_seq", "decision")),
        f"{WA} {decisions_sql}",
    )
    reg.add(
        "ledger_backfill",
        ev(lambda e: (lambda stored: I.backfill_ledger(stored, I.ledger(stored.where(F.col("route") == "direct").withColumns(
            {"decision": F.lit("inserted"), "reason": F.lit(None).cast("string")}))).select("event_id", "decision", "reason"))(digested(e))),
        f"{W} SELECT event_id, 'backfill' AS decision, 'projection backfill during schema initialization' AS reason FROM ev WHERE route <> 'direct'",
    )

    # Correlation.
    reg.add(
        "correlation_degrees", ev(C.correlation_degrees),
        f"""{W}, {PAIRS} SELECT event_id, CAST(SUM(e) AS BIGINT) AS earlier_partners, CAST(SUM(l) AS BIGINT) AS later_partners FROM (
          SELECT later_id AS event_id, 1 AS e, 0 AS l FROM pairs UNION ALL SELECT earlier_id, 0, 1 FROM pairs) GROUP BY event_id""",
    )
    reg.add(
        "edge_counts", ev(C.edge_counts),
        f"{W}, {PAIRS} SELECT relation, COUNT(*) AS edges FROM ({EDGES} UNION ALL {CORRELATED}) GROUP BY relation",
    )
    ids = ["evt-16", "evt-400", "evt-777"]
    listed = ", ".join(f"'{i}'" for i in ids)
    reg.add(
        "edge_listing", ev(lambda e: C.edge_listing(e, ids)),
        f"""{W}, {PAIRS} SELECT * FROM ({EDGES} UNION ALL {CORRELATED}) WHERE child_event_id IN ({listed}) OR parent_event_id IN ({listed})""",
    )
