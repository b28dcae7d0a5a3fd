"""Registered queries of responses, hooks, outcome records and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import privacy as P
from ..operators import normalize as N
from ..operators import redact as R
from ..sources import hooks, jsonl, outcomes, responses
from . import inputs
from .catalog_intake import lines
from .registry import Registry

W = inputs.WITH


def response_rows(e: DataFrame) -> DataFrame:
    c = F.col
    i, o, r = (F.col(n).cast("bigint") for n in ("input_tokens", "output_tokens", "reasoning_tokens"))
    calls = F.transform(F.sequence(F.lit(1), F.col("tool_call_count").cast("int")), lambda n: F.struct(
        F.concat(F.lit("c"), n.cast("string")).alias("id"), F.lit("function").alias("type"),
        F.struct(F.concat(F.lit("f"), (n % 2).cast("string")).alias("name"), F.lit("{}").alias("arguments")).alias("function")))
    body = F.struct(
        c("model"), F.concat(F.lit("r-"), c("event_id")).alias("id"),
        F.when(c("provider") == "anthropic", F.struct(i.alias("input_tokens"), o.alias("output_tokens"), c("cache_read_tokens").alias("cache_read_input_tokens")))
        .alias("usage_a"),
        F.when(c("provider") == "google", F.struct(i.alias("promptTokenCount"), o.alias("candidatesTokenCount"), r.alias("thoughtsTokenCount"))).alias("usageMetadata"),
        F.when(~c("provider").isin("anthropic", "google"), F.struct(i.alias("prompt_tokens"), o.alias("completion_tokens"),
               F.struct(r.alias("reasoning_tokens")).alias("completion_tokens_details"), c("total_tokens"))).alias("usage_d"),
        c("cost"), F.when(c("rate_limited"), 429).when(c("timeout"), 504).alias("status_code"),
        F.when(c("agent_failure"), F.struct(F.lit("Too Many Requests").alias("type"))).alias("error"),
        c("session_id").alias("sessionId"), c("skill").alias("skill_name"), F.when(c("tool_call_count").isNotNull(), calls).alias("tool_calls"),
        c("rework_count").alias("reworkCount"), c("lane").alias("future_lane"), c("files_changed_count").alias("filesChangedCount"),
    )
    text = F.replace(F.replace(F.to_json(body), F.lit('"usage_a":'), F.lit('"usage":')), F.lit('"usage_d":'), F.lit('"usage":'))
    return e.select("arrival_seq", "provider", "client", "route", "auth_mode", F.lit("gateway").alias("usage_source"),
                    "observed_at", "latency_ms", "duration_ms", text.alias("response_json"))


def hook_rows(e: DataFrame) -> DataFrame:
    c = F.col
    inner = F.struct(c("session_id"), c("tool_duration_ms").alias("toolDurationMs"), F.struct(c("output_tokens")).alias("usage"))
    body = F.struct(
        c("event_id").alias("id"), F.when(c("event_type") == "tool.operation", "PostToolUse").when(c("status") == "failed", "Interrupt")
        .when(c("lane") == "primary", "Session Start").otherwise("ping!").alias("hook_event_name"),
        F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), inner.alias("data"), c("input_tokens"),
        F.when(c("event_type") == "tool.operation", F.concat(c("lane"), F.lit("  tool"))).alias("tool_name"), c("tool_failure").alias("is_error"),
        F.concat(F.lit("bad id "), c("agent_id")).alias("agent_id"), c("skill").alias("prompt"))
    client = F.when(c("provider") == "anthropic", " Anthropic").when(c("provider") == "openai", "codex").otherwise(c("client"))
    return e.select("arrival_seq", client.alias("client"), F.to_json(body).alias("payload_json"))


def register(reg: Registry) -> None:
    def ev(fn):
        return lambda spark, d: fn(inputs.spread_events(spark, d))

    reg.add(
        "response_events",
        ev(lambda e: N.accepted(responses.events_from_responses(response_rows(e), "arrival_seq")).select(
            "arrival_seq", "event_type", "observed_at", F.col("source.name").alias("source_name"), "llm.provider", "llm.model",
            "execution.session_id", "execution.skill", "usage.input_tokens", "usage.output_tokens", "usage.cache_read_tokens",
            "usage.reasoning_tokens", "usage.total_tokens", "usage.cost", F.col("usage.source").alias("usage_source"),
            "reliability.status", "reliability.error_kind", "reliability.rate_limited", "reliability.timeout", "reliability.rework_count",
            "behavior.tool_call_count", "behavior.files_changed_count", F.array_join("behavior.tool_names", ",").alias("tool_names"),
            F.try_element_at("provenance.fields", F.lit("usage.total_tokens")).alias("total_evidence"), "extensions")),
        f"""{W} SELECT arrival_seq, 'model.operation' AS event_type, observed_at, concat('response:', client) AS source_name, provider, model,
          session_id, skill, input_tokens, output_tokens, CASE WHEN provider = 'anthropic' THEN cache_read_tokens END AS cache_read_tokens,
          CASE WHEN provider <> 'anthropic' THEN reasoning_tokens END AS reasoning_tokens, total_tokens, cost,
          CASE WHEN input_tokens IS NULL AND cost IS NULL AND (provider <> 'anthropic' OR cache_read_tokens IS NULL) AND (provider = 'anthropic' OR reasoning_tokens IS NULL)
            THEN 'unknown' ELSE 'gateway' END AS usage_source,
          CASE WHEN rate_limited OR timeout OR agent_failure THEN 'failed' ELSE 'succeeded' END AS status,
          CASE WHEN agent_failure OR rate_limited THEN 'rate_limited' WHEN timeout THEN 'timeout' END AS error_kind,
          CASE WHEN rate_limited OR agent_failure THEN TRUE END AS rate_limited,
          CASE WHEN timeout AND NOT rate_limited THEN TRUE END AS timeout, rework_count, tool_call_count, files_changed_count,
          CASE WHEN tool_call_count IS NULL THEN '' WHEN tool_call_count >= 2 THEN 'f1,f0' ELSE 'f1' END AS tool_names,
          CASE WHEN total_tokens IS NULL THEN 'unknown' WHEN provider IN ('anthropic', 'google') THEN 'derived' ELSE 'gateway' END AS total_evidence,
          concat('{{"provider":{{"future_lane":"', lane, '"}}}}') AS extensions FROM ev""",
    )
    reg.add(
        "hook_events",
        ev(lambda e: N.accepted(hooks.events_from_hooks(hook_rows(e), "arrival_seq")).select(
            "arrival_seq", "event_id", "event_type", "observed_at", "llm.provider", "llm.client", "execution.session_id", "execution.agent_id",
            "usage.input_tokens", "usage.output_tokens", "performance.tool_duration_ms", "reliability.status", "reliability.tool_failure",
            "reliability.aborted", "behavior.tool_call_count", F.array_join("behavior.tool_names", ",").alias("tool_names"),
            F.col("outcome.status").alias("outcome_status"), "attributes")),
        f"""{W} SELECT arrival_seq, event_id, CASE WHEN event_type = 'tool.operation' THEN 'tool.operation'
            WHEN status = 'failed' OR lane = 'primary' THEN 'agent.lifecycle' ELSE 'telemetry.log' END AS event_type, observed_at,
          CASE WHEN provider IN ('anthropic', 'openai') THEN provider ELSE 'unknown' END AS provider,
          CASE provider WHEN 'anthropic' THEN 'claude-code' WHEN 'openai' THEN 'codex' ELSE client END AS client,
          session_id, CAST(NULL AS VARCHAR) AS agent_id, input_tokens, output_tokens, tool_duration_ms,
          CASE WHEN tool_failure THEN 'failed' WHEN event_type <> 'tool.operation' AND status = 'failed' THEN 'aborted' ELSE 'unknown' END AS status,
          tool_failure, event_type <> 'tool.operation' AND status = 'failed' AS aborted,
          CASE WHEN event_type = 'tool.operation' THEN 1.0::DOUBLE END AS tool_call_count,
          CASE WHEN event_type = 'tool.operation' THEN concat(lane, '_tool') ELSE '' END AS tool_names, name AS outcome_status,
          concat('{{', CASE WHEN tool_failure THEN '"error_reported":"true",' ELSE '' END, '"hook_contract":"hook/v1","hook_event":"', name, '"',
            CASE WHEN event_type = 'tool.operation' THEN concat(',"tool_name":"', lane, '_tool"') ELSE '' END, '}}') AS attributes
          FROM (SELECT *, CASE WHEN event_type = 'tool.operation' THEN 'PostToolUse' WHEN status = 'failed' THEN 'Interrupt'
            WHEN lane = 'primary' THEN 'Session_Start' ELSE 'ping_' END AS name FROM ev)""",
    )
    reg.add(
        "outcome_record_events",
        lambda spark, d: N.accepted(outcomes.events_from_outcomes(
            inputs.read(spark, d, "labels").select(
                "doc_id", F.lit("review").alias("kind"), F.when(F.col("quality") == 1, "Accepted").when(F.col("toxic") == 1, "timeout").otherwise("draft").alias("status"),
                F.timestamp_seconds("doc_id").alias("observed_at"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("task_id")),
            "doc_id")).select("doc_id", "event_type", "reliability.status", "reliability.timeout", "reliability.aborted",
                              F.col("outcome.status").alias("outcome_status"), "outcome.evidence_source", "execution.task_id"),
        """SELECT doc_id, 'outcome.review' AS event_type, CASE WHEN quality = 1 THEN 'succeeded' WHEN toxic = 1 THEN 'failed' ELSE 'unknown' END AS status,
          COALESCE(quality, 0) <> 1 AND COALESCE(toxic, 0) = 1 AS timeout, FALSE AS aborted,
          CASE WHEN quality = 1 THEN 'Accepted' WHEN toxic = 1 THEN 'timeout' ELSE 'draft' END AS outcome_status, 'unknown' AS evidence_source,
          concat('doc-', CAST(doc_id AS VARCHAR)) AS task_id FROM labels""",
    )

    # Redaction.
    def secretive(e: DataFrame) -> DataFrame:
        """Secrets, paths and content put into fields and bags by what the event is."""
        c = F.col
        extra = F.struct(c("skill").alias("prompt"), F.concat(F.lit("sk-"), F.sha2(c("event_id"), 256)).alias("note"),
                         F.struct(c("lane").alias("password"), F.array(c("lane"), F.lit("~/x")).alias("places")).alias("inner"))
        return lines(
            e, "arrival_seq",
            execution__role=F.when(c("status") == "failed", F.concat(F.lit("Bearer "), F.sha2(c("event_id"), 256))).otherwise(c("role")),
            execution__lane=F.when(c("client") == "cli-a", F.concat(F.lit("/home/"), c("lane"))).otherwise(c("lane")),
            project__project_id=F.when(c("auth_mode") == "api", F.concat(F.lit("C:\\Repos\\"), c("project_id"))).otherwise(c("project_id")),
            project__remote=F.concat(F.lit("https://user:pw@Host.example/"), c("project_id"), F.lit("/?x=1")),
            execution__skill=F.repeat(c("skill"), 100), attributes=extra)

    reg.add(
        "redacted_events",
        ev(lambda e: R.redact(N.accepted(jsonl.events_from_lines(secretive(e), "arrival_seq"))).select(
            "arrival_seq", "event_id", "execution.role", "execution.lane", "execution.skill", "project.project_id", "project.remote", "attributes")),
        f"""{W} SELECT arrival_seq, event_id, CASE WHEN status = 'failed' THEN '[REDACTED]' ELSE role END AS role,
          CASE WHEN client = 'cli-a' THEN '[PATH_REDACTED]' ELSE lane END AS lane,
          CASE WHEN skill IS NOT NULL THEN repeat(skill, 100) END AS skill,
          CASE WHEN auth_mode = 'api' THEN concat('project_sha256:', sha256(lower(concat('C:/Repos/', project_id)))) ELSE project_id END AS project_id,
          concat('https://host.example/', project_id) AS remote,
          concat('{{"inner":{{"password":"[REDACTED]","places":["', lane, '","[PATH_REDACTED]"]}},"note":"[REDACTED]"',
            CASE WHEN skill IS NULL THEN '' ELSE ',"prompt":"[CONTENT_REDACTED]"' END, '}}') AS attributes FROM ev""",
    )
    secret_sql = "regexp_matches(text, '(?i)\\b(?:bearer|basic)\\s+[A-Za-z0-9._~+/=-]{4,}') OR regexp_matches(text, '(?i)\\b(?:sk|xai|gsk)-[A-Za-z0-9_-]{8,}') " \
        "OR regexp_matches(text, '(?i)\\bAIza[A-Za-z0-9_-]{16,}') OR regexp_matches(text, '\\b(?:AKIA|ASIA)[0-9A-Z]{16}\\b') OR " \
        "regexp_matches(text, '(?i)(?:api[_-]?key|access[_-]?key(?:[_-]?id)?|secret[_-]?access[_-]?key|subscription[_-]?key|token|password)\\s*[=:]\\s*[A-Za-z0-9._~+/=-]{8,}')"
    masked_sql = f"CASE WHEN {secret_sql} THEN '[REDACTED]' WHEN regexp_matches(replace(trim(text, ' '), '\\', '/'), '^(?:[A-Za-z]:/|/|~/)') THEN '[PATH_REDACTED]' " \
        "ELSE text END"
    reg.add(
        "masked_documents",
        lambda spark, d: inputs.read(spark, d, "documents").select("doc_id", P.mask_text(F.col("text")).alias("text")),
        f"SELECT doc_id, {masked_sql} AS text FROM documents",
    )
    reg.add(
        "masked_conversations",
        lambda spark, d: inputs.read(spark, d, "conversations").select("conv_id", "turn", P.mask_text(F.col("text"), kind="content").alias("text")),
        f"SELECT conv_id, turn, CASE WHEN {secret_sql} THEN '[REDACTED]' ELSE '[CONTENT_REDACTED]' END AS text FROM conversations",
    )
    reg.add(
        "hashed_documents",
        lambda spark, d: inputs.read(spark, d, "documents").select("doc_id", P.mask_text(F.col("text"), P.Policy(hash_values=True), kind="secret").alias("text")),
        "SELECT doc_id, concat('redacted:sha256:', sha256(text)) AS text FROM documents",
    )
    reg.add(
        "clean_page_urls",
        lambda spark, d: inputs.read(spark, d, "pages").select("page_id", P.clean_remote(F.concat(F.lit("HTTPS://me:pw@"), F.substring_index("url", "//", -1))).alias("url")),
        "SELECT page_id, concat('https://', lower(regexp_extract(url, '//([^/?#]*)', 1)), rtrim(regexp_extract(url, '//[^/?#]*([^?#]*)', 1), '/')) AS url FROM pages",
    )
    reg.add(
        "pseudonymous_sources",
        lambda spark, d: inputs.read(spark, d, "documents").select(
            "doc_id", P.pseudonym_if_path(F.concat(F.when(F.col("lang") == "en", "~/Docs\\").otherwise(""), F.col("source")), "worktree").alias("place")),
        "SELECT doc_id, CASE WHEN lang = 'en' THEN concat('worktree_sha256:', sha256(lower(concat('~/docs/', source)))) ELSE source END AS place FROM documents",
    )
    keys = ("prompt", "my.promptText", "API-Key", "x.accessToken", "userEmail", "file_path", "cwd", "lane", "model", "request_body", "private_note", "tests")
    classes = ("content", "content", "secret", "secret", "secret", "ordinary", "path", "ordinary", "ordinary", "content", "secret", "content")
    markers = {"content": "'[CONTENT_REDACTED]'", "secret": "'[REDACTED]'", "path": "'[PATH_REDACTED]'", "ordinary": "lane"}
    def pairs() -> Column:
        return F.create_map(*[x for k in keys for x in (F.lit(k), F.col("lane"))])

    reg.add(
        "masked_maps",
        ev(lambda e: e.select("arrival_seq", F.explode(P.mask_map(pairs())).alias("name", "value"))),
        f"{W} " + " UNION ALL ".join(f"SELECT arrival_seq, '{k}' AS name, {markers[c]} AS value FROM ev" for k, c in zip(keys, classes)),
    )
