"""Attribute policy, applied before anything else sees the attributes.

Order: project id first (it needs paths), then the allow-list, stamps and delete lists. The functions of one map take text maps;
``police`` takes whole OTLP payloads and treats every level: resources, records, span events, log bodies and metric points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import variants as V
from .otlp import ATTRIBUTES, SCHEMAS

# ---- Fixed values. ``~x`` is the exporter's private attribute x.
DIRECTORY_KEYS = (
    "~project.root", "~project.path", "process.cwd", "process.working_directory", "cwd",
    "current_working_directory", "~cwd", "~repository.root", "~worktree.path",
)
ALLOWED = tuple("""
service.name service.version gen_ai.request.type gen_ai.request.effort gen_ai.response.finish_reasons
gen_ai.provider.name gen_ai.system gen_ai.request.model gen_ai.response.model gen_ai.request.model.version
gen_ai.response.model.version gen_ai.model.version gen_ai.operation.name gen_ai.tool.name gen_ai.tool.type
gen_ai.conversation.id gen_ai.usage.input_tokens gen_ai.usage.output_tokens
gen_ai.usage.cache_read.input_tokens gen_ai.usage.cache_creation.input_tokens gen_ai.usage.reasoning_tokens
gen_ai.usage.total_tokens gen_ai.usage.cost gen_ai.client.latency_ms gen_ai.client.operation.duration
gen_ai.time_to_first_token_ms session.id event.name event.sequence model provider client session_id
workflow_id input_tokens output_tokens cache_read_tokens cache_creation_tokens cost_usd cost_usd_micros
duration_ms ttft_ms success status_code attempt query_source agent_id parent_agent_id workflow.run_id
error.type error.kind error.code ~evidence.source ~acceptance.run_id ~project.id ~project.repository
~project.branch ~project.commit ~provider ~client ~model.family ~model.variant ~operation.kind ~auth.mode
~route.kind ~session.id ~workflow.id ~agent.id ~subagent.id ~parent.agent.id ~role ~skill ~lane ~task.id
~task.class ~context.size ~context.utilization ~compaction.count ~latency_ms ~time_to_first_token_ms
~duration_ms ~tool.duration_ms ~session.duration_ms ~agent.duration_ms ~workflow.duration_ms
~wall_clock_ms ~concurrency ~parallel_utilization ~retry.count ~agent.failure ~aborted
~reassessment.count ~rework.count ~tool.failure ~error.kind ~rate_limited ~extensions ~tool.call.count
~tool.name ~tool.names ~files.inspected.count ~files.changed.count ~commands.executed.count
~tests.invoked.count
""".split())
BLOCKED_KEYS = (
    r"(?i)(^|.*[._-])(api[_-]?key|access[_-]?(key|key[_-]?id|token)|secret[_-]?access[_-]?key|subscription[_-]?key"
    r"|security[_-]?token|refresh[_-]?token|session[_-]?token|id[_-]?token|authorization|auth[._-]?(token|header|value)"
    r"|secret|password|private[_-]?key|credentials?|bearer|prompt(s)?|completion(s)?|completion[_-]?text"
    r"|response[_-]?text|generated[_-]?text|input[._-]?(text|messages?)|output[._-]?(text|messages?)"
    r"|tool[._-]?(call[._-]?)?(arguments?|input|output|result)|content|request[._-]?body|response[._-]?body"
    r"|raw[._-]?(prompt|completion|body))([._-]|$)",
    r"(?i)(auth[_-]?token|client[_-]?secret|prompt[_-]?text|tool[_-]?arguments?|.*sensitive.*|.*private.*)",
    r"(?i)(^|.*[._-])(process[._-]?(environment|env)|user[._-]?(email|id|name)|environment|email)([._-]|$)",
)
BLOCKED_VALUES = (
    r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]{4,}",
    r"(?i)\b(sk|xai|gsk)-[A-Za-z0-9_-]{8,}",
    r"(?i)\bAIza[A-Za-z0-9_-]{16,}",
    r"\b(AKIA|ASIA)[0-9A-Z]{16}\b",
    r"(?i)(api[_-]?key|access[_-]?key([_-]?id)?|secret[_-]?access[_-]?key|subscription[_-]?key|token|password)\s*[=:]\s*[A-Za-z0-9._~+/=-]{8,}",
)
VALUE_MASK = "****"
DELETED = tuple("""
gen_ai.prompt gen_ai.completion gen_ai.input.messages gen_ai.output.messages gen_ai.tool.call.arguments
gen_ai.tool.call.result gen_ai.request.body gen_ai.response.body ~raw_api_body ~prompt ~completion
authorization api_key api_token access_token session_token private_key ~project.root ~project.path
~project.remote ~cwd ~repository.root ~worktree.path process.cwd process.working_directory cwd
current_working_directory file.path code.filepath code.file.path process.command_line
process.executable.path error.message
""".split())
DELETED_FROM_RECORDS = (*DELETED, *"""
~content gen_ai.prompt_text gen_ai.input_text gen_ai.output_text gen_ai.tool.input gen_ai.tool.output
~prompt_text ~response_body ~raw_prompt ~raw_completion ~request_body ~input_text ~output_text ~tool_input
~tool_output ~tool_result ~tool_arguments ~body ~response id_token signing_key
""".split())
MASKED_ON_SPAN_EVENTS = tuple("""
gen_ai.prompt gen_ai.completion gen_ai.input.messages gen_ai.output.messages gen_ai.tool.call.arguments
gen_ai.tool.call.result gen_ai.request.body gen_ai.response.body ~raw_api_body
""".split())
STAMPS = {"~telemetry_plane": "out_of_band", "~normalization.version": "1.0"}
BODY_MASK = "[CONTENT_REDACTED]"
# ---- end of fixed values


def _full(names: tuple[str, ...], ns: str) -> list[str]:
    return [f"{ns}.{n[1:]}" if n.startswith("~") else n for n in names]


def with_project_id(resource: Column, ns: str = "telemetry") -> Column:
    """Adds a project id from the first directory key, when none is given. The raw path is hashed."""
    key = f"{ns}.project.id"
    place = F.coalesce(*[F.try_element_at(resource, F.lit(k)) for k in _full(DIRECTORY_KEYS, ns)])
    missing = F.try_element_at(resource, F.lit(key)).isNull() & place.isNotNull()
    added = F.create_map(F.lit(key), F.concat(F.lit("local_sha256:"), F.sha2(place, 256)))
    return F.when(missing, F.map_concat(resource, added)).otherwise(resource)


def allow(bag: Column, ns: str = "telemetry") -> Column:
    """Only allowed keys, none of the blocked patterns, and no secret value in the clear."""
    allowed = _full(ALLOWED, ns)
    kept = F.map_filter(bag, lambda k, v: k.isin(*allowed) & ~k.rlike("|".join(f"(?:{p})" for p in BLOCKED_KEYS)))

    def masked(k: Column, v: Column) -> Column:
        for pattern in BLOCKED_VALUES:
            v = F.regexp_replace(v, pattern, VALUE_MASK)
        return v

    return F.transform_values(kept, masked)


def stamp(resource: Column, ns: str = "telemetry") -> Column:
    names = _full(tuple(STAMPS), ns)
    return F.map_concat(resource, F.create_map(*[x for k, v in zip(names, STAMPS.values()) for x in (F.lit(k), F.lit(v))]))


def drop_private(bag: Column, ns: str = "telemetry", record: bool = False) -> Column:
    """Without the deleted keys of resources, or of records."""
    names = _full(DELETED_FROM_RECORDS if record else DELETED, ns)
    return F.map_filter(bag, lambda k, v: ~k.isin(*names))


def mask_span_event(bag: Column, ns: str = "telemetry") -> Column:
    names = _full(MASKED_ON_SPAN_EVENTS, ns)
    return F.transform_values(bag, lambda k, v: F.when(k.isin(*names), F.lit(BODY_MASK)).otherwise(v))


def mask_body(body: Column) -> Column:
    """Every log body becomes one constant."""
    return F.lit(BODY_MASK)


# ---- whole payloads

_SPAN_EVENT = f"struct<timeUnixNano string,name string,attributes {ATTRIBUTES}>"
_SCHEMAS = {
    "traces": SCHEMAS["traces"].replace("status struct<code string>", f"status struct<code string>,events array<{_SPAN_EVENT}>"),
    "logs": SCHEMAS["logs"].replace("observedTimeUnixNano string", "observedTimeUnixNano string,body struct<stringValue string>"),
    "metrics": SCHEMAS["metrics"],
}
_LEVELS = {
    "traces": ("resourceSpans", "scopeSpans", "spans"),
    "logs": ("resourceLogs", "scopeLogs", "logRecords"),
    "metrics": ("resourceMetrics", "scopeMetrics", "metrics"),
}
_POINTS = ("gauge", "sum", "histogram", "exponentialHistogram")


def _with(attrs: Column, key: str, value: Column, when: Column) -> Column:
    """``attrs`` with one more text attribute where ``when`` holds, of the same type as the others."""
    blank = F.get(F.from_json(F.lit('[{"key":"","value":{}}]'), ATTRIBUTES), F.lit(0))
    made = blank.withField("key", F.lit(key)).withField("value.stringValue", value)
    return F.when(when, F.concat(attrs, F.array(made))).otherwise(attrs)


def _without(attrs: Column, *keys: str) -> Column:
    return F.filter(attrs, lambda a: ~a["key"].isin(*keys))


def _last_text(attrs: Column, key: str) -> Column:
    """Text value of the last attribute of a name."""
    return F.try_element_at(F.filter(attrs, lambda a: a["key"] == key), F.lit(-1))["value"]["stringValue"]


def _allowed(attrs: Column, ns: str) -> Column:
    """Allowed keys outside the blocked patterns, secret values masked."""
    blocked = "|".join(f"(?:{p})" for p in BLOCKED_KEYS)
    kept = F.filter(attrs, lambda a: F.coalesce(a["key"].isin(*_full(ALLOWED, ns)) & ~a["key"].rlike(blocked), F.lit(False)))

    def masked(a: Column) -> Column:
        v = a["value"]["stringValue"]
        for pattern in BLOCKED_VALUES:
            v = F.regexp_replace(v, pattern, VALUE_MASK)
        return F.when(a["value"]["stringValue"].isNotNull(), a.withField("value.stringValue", v)).otherwise(a)

    return F.transform(kept, masked)


def _resource(attrs: Column, ns: str) -> Column:
    """A resource's attributes through the whole policy."""
    project = f"{ns}.project.id"
    place = F.coalesce(*[_last_text(attrs, k) for k in _full(DIRECTORY_KEYS, ns)])
    missing = ~F.exists(attrs, lambda a: F.coalesce(a["key"] == project, F.lit(False))) & place.isNotNull()
    out = _allowed(_with(attrs, project, F.concat(F.lit("local_sha256:"), F.sha2(place, 256)), missing), ns)
    for key, value in zip(_full(tuple(STAMPS), ns), STAMPS.values()):
        out = _with(_without(out, key), key, F.lit(value), F.lit(True))
    return _without(out, *_full(DELETED, ns))


def _record(attrs: Column, ns: str) -> Column:
    return _without(_allowed(attrs, ns), *_full(DELETED_FROM_RECORDS, ns))


def _span_event(attrs: Column, ns: str) -> Column:
    names = _full(MASKED_ON_SPAN_EVENTS, ns)
    return F.transform(_allowed(attrs, ns), lambda a: F.when(a["key"].isin(*names), a.withField("value.stringValue", F.lit(BODY_MASK))).otherwise(a))


def police(payloads: DataFrame, signal: str, payload: str = "payload", ns: str = "telemetry") -> DataFrame:
    """``payloads`` after the policy, as payload text again: the step between receiving OTLP and mapping it.

    Malformed parts stay null, so the mapping rejects them and keeps their siblings; text that is no JSON stays as it was, to be rejected there.
    """
    outer, middle, inner = _LEVELS[signal]
    doc = F.try_variant_get(V.parse(F.col(payload)), "$", f"struct<{_SCHEMAS[signal]}>")

    def record(rec: Column) -> Column:
        if signal == "metrics":
            # Every kind is read from the record as it came, so the expression grows with the kinds only.
            out = rec
            for kind in _POINTS:
                points = F.transform(rec[kind]["dataPoints"], lambda p: p.withField("attributes", _record(p["attributes"], ns)))
                out = out.withField(kind, F.when(rec[kind].isNotNull(), rec[kind].withField("dataPoints", points)))
            return out
        rec = rec.withField("attributes", _record(rec["attributes"], ns))
        if signal == "traces":
            return rec.withField("events", F.transform(rec["events"], lambda e: e.withField("attributes", _span_event(e["attributes"], ns))))
        return rec.withField("body", F.struct(F.lit(BODY_MASK).alias("stringValue")))

    def whole(r: Column) -> Column:
        attrs = F.coalesce(r["resource"]["attributes"], F.from_json(F.lit("[]"), ATTRIBUTES))
        scopes = F.transform(r[middle], lambda sc: sc.withField(inner, F.transform(sc[inner], record)))
        return r.withField("resource", F.struct(_resource(attrs, ns).alias("attributes"))).withField(middle, scopes)

    rows = payloads.withColumn("_doc", doc)
    kept = F.to_json(F.struct(F.transform(F.col(f"_doc.{outer}"), whole).alias(outer)))
    return rows.withColumn(payload, F.when(F.col("_doc").isNotNull(), kept).otherwise(F.col(payload))).drop("_doc")
