"""Completed provider or gateway responses as envelope rows.

Input columns: provider, client, route, auth_mode, usage_source, observed_at (timestamp),
latency_ms, duration_ms, response_json.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import privacy as P
from ..functions import variants as V
from ..functions.identity import struct_id
from .otlp import _envelope

# ---- Fixed values: keys of the usage dialects and of the response itself, in order of precedence.
USAGE = {
    "google": {
        "input_tokens": ("promptTokenCount", "prompt_token_count"),
        "output_tokens": ("candidatesTokenCount", "candidates_token_count"),
        "cached_tokens": ("cached_tokens", "cachedTokens"),
        "cache_read_tokens": ("cachedContentTokenCount", "cached_content_token_count"),
        "reasoning_tokens": ("thoughtsTokenCount", "thoughts_token_count"),
        "total_tokens": ("totalTokenCount", "total_token_count"),
    },
    "anthropic": {
        "input_tokens": ("input_tokens",), "output_tokens": ("output_tokens",),
        "cached_tokens": ("cached_tokens",),
        "cache_creation_tokens": ("cache_creation_input_tokens",),
        "cache_read_tokens": ("cache_read_input_tokens",), "total_tokens": ("total_tokens",),
    },
    "default": {
        "input_tokens": ("input_tokens", "prompt_tokens"),
        "output_tokens": ("output_tokens", "completion_tokens"),
        "cached_tokens": ("cached_tokens",),
        "cache_read_tokens": ("cache_read_tokens", "cache_read_input_tokens",
                              "prompt_tokens_details/cached_tokens", "input_tokens_details/cached_tokens"),
        "reasoning_tokens": ("reasoning_tokens", "completion_tokens_details/reasoning_tokens",
                             "output_tokens_details/reasoning_tokens"),
        "total_tokens": ("total_tokens",),
    },
}
STATUS_KEYS = ("status_code", "statusCode", "http_status", "httpStatus", "status")
ERROR_STATUS_KEYS = ("status_code", "statusCode", "http_status", "httpStatus", "code")
FAILED_WORDS = ("error", "failed", "failure", "timeout", "timed_out", "rate_limited")
RATE_KINDS = ("rate_limit", "rate_limited", "too_many_requests", "resource_exhausted", "429")
TIMEOUT_KINDS = ("timeout", "timed_out", "deadline_exceeded", "408", "504")
TEXT_KEYS = {
    "execution.parent_event_id": ("parent_event_id", "parentEventId"),
    "execution.session_id": ("session_id", "sessionId"),
    "execution.workflow_id": ("workflow_id", "workflowId"),
    "execution.agent_id": ("agent_id", "agentId"),
    "execution.subagent_id": ("subagent_id", "subagentId"),
    "execution.parent_agent_id": ("parent_agent_id", "parentAgentId", "parent_agent"),
    "execution.role": ("role", "agent_role", "agentRole"),
    "execution.skill": ("skill", "skill_name", "skillName"),
    "execution.lane": ("lane",),
    "execution.trace_id": ("trace_id", "traceId"),
    "execution.task_id": ("task_id", "taskId"),
    "execution.task_class": ("task_class", "taskClass"),
    "llm.model": ("model", "modelVersion", "model_version"),
    "llm.model_family": ("model_family", "modelFamily"),
    "llm.model_variant": ("model_variant", "modelVariant", "variant", "modelVersion", "model_version"),
    "llm.reasoning_effort": ("reasoning_effort", "reasoningEffort"),
}
COUNT_KEYS = {
    "files_inspected_count": ("files_inspected_count", "filesInspectedCount", "files_inspected"),
    "files_changed_count": ("files_changed_count", "filesChangedCount", "files_changed"),
    "commands_executed_count": ("commands_executed_count", "commandsExecutedCount", "commands_executed"),
    "tests_invoked_count": ("tests_invoked_count", "testsInvokedCount", "tests_invoked"),
}
TOOL_TYPES = ("tool_use", "tool_result", "function_call", "function_call_output", "functionresponse", "function_response")
GATEWAY_KEYS = {
    "gateway.target_provider": ("target_provider", "targetProvider", "served_provider", "servedProvider", "provider_name", "providerName"),
    "gateway.served_model": ("served_model", "servedModel", "upstream_model", "upstreamModel"),
}
CORE_KEYS = tuple("""
id responseid response_id model modelversion model_version model_family modelfamily model_variant
modelvariant variant usage usagemetadata cost status status_code error error_kind errorkind rate_limited
ratelimited timeout retry_count retrycount time_to_first_token_ms timetofirsttokenms ttft_ms ttftms
session_id sessionid workflow_id workflowid agent_id agentid subagent_id subagentid parent_agent_id
parentagentid parent_agent role agent_role agentrole skill skill_name skillname lane trace_id traceid
task_id taskid task_class taskclass tool_calls content output candidates provider_attempts
providerattempts target_provider targetprovider served_provider servedprovider provider_name providername
served_model servedmodel upstream_model upstreammodel requested_model requestedmodel
files_inspected_count filesinspectedcount files_inspected files_changed_count fileschangedcount
files_changed commands_executed_count commandsexecutedcount commands_executed tests_invoked_count
testsinvokedcount tests_invoked agent_failure agentfailure reassessment_count reassessmentcount
reassessments rework_count reworkcount rework rework_loops finish_reason finish_reasons stop_reason
request_id requestid auth_mode authmode reasoning_effort reasoningeffort route
""".split())
# ---- end of fixed values


def _walk(doc: Column, path: str) -> Column:
    return V.at(doc, *path.split("/"))


def _number(doc: Column, *paths: str) -> Column:
    return F.coalesce(*[V.strict_number(_walk(doc, p)) for p in paths])


def _flag(doc: Column, *keys: str) -> Column:
    return F.coalesce(*[V.strict_flag(V.at(doc, k)) for k in keys])


def _count(doc: Column, *keys: str) -> Column:
    """First list length or non-negative number."""
    def one(v: Column) -> Column:
        n = V.strict_number(v)
        return F.when(V.is_array(v), F.size(V.items(v)).cast("double")).when(n >= 0, n)

    return F.coalesce(*[one(V.at(doc, k)) for k in keys])


def _text(doc: Column, *keys: str) -> Column:
    return V.clean(V.as_text(F.coalesce(*[V.truthy(V.at(doc, k)) for k in keys])))


def _status_code(doc: Column, keys: tuple[str, ...]) -> Column:
    def one(v: Column) -> Column:
        n = V.strict_number(v)
        digits = F.when(V.kind(v) == "STRING", F.trim(V.as_text(v)))
        return F.coalesce(
            F.when(n == F.floor(n), n.cast("bigint")), F.when(digits.rlike("^[0-9]{1,18}$"), digits.try_cast("bigint")))

    return F.coalesce(*[one(V.at(doc, k)) for k in keys])


def tool_calls(doc: Column) -> Column:
    """Distinct (id, name, type) of tool calls in order; never arguments or results."""
    none = F.array().cast("array<variant>")
    lists = [F.when(V.is_array(V.at(doc, k)), V.items(V.at(doc, k))) for k in ("tool_calls", "content", "output")]
    candidates = F.coalesce(F.when(V.is_array(V.at(doc, "candidates")), V.items(V.at(doc, "candidates"))), none)
    parts = F.flatten(F.transform(candidates, lambda c: F.coalesce(V.items(V.at(c, "content", "parts")), none)))
    items = F.filter(F.concat(*[F.coalesce(x, none) for x in lists], parts), V.is_object)

    def call(item: Column) -> Column:
        kind = F.lower(F.coalesce(V.as_text(V.truthy(V.at(item, "type"))), F.lit("")))
        function = F.coalesce(V.truthy(V.at(item, "functionCall")), V.truthy(V.at(item, "function_call")))
        name = V.as_text(F.coalesce(V.truthy(V.at(item, "function", "name")), V.truthy(V.at(function, "name")), V.given(V.at(item, "name"))))
        call_id = V.as_text(F.coalesce(*[V.truthy(V.at(item, k)) for k in ("id", "tool_call_id", "toolUseId", "call_id")]))
        keep = name.isNotNull() | kind.isin(*TOOL_TYPES)
        unknown = lambda t: F.coalesce(V.clean(t), F.lit("unknown"))
        return F.when(keep, F.struct(
            unknown(call_id).alias("id"), unknown(name).alias("name"),
            F.coalesce(F.nullif(kind, F.lit("")), F.lit("tool_call")).alias("type")))

    return F.array_distinct(F.filter(F.transform(items, call), lambda c: c.isNotNull()))


def _gateway(doc: Column, route: Column) -> list[tuple[str, Column]]:
    given = [(name, _text(doc, *keys)) for name, keys in GATEWAY_KEYS.items()]
    any_given = V.any_of(*[c.isNotNull() for _, c in given])
    requested = F.when((route == "openrouter") | any_given, _text(doc, "requested_model", "requestedModel", "model"))
    tries = F.coalesce(V.truthy(V.at(doc, "provider_attempts")), V.truthy(V.at(doc, "providerAttempts")))
    unknown = lambda d, *keys: F.coalesce(_text(d, *keys), F.lit("unknown"))
    listed = F.transform(F.filter(V.items(tries), V.is_object), lambda t: F.struct(
        unknown(t, "model", "model_name", "modelName").alias("model"),
        unknown(t, "provider", "provider_name", "providerName").alias("provider"),
        unknown(t, "status", "status_code", "statusCode").alias("status")))
    return [*[(n, c.cast("variant")) for n, c in given], ("gateway.requested_model", requested.cast("variant")),
            ("gateway.provider_attempts", F.when(F.size(listed) > 0, F.to_variant_object(listed)))]


def unknown_keys(doc: Column) -> Column:
    """Unlisted keys; nested values are masked with the other bags."""
    return F.map_filter(V.entries(doc), lambda k, v: ~F.replace(F.lower(k), F.lit("-"), F.lit("_")).isin(*CORE_KEYS))


def events_from_responses(rows: DataFrame, *carry: str) -> DataFrame:
    """One event per response row; a ``project_id`` column, where there is one, is part of the id."""
    c = F.col
    rows = rows.withColumn("doc", V.parse(c("response_json")))
    doc = c("doc")
    usage = F.coalesce(V.truthy(V.at(doc, "usage")), V.truthy(V.at(doc, "usageMetadata")))
    raw_error = V.given(V.at(doc, "error"))
    rows = rows.withColumns({
        "usage": usage, "error": F.when(V.is_object(raw_error), raw_error),
        "has_error": F.when(V.is_object(raw_error), F.size(V.entries(raw_error)) > 0).otherwise(raw_error.isNotNull()),
        "calls": tool_calls(doc),
    })
    u = c("usage")
    dialect = lambda field: (
        F.when(c("provider") == "google", _number(u, *USAGE["google"][field]) if field in USAGE["google"] else F.lit(None))
        .when(c("provider") == "anthropic", _number(u, *USAGE["anthropic"][field]) if field in USAGE["anthropic"] else F.lit(None))
        .otherwise(_number(u, *USAGE["default"][field]) if field in USAGE["default"] else F.lit(None)).cast("double"))
    fields = ("input_tokens", "output_tokens", "cached_tokens", "cache_creation_tokens", "cache_read_tokens", "reasoning_tokens")
    rows = rows.withColumns({
        **{f"u_{f}": dialect(f) for f in fields}, "reported_total": dialect("total_tokens"),
        "u_cost": F.coalesce(_number(u, "cost"), _number(doc, "cost")),
        "code": F.coalesce(_status_code(doc, STATUS_KEYS), _status_code(c("error"), ERROR_STATUS_KEYS)),
        "said_rate": _flag(doc, "rate_limited", "rateLimited"), "said_timeout": _flag(doc, "timeout", "timed_out", "timedOut"),
        "tool_failure": _flag(doc, "tool_failure", "toolFailure"),
        "agent_failure": _flag(doc, "agent_failure", "agentFailure", "agent_failed"),
        "aborted": _flag(doc, "aborted", "cancelled", "canceled"),
        "status_word": F.lower(V.as_text(V.given(V.at(doc, "status")))),
        "said_kind": F.coalesce(_text(c("error"), "type", "code"),
                                F.when(c("has_error") & c("error").isNull(), "provider_error"), _text(doc, "error_kind", "errorKind")),
    })
    plain = F.replace(F.replace(F.lower("said_kind"), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    rows = rows.withColumns({
        "u_total": F.coalesce(c("reported_total"), c("u_input_tokens") + c("u_output_tokens")),
        "kind": F.when(plain.isin(*RATE_KINDS), "rate_limited").when(plain.isin(*TIMEOUT_KINDS), "timeout").otherwise(c("said_kind")),
        "failed": V.any_of(*[F.coalesce(t, F.lit(False)) for t in (
            c("has_error"), c("status_word").isin(*FAILED_WORDS), c("code") >= 400, c("agent_failure"), c("tool_failure"), c("aborted"))]),
    })
    rate = F.coalesce(c("said_rate"), F.when((c("code") == 429) | (c("kind") == "rate_limited"), True))
    late = F.coalesce(c("said_timeout"), F.when(c("code").isin(408, 504) | (c("kind") == "timeout"), True))
    rows = rows.withColumns({"rate": rate, "late": late})
    kind = F.coalesce(c("kind"), F.when(c("rate"), "rate_limited").when(c("late"), "timeout").when(c("failed"), "provider_error"))
    usage_names = [*fields, "total", "cost"]
    any_usage = F.coalesce(*[c(f"u_{f}") for f in usage_names]).isNotNull()
    evidence = F.when(any_usage, F.coalesce(c("usage_source"), F.lit("unknown"))).otherwise("unknown")
    response_id = F.coalesce(*[V.truthy(V.at(doc, k)) for k in ("id", "responseId", "response_id")])
    source = F.concat(F.lit("response:"), c("client"))
    texts = {path: _text(doc, *keys) for path, keys in TEXT_KEYS.items()}
    ttft = _number(doc, "time_to_first_token_ms", "timeToFirstTokenMs", "ttft_ms", "ttftMs")
    retry = _number(doc, "retry_count", "retryCount", "retries")
    reassess = _count(doc, "reassessment_count", "reassessmentCount", "reassessments")
    rework = _count(doc, "rework_count", "reworkCount", "rework_loops", "rework")
    scope = {"client": c("client"), "provider": c("provider"), "route": c("route")}
    if "project_id" in rows.columns:
        scope["project"] = c("project_id")
    full_id = struct_id(**scope, **{k.replace(".", "_"): v for k, v in texts.items()}, observed=c("observed_at"), failed=c("failed"),
                        code=c("code"), kind=kind, request=_text(doc, "request_id", "requestId"))
    short_id = struct_id(**scope, response=V.strict_text(response_id))
    called = F.size("calls") > 0
    counts = {n: _first_count(doc, *keys) for n, keys in COUNT_KEYS.items()}
    behaved = V.any_of(called, *[x.isNotNull() for x in counts.values()])
    passed = [(f"provider.{k}", V.at(doc, k)) for k in ("finish_reason", "finish_reasons", "stop_reason", "request_id")]
    bag = {
        **dict(_gateway(doc, c("route"))), "response_id": response_id, **dict(passed),
        "tool_calls": F.when(called, F.to_variant_object(c("calls"))), "tool_call_count": F.when(called, F.size("calls")).cast("variant"),
        "provider.status_code": c("code").cast("variant"),
        "error.type": F.when(c("has_error"), F.coalesce(_text(c("error"), "type"), F.lit("provider_error"))).cast("variant"),
        "error.message": F.when(c("has_error"), "provider request failed").cast("variant"),
    }
    attributes = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in bag]), F.array(*bag.values())), lambda k, v: v.isNotNull())
    strange = unknown_keys(doc)
    derived = lambda said, got: F.when(said.isNotNull(), "reported").when(got, "derived").otherwise("unknown")
    seen = lambda x, how: F.when(x.isNotNull(), how).otherwise("unknown")
    stated = {
        "llm.model": F.lit("provider"), "llm.model_variant": seen(texts["llm.model_variant"], "provider"), "usage": evidence,
        "usage.total_tokens": F.when(c("reported_total").isNotNull(), c("usage_source")).when(c("u_total").isNotNull(), "derived").otherwise("unknown"),
        "performance.latency_ms": seen(c("latency_ms"), "observed"), "performance.time_to_first_token_ms": seen(ttft, "reported"),
        "performance.duration_ms": seen(c("duration_ms"), "observed"), "reliability.error_kind": derived(c("kind"), kind.isNotNull()),
        "reliability.retry_count": seen(retry, "reported"), "reliability.rate_limited": derived(c("said_rate"), c("rate")),
        "reliability.timeout": derived(c("said_timeout"), c("late")), "reliability.agent_failure": seen(c("agent_failure"), "reported"),
        "reliability.reassessment_count": seen(reassess, "reported"), "reliability.rework_count": seen(rework, "reported"),
        "behavior": F.when(behaved, "derived").otherwise("unknown"),
    }
    values = {
        "event_id": F.when(V.strict_text(response_id).isNotNull(), short_id).otherwise(full_id),
        "event_type": F.lit("model.operation"), "observed_at": c("observed_at"),
        "source.kind": F.lit("adapter"), "source.name": source, **texts,
        "llm.provider": c("provider"), "llm.client": c("client"), "llm.auth_mode": c("auth_mode"), "llm.route": F.coalesce(c("route"), F.lit("direct")),
        **{f"usage.{f}": c(f"u_{f}") for f in fields}, "usage.total_tokens": c("u_total"), "usage.cost": c("u_cost"), "usage.source": evidence,
        "performance.latency_ms": c("latency_ms"), "performance.duration_ms": c("duration_ms"), "performance.time_to_first_token_ms": ttft,
        "reliability.status": F.when(c("failed"), "failed").otherwise("succeeded"), "reliability.error_kind": kind,
        "reliability.retry_count": retry, "reliability.rate_limited": c("rate"), "reliability.timeout": c("late"),
        "reliability.tool_failure": c("tool_failure"), "reliability.agent_failure": c("agent_failure"), "reliability.aborted": c("aborted"),
        "reliability.reassessment_count": reassess, "reliability.rework_count": rework,
        "behavior.tool_call_count": F.when(called, F.size("calls")).cast("double"),
        "behavior.tool_names": F.when(called, F.array_distinct(F.transform("calls", lambda x: x["name"]))),
        **{f"behavior.{n}": v for n, v in counts.items()},
        "provenance.adapter": source, "provenance.semantic_conventions": F.lit("provider.response/v1"), "provenance.content_capture": F.lit("disabled"),
        "provenance.fields": F.create_map(*[x for k, v in stated.items() for x in (F.lit(k), v)]),
        "attributes": F.to_json(F.to_variant_object(attributes)),
        "extensions": F.when(F.size(strange) > 0, F.to_json(F.to_variant_object(F.create_map(F.lit("provider"), F.to_variant_object(strange))))),
    }
    if "project_id" in rows.columns:
        values["project.project_id"] = c("project_id")
    return _envelope(rows, values, [F.when(~F.coalesce(V.is_object(doc), F.lit(False)), "provider response must be an object")], carry)


def _first_count(doc: Column, *keys: str) -> Column:
    """Of the first given key only: its list length or non-negative number."""
    v = F.coalesce(*[V.given(V.at(doc, k)) for k in keys])
    n = V.strict_number(v)
    return F.when(V.is_array(v), F.size(V.items(v)).cast("double")).when(n >= 0, n)
