"""OTLP/JSON traces, logs and metrics as envelope rows.

A payload is parsed once to a VARIANT and cast to a fixed schema, where an element of a wrong kind becomes NULL
and its siblings stay. Three explodes take it apart; column expressions map the records. A malformed part becomes one
rejected row that says where it stands. Texts, lists and attributes are taken whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import privacy as P
from ..functions import variants as V
from ..functions.identity import struct_id
from ..schema import FLAG_FIELDS, NUMBER_FIELDS, SECTIONS, TEXT_DEFAULTS, TEXT_FIELDS

# ---- Fixed values
KNOWN_SERVICES = {"claude-code": "anthropic", "claude-code-desktop": "anthropic"}
TOOL_KINDS = ("tool", "tool.operation", "tool_call", "tool.call")
TOOL_LOGS = ("tool_result", "tool_decision")
TIMEOUT_WORDS = ("timeout", "timed_out", "deadline_exceeded")
RATE_WORDS = "rate|too_many|resource_exhausted"
BAD_SEVERITY = ("error", "fatal", "critical", "severe")
PUBLIC_ATTRIBUTES = tuple("""
service.name service.version gen_ai.request.type gen_ai.response.finish_reasons gen_ai.provider.name
gen_ai.system gen_ai.request.model gen_ai.response.model gen_ai.request.model.version
gen_ai.response.model.version gen_ai.operation.name gen_ai.tool.name gen_ai.tool.type error.type
error.code event.name model provider client session_id workflow_id input_tokens output_tokens
cache_read_tokens cache_creation_tokens cost_usd cost_usd_micros duration_ms ttft_ms event.sequence
success status_code attempt query_source agent_id parent_agent_id workflow.run_id
""".split())
PRIVATE_ATTRIBUTES = tuple("""
acceptance.run_id evidence.source project.id project.repository project.branch project.commit provider
client model.family model.variant operation.kind auth.mode route.kind session.id workflow.id agent.id
subagent.id parent.agent.id role skill lane task.id task.class context.size context.utilization
compaction.count latency_ms time_to_first_token_ms duration_ms tool.duration_ms session.duration_ms
agent.duration_ms workflow.duration_ms wall_clock_ms concurrency parallel_utilization retry.count
agent.failure aborted reassessment.count rework.count tool.failure tool.call.count tool.name tool.names
extensions error.kind rate_limited files.inspected.count files.changed.count commands.executed.count
tests.invoked.count
""".split())
METRIC_IDENTITY_PUBLIC = tuple("""
gen_ai.provider.name gen_ai.system gen_ai.request.model gen_ai.response.model
gen_ai.request.model.version gen_ai.response.model.version provider model client session_id
workflow.run_id workflow_id agent_id parent_agent_id
""".split())
METRIC_IDENTITY_PRIVATE = tuple("""
project.id project.repository project.branch project.commit provider client model.family model.variant
session.id workflow.id agent.id subagent.id parent.agent.id role skill lane task.id task.class auth.mode
route.kind
""".split())
# ---- end of fixed values

_SCALARS = "stringValue string, intValue string, doubleValue string, boolValue boolean, bytesValue string"
_ANY = (
    f"struct<{_SCALARS}, arrayValue struct<values array<variant>>, "
    "kvlistValue struct<values array<struct<`key` string, value variant>>>>"
).replace(", ", ",")
_PAIRS = "array<struct<key:string,value:variant>>"
# Lists in lists are decoded down to this level; whatever lies deeper is kept as it was sent.
DECODED_LEVELS = 6
_ATTRS = f"array<struct<`key` string,value {_ANY}>>"
_RESOURCE = f"resource struct<attributes {_ATTRS}>,schemaUrl string"
_SCOPE = "scope struct<name string,version string>"
_POINT = (
    "struct<timeUnixNano string,startTimeUnixNano string,asDouble string,asInt string,value string,"
    f"sum string,`count` string,attributes {_ATTRS}>"
)
_DATA = f"struct<dataPoints array<{_POINT}>>"
SCHEMAS = {
    "traces": (
        f"resourceSpans array<struct<{_RESOURCE},scopeSpans array<struct<{_SCOPE},spans array<struct<"
        "traceId string,spanId string,parentSpanId string,name string,startTimeUnixNano string,"
        f"endTimeUnixNano string,attributes {_ATTRS},status struct<code string>>>>>>>"
    ),
    "logs": (
        f"resourceLogs array<struct<{_RESOURCE},scopeLogs array<struct<{_SCOPE},logRecords array<struct<"
        f"timeUnixNano string,observedTimeUnixNano string,traceId string,spanId string,attributes {_ATTRS}>>>>>>"
    ),
    "metrics": (
        f"resourceMetrics array<struct<{_RESOURCE},scopeMetrics array<struct<{_SCOPE},metrics array<struct<"
        f"name string,unit string,gauge {_DATA},`sum` {_DATA},histogram {_DATA},exponentialHistogram {_DATA}>>>>>>"
    ),
}
ATTRIBUTES = _ATTRS  # type of an encoded attribute list
_MAP = "map<string,variant>"


def _scalar(v: Column) -> Column:
    number = v["doubleValue"].try_cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    return F.coalesce(
        v["stringValue"].cast("variant"), v["intValue"].try_cast("bigint").cast("variant"),
        finite.cast("variant"), v["boolValue"].cast("variant"), v["bytesValue"].cast("variant"),
    )


def _any_value(v: Column, levels: int = DECODED_LEVELS) -> Column:
    """Plain value of an encoded one; a list and a bag share one walk, so the expression grows with the levels only."""
    if levels == 0:
        return _scalar(v)
    listed, bag = v["arrayValue"], v["kvlistValue"]
    keyless = lambda x: F.struct(F.lit(None).cast("string"), x)
    pairs = lambda found: F.coalesce(found.cast(_PAIRS), F.array().cast(_PAIRS))
    members = F.when(listed.isNotNull(), pairs(F.transform(listed["values"], keyless))).when(
        bag.isNotNull(), pairs(F.filter(bag["values"], lambda p: p["key"].isNotNull())))

    def plain(member: Column) -> Column:
        if levels == 1:
            return member["value"]
        typed = F.try_variant_get(member["value"], "$", _ANY)
        return V.bound(typed, lambda t: _any_value(t, levels - 1))

    decoded = F.transform(members, lambda m: F.struct(m["key"], plain(m))).cast(_PAIRS)
    nested = V.bound(decoded, lambda d: F.when(
        listed.isNotNull(), F.transform(d, lambda m: m["value"]).cast("variant")).otherwise(
        F.to_variant_object(F.map_from_entries(d))))
    return F.coalesce(_scalar(v), F.when(members.isNotNull(), nested))


def attribute_map(attrs: Column) -> Column:
    """Attribute list as a map; the last value of a key wins."""
    kept = F.filter(attrs, lambda a: a["key"].isNotNull())
    pairs = F.transform(kept, lambda a: F.struct(a["key"], _any_value(a["value"])))
    return F.coalesce(F.map_from_entries(pairs), F.create_map().cast(_MAP))


@dataclass(frozen=True)
class Keys:
    """Reads attributes of one map column; ``ns`` is the exporter's private prefix."""

    bag: Column
    ns: str = "telemetry"

    def key(self, name: str) -> str:
        """``~x`` is the private attribute x."""
        return f"{self.ns}.{name[1:]}" if name.startswith("~") else name

    def first(self, *names: str) -> Column:
        """First variant that is neither missing nor an empty text."""
        found = [F.try_element_at(self.bag, F.lit(self.key(n))) for n in names]
        return F.coalesce(*[F.when(V.as_text(v) != "", v) for v in found])

    def text(self, *names: str) -> Column:
        return V.as_text(self.first(*names))

    def number(self, *names: str) -> Column:
        """Numbers only; a text is no number."""
        return V.strict_number(self.first(*names))

    def loose(self, *names: str) -> Column:
        """Numbers, or text that spells a finite one."""
        v = self.first(*names)
        spelled = F.when(V.kind(v) == "STRING", F.trim(V.as_text(v)).try_cast("double"))
        return F.coalesce(V.strict_number(v), F.when(~F.isnan(spelled) & (F.abs(spelled) != float("inf")), spelled))

    def flag(self, *names: str) -> Column:
        v = self.first(*names)
        word = F.lower(F.trim(V.as_text(v)))
        return F.when(word.isin("true", "1", "yes", "1.0"), True).when(word.isin("false", "0", "no", "0.0"), False)


def _rate_limited(v: Column) -> Column:
    """429, or a text (or any list item) that speaks of rate limits; never NULL."""
    def one(item: Column) -> Column:
        text = F.lower(V.as_text(item))
        digits = text.rlike("^[0-9]+$")
        number = V.is_number(V.kind(item)) | digits
        return F.coalesce(
            F.when(V.kind(item) == "BOOLEAN", V.as_flag(item))
            .when(number, F.floor(V.as_double(item)) == 429)
            .otherwise(text.rlike(RATE_WORDS)), F.lit(False))

    return F.coalesce(F.when(V.is_array(v), F.exists(V.items(v), one)).otherwise(one(v)), F.lit(False))


def nanos_to_timestamp(nanos: Column) -> Column:
    return F.timestamp_micros(F.floor(nanos.try_cast("decimal(20,0)") / 1000).cast("bigint"))


def _identity(k: Keys, source_name: Column) -> dict[str, Column]:
    """Columns every signal maps the same way."""
    explicit = k.text("gen_ai.provider.name", "gen_ai.system", "~provider", "provider")
    service = F.lower(source_name)
    catalogue = F.lit(None).cast("string")
    for name, provider in KNOWN_SERVICES.items():
        catalogue = F.when(service == name, provider).otherwise(catalogue)
    root = k.text("~project.root", "~project.path")
    root_hash = F.sha2(F.lower(F.replace(root, F.lit("\\"), F.lit("/"))), 256)
    return {
        "llm.provider": F.coalesce(explicit, catalogue, F.lit("unknown")),
        "llm.model": F.coalesce(k.text("gen_ai.response.model", "gen_ai.request.model", "model"), F.lit("unknown")),
        "llm.model_family": k.text("~model.family"),
        "llm.model_variant": k.text("~model.variant", "gen_ai.response.model.version", "gen_ai.request.model.version", "gen_ai.model.version"),
        "llm.client": F.coalesce(k.text("~client", "client"), source_name),
        "llm.auth_mode": k.text("~auth.mode"),
        "llm.route": k.text("~route.kind"),
        "llm.reasoning_effort": k.text("gen_ai.request.effort"),
        "project.project_id": F.coalesce(k.text("~project.id"), F.concat(F.lit("local_sha256:"), root_hash)),
        "project.repository": k.text("~project.repository"),
        "project.root": root,
        "project.remote": P.clean_remote(k.text("~project.remote")),
        "project.branch": k.text("~project.branch"),
        "project.commit": k.text("~project.commit"),
        "project.worktree": F.coalesce(k.text("~project.worktree"), F.concat(F.lit("worktree_sha256:"), root_hash)),
        "execution.session_id": k.text("gen_ai.conversation.id", "~session.id", "session.id", "session_id"),
        "execution.workflow_id": k.text("~workflow.id", "workflow.run_id", "workflow_id"),
        "execution.agent_id": k.text("~agent.id", "agent_id"),
        "execution.subagent_id": k.text("~subagent.id"),
        "execution.parent_agent_id": k.text("~parent.agent.id", "parent_agent_id"),
        "execution.role": k.text("~role"), "execution.skill": k.text("~skill"), "execution.lane": k.text("~lane"),
        "execution.task_id": k.text("~task.id"), "execution.task_class": k.text("~task.class"),
        "usage.source": F.coalesce(k.text("~evidence.source"), F.lit("unknown")),
    }


def _behavior(k: Keys) -> dict[str, Column]:
    names = k.first("~tool.names", "~tool.name", "gen_ai.tool.name")
    listed = F.when(V.is_array(names), F.transform(V.items(names), V.as_text)).otherwise(F.array(V.as_text(names)))
    listed = F.when(names.isNotNull(), listed)
    return {
        "behavior.tool_call_count": F.coalesce(k.loose("~tool.call.count"), F.when(listed.isNotNull(), F.size(listed)).cast("double")),
        "behavior.files_inspected_count": k.loose("~files.inspected.count"),
        "behavior.files_changed_count": k.loose("~files.changed.count"),
        "behavior.commands_executed_count": k.loose("~commands.executed.count"),
        "behavior.tests_invoked_count": k.loose("~tests.invoked.count"),
        "behavior.tool_names": F.array_distinct(listed),
    }


USAGE_KEYS = {
    "input_tokens": ("gen_ai.usage.input_tokens", "input_tokens"),
    "output_tokens": ("gen_ai.usage.output_tokens", "output_tokens"),
    "cached_tokens": ("gen_ai.usage.cached_tokens", "cache_read_tokens"),
    "cache_creation_tokens": ("gen_ai.usage.cache_creation.input_tokens", "cache_creation_tokens"),
    "cache_read_tokens": ("gen_ai.usage.cache_read.input_tokens", "cache_read_tokens"),
    "reasoning_tokens": ("gen_ai.usage.reasoning_tokens",),
    "total_tokens": ("gen_ai.usage.total_tokens",),
    "cost": ("gen_ai.usage.cost", "cost_usd"),
}
SPAN_USAGE_KEYS = {
    "context_size": ("~context.size",), "context_utilization": ("~context.utilization",),
    "compaction_count": ("~compaction.count",),
}
TIMING_KEYS = {
    "tool_duration_ms": ("~tool.duration_ms",), "session_duration_ms": ("~session.duration_ms",),
    "agent_duration_ms": ("~agent.duration_ms",), "workflow_duration_ms": ("~workflow.duration_ms",),
    "wall_clock_ms": ("~wall_clock_ms",), "concurrency": ("~concurrency",),
    "parallel_utilization": ("~parallel_utilization",),
}
LATENCY = ("~latency_ms", "gen_ai.client.latency_ms")
TTFT = ("~time_to_first_token_ms", "gen_ai.time_to_first_token_ms", "ttft_ms")
DURATION = ("~duration_ms", "gen_ai.client.operation.duration", "duration_ms")


def _envelope(rows: DataFrame, values: dict[str, Column], reasons: list[Column], carry: tuple[str, ...]) -> DataFrame:
    """Nested envelope from path -> column; missing paths take their default or NULL."""
    def value(s: str, n: str, type_name: str) -> Column:
        given = values.get(f"{s}.{n}")
        column = F.lit(None).cast(type_name) if given is None else given.cast(type_name)
        if type_name == "string":
            column = V.clean(column)
            if (s, n) in TEXT_DEFAULTS:
                column = F.coalesce(column, F.lit(TEXT_DEFAULTS[s, n]))
        return column

    sections = []
    for s in SECTIONS:
        parts = [value(s, n, "string").alias(n) for n in TEXT_FIELDS.get(s, ())]
        parts += [value(s, n, "double").alias(n) for n in NUMBER_FIELDS.get(s, ())]
        parts += [value(s, n, "boolean").alias(n) for n in FLAG_FIELDS.get(s, ())]
        if s == "behavior":
            names = values.get("behavior.tool_names", F.lit(None).cast("array<string>"))
            parts.append(F.coalesce(names, F.array().cast("array<string>")).alias("tool_names"))
        if s == "provenance":
            parts.append(values["provenance.fields"].alias("fields"))
        sections.append(F.struct(*parts).alias(s))
    bag = lambda name: F.coalesce(values.get(name, F.lit(None).cast("string")), F.lit("{}")).alias(name)
    negative = [
        F.when(values[f"{s}.{n}"] < 0, f"{s}.{n} must be a non-negative number or null")
        for s, names in NUMBER_FIELDS.items() for n in names if f"{s}.{n}" in values
    ]
    reasons = [*reasons, *negative]
    # A generator of one row keeps a later filter on ``reasons`` above it; being below the typing, it leaves unused fields to be pruned.
    # It reads a column made before it: what stands inside a generator this wide is not compiled.
    rows = rows.withColumn("_reasons", V.present(*reasons)).select("*", F.explode(F.array("_reasons")).alias("reasons"))
    return rows.select(
        *carry, F.lit("1.0").alias("schema_version"), values["event_id"].alias("event_id"),
        values["event_type"].alias("event_type"), values["observed_at"].alias("observed_at"),
        F.current_timestamp().alias("received_at"), *sections, bag("attributes"), bag("extensions"), "reasons",
    )


def known_attributes(ns: str) -> list[str]:
    return [*PUBLIC_ATTRIBUTES, *[f"{ns}.{n}" for n in PRIVATE_ATTRIBUTES]]


def safe_attributes(bag: Column, ns: str) -> Column:
    return F.map_filter(bag, lambda k, v: k.isin(*known_attributes(ns)))


def unknown_attributes(bag: Column, ns: str) -> Column:
    """Attributes outside the known set, masked by key and value."""
    rest = F.map_filter(bag, lambda k, v: ~k.isin(*known_attributes(ns)))

    def mask(k: Column, v: Column) -> Column:
        text = V.kind(v) == "STRING"
        return V.bound(P.key_class(k), lambda cls: F.when(
            text, V.bound(V.as_text(v), lambda t: P.mask_by_class(cls, t)).cast("variant")).when(
            cls != "ordinary", P.mask_by_class(cls, F.lit("-")).cast("variant")).otherwise(v))

    return F.transform_values(rest, mask)


def _bags(bag: Column, ns: str, extra: dict[str, Column] | None = None) -> dict[str, Column]:
    unknown = F.when(F.size(F.map_filter(bag, lambda k, v: ~k.isin(*known_attributes(ns)))) > 0,
                     F.to_variant_object(unknown_attributes(bag, ns)))
    client = F.try_element_at(bag, F.lit(f"{ns}.extensions"))
    client = F.when(V.is_object(client), client)
    parts = {"unknown_attributes": unknown, "client": client, **(extra or {})}
    full = F.map_from_arrays(F.array(*[F.lit(k) for k in parts]), F.array(*parts.values()))
    present = F.map_filter(full, lambda k, v: v.isNotNull())
    return {
        "attributes": F.to_json(F.to_variant_object(safe_attributes(bag, ns))),
        "extensions": F.to_json(F.to_variant_object(present)),
    }


def _exploded(payloads: DataFrame, signal: str, names: tuple[str, str, str], carry: tuple[str, ...], payload: str) -> DataFrame:
    """One row per innermost record; a missing or malformed level leaves one row with NULL record and its ``cause``."""
    outer, middle, inner = names
    doc = F.try_variant_get(V.parse(F.col(payload)), "$", f"struct<{SCHEMAS[signal]}>")
    # The digest keeps apart the rejected parts of different payloads.
    rows = payloads.select(*carry, F.sha2(payload, 256).alias("sent"), doc.alias("d"))
    rows = rows.select(*carry, "sent", F.col("d").isNotNull().alias("readable"), F.posexplode_outer(f"d.{outer}").alias("i", "r"))
    rows = rows.select(
        *carry, "sent", "readable", "i", F.col("r").isNotNull().alias("outer_ok"),
        attribute_map(F.col("r.resource.attributes")).alias("resource_attrs"),
        F.col("r.schemaUrl").alias("schema_url"), F.posexplode_outer(f"r.{middle}").alias("j", "s"),
    )
    rows = rows.select(
        *carry, "sent", "readable", "i", "outer_ok", "j", F.col("s").isNotNull().alias("middle_ok"),
        "resource_attrs", "schema_url", F.col("s.scope").alias("scope"),
        F.posexplode_outer(f"s.{inner}").alias("record_index", "rec"),
    )
    c = F.col
    at = [F.concat(F.lit(f"{outer}["), c("i"), F.lit("]"))]
    at.append(F.concat(at[0], F.lit(f".{middle}["), c("j"), F.lit("]")))
    at.append(F.concat(at[1], F.lit(f".{inner}["), c("record_index"), F.lit("]")))
    empty, wrong = " has no records", " must be an object"
    cause = (
        F.when(~c("readable"), "invalid JSON").when(c("i").isNull(), outer + empty)
        .when(~c("outer_ok"), F.concat(at[0], F.lit(wrong))).when(c("j").isNull(), F.concat(at[0], F.lit(f".{middle}{empty}")))
        .when(~c("middle_ok"), F.concat(at[1], F.lit(wrong))).when(c("record_index").isNull(), F.concat(at[1], F.lit(f".{inner}{empty}")))
        .when(c("rec").isNull(), F.concat(at[2], F.lit(wrong)))
    )
    return rows.withColumn("cause", cause).drop("readable", "i", "outer_ok", "j", "middle_ok", "record_index")


def _part_id() -> Column:
    """Id of a rejected part: its payload and its place; NULL for a record."""
    return F.concat(F.lit("malformed:"), F.col("sent"), F.lit(":"), F.col("cause"))


def _part_reason(signal: str) -> Column:
    return F.concat(F.lit(f"malformed {signal} record: "), F.col("cause"))


def _provenance(values: dict[str, Column], stated: dict[str, Column]) -> Column:
    pairs = [x for k, v in stated.items() for x in (F.lit(k), v)]
    return F.create_map(*pairs)


def _seen(c: Column, how: str = "client") -> Column:
    return F.when(c.isNotNull(), how).otherwise("unknown")


def events_from_spans(payloads: DataFrame, *carry: str, payload: str = "payload", ns: str = "telemetry") -> DataFrame:
    return _records(payloads, "traces", carry, payload, ns)


def events_from_logs(payloads: DataFrame, *carry: str, payload: str = "payload", ns: str = "telemetry") -> DataFrame:
    return _records(payloads, "logs", carry, payload, ns)


def _records(payloads: DataFrame, signal: str, carry: tuple[str, ...], payload: str, ns: str) -> DataFrame:
    span = signal == "traces"
    names = ("resourceSpans", "scopeSpans", "spans") if span else ("resourceLogs", "scopeLogs", "logRecords")
    rows = _exploded(payloads, signal, names, carry, payload)
    rows = rows.withColumn("attrs", attribute_map(F.col("rec.attributes")))
    rows = rows.withColumn("bag", F.map_concat("resource_attrs", "attrs"))
    service = V.as_text(F.try_element_at("resource_attrs", F.lit("service.name")))
    rows = rows.withColumn("source_name", F.coalesce(F.nullif(service, F.lit("")), F.nullif(F.col("scope.name"), F.lit("")), F.lit("otlp")))
    k, own = Keys(F.col("bag"), ns), Keys(F.col("attrs"), ns)
    values = _identity(k, F.col("source_name"))

    # Signals that several fields share are computed once, as columns.
    error_keys = ("error.type", "error.code") if span else ("error.type", "error.code", "http.response.status_code", "http.status_code")
    code_keys = ("error.code", "http.response.status_code", "http.status_code")
    rows = rows.withColumns({
        "explicit_kind": k.text("~error.kind", "error.kind", "error.type"),
        "error_type": k.text("error.type"),
        "signal": k.first(*error_keys),
        "code": k.loose(*(code_keys + (("status_code",) if span else ()))),
        "explicit_rate": k.first("~rate_limited"),
        "rate_signal": k.first("gen_ai.response.finish_reasons", "error.type"),
        "agent_failure": k.flag("~agent.failure"), "aborted": k.flag("~aborted"),
        "tool_failure": k.flag("~tool.failure"), "success": k.flag("success"),
        "provider": values["llm.provider"], "model": values["llm.model"],
    })
    if not span:
        plain = k.loose("status_code")
        promoted = F.col("code").isNull() & (plain >= 400)
        rows = rows.withColumns({
            "signal": F.when(promoted & F.col("signal").isNull(), plain.cast("variant")).otherwise(F.col("signal")),
            "code": F.when(promoted, plain).otherwise(F.col("code")),
        })
    c = F.col
    word = F.lower(V.as_text(c("signal")))
    slow = F.coalesce(word.isin(*TIMEOUT_WORDS), F.lit(False)) | F.coalesce(c("code").isin(408, 504), F.lit(False))
    limited = _rate_limited(c("signal")) | F.coalesce(c("code") == 429, F.lit(False))
    rows = rows.withColumns({
        "rate_limited": F.when(c("explicit_rate").isNotNull(), k.flag("~rate_limited"))
        .when(limited, True).when(c("rate_signal").isNotNull(), _rate_limited(c("rate_signal"))),
        "slow": slow,
    })
    fallback_kind = V.as_text(c("signal")) if span else k.text("error.type", "error.code")
    derived = F.when(limited if span else F.coalesce(c("rate_limited"), F.lit(False)), "rate_limited").when(c("slow"), "timeout").otherwise(fallback_kind)
    rows = rows.withColumn("error_kind", F.coalesce("explicit_kind", derived))
    rows = rows.withColumn("timeout", F.when(c("error_kind") == "timeout" if span else c("slow"), True))
    failing = [c("agent_failure"), c("tool_failure"), c("aborted"), c("timeout"), ~c("success"), c("code") >= 400]
    tries = k.loose("attempt")
    retry_count = F.coalesce(k.loose("~retry.count"), F.when(tries.isNotNull(), F.greatest(tries - 1, F.lit(0.0))))
    strict = own.number
    values.update({f"usage.{n}": strict(*keys) for n, keys in USAGE_KEYS.items()})
    values.update({f"performance.{n}": strict(*keys) for n, keys in TIMING_KEYS.items()})
    not_number: list[Column] = []
    if span:
        values.update({f"usage.{n}": strict(*keys) for n, keys in SPAN_USAGE_KEYS.items()})
        # A span passes these values on as they are, so a text in place of a number rejects it.
        for section, table in (("usage", {**USAGE_KEYS, **SPAN_USAGE_KEYS}), ("performance", TIMING_KEYS)):
            for n, keys in table.items():
                raw = own.first(*keys)
                not_number.append(F.when(raw.isNotNull() & values[f"{section}.{n}"].isNull(), f"{section}.{n} must be a non-negative number or null"))
        start, end = c("rec.startTimeUnixNano").try_cast("decimal(20,0)"), c("rec.endTimeUnixNano").try_cast("decimal(20,0)")
        nanos = c("rec.startTimeUnixNano")
        trace, span_id = F.nullif(c("rec.traceId"), F.lit("")), F.nullif(c("rec.spanId"), F.lit(""))
        parent = F.nullif(c("rec.parentSpanId"), F.lit(""))
        name = F.coalesce(F.nullif(c("rec.name"), F.lit("")), F.lit("otel.span"))
        kind = F.lower(F.coalesce(k.text("~operation.kind", "gen_ai.operation.name"), F.lit("")))
        is_tool = kind.isin(*TOOL_KINDS) | F.lower(name).startswith("tool.")
        status = F.upper(F.coalesce(c("rec.status.code"), F.lit("")))
        bad_status = status.isin("2", "ERROR") | status.endswith("_ERROR")
        good_status = status.isin("1", "OK") | status.endswith("_OK")
        failing += [bad_status, c("rate_limited")]
        values.update({
            "event_id": F.coalesce(
                F.concat(F.lit("otel:"), trace, F.lit(":"), span_id),
                struct_id(event_type=F.lit("otel.span"), observed_at=nanos, source=c("source_name"), trace=trace, span=span_id, name=name)),
            "event_type": F.when(is_tool, "tool.operation").when(name.contains("gen_ai") | (c("provider") != "unknown"), "model.operation").otherwise("otel.span"),
            "execution.trace_id": trace, "execution.span_id": span_id,
            "execution.parent_event_id": F.when(trace.isNotNull() & ~parent.startswith("otel:"), F.concat(F.lit("otel:"), trace, F.lit(":"), parent)).otherwise(parent),
            "performance.duration_ms": F.when((end - start).isNotNull(), F.greatest(end - start, F.lit(0)) / 1_000_000).cast("double"),
            "performance.latency_ms": k.loose(*LATENCY), "performance.time_to_first_token_ms": k.loose(*TTFT),
        })
        otherwise_status = F.when(bad_status, "failed").when(good_status, "succeeded").otherwise("unknown")
        schema_default, duration_source = "gen_ai.experimental", "derived"
    else:
        nanos = F.coalesce(F.nullif(F.nullif(c("rec.timeUnixNano"), F.lit("")), F.lit("0")), c("rec.observedTimeUnixNano"))
        kind = F.lower(F.coalesce(k.text("~operation.kind", "gen_ai.operation.name", "event.name"), F.lit("")))
        severity = F.lower(k.text("severity.text"))
        failing += [c("error_kind").isNotNull(), severity.isin(*BAD_SEVERITY)]
        values.update({
            "event_id": struct_id(event_type=F.lit("telemetry.log"), observed_at=nanos, source=c("source_name"),
                                  trace=c("rec.traceId"), span=c("rec.spanId"), provider=c("provider"), model=c("model"),
                                  severity=k.text("severity.text")),
            "event_type": F.when(kind.isin(*TOOL_KINDS, *TOOL_LOGS), "tool.operation").when((c("provider") != "unknown") | (c("model") != "unknown"), "model.operation").otherwise("telemetry.log"),
            "execution.trace_id": c("rec.traceId"), "execution.span_id": c("rec.spanId"),
            "performance.duration_ms": own.number(*DURATION), "performance.latency_ms": own.number(*LATENCY),
            "performance.time_to_first_token_ms": k.number(*TTFT),
        })
        otherwise_status = F.when(c("provider") != "unknown", "succeeded").otherwise("unknown")
        schema_default, duration_source = "otel", "client"
    failed = V.any_of(*[F.coalesce(t, F.lit(False)) for t in failing])
    kind_source = F.when(c("error_kind").isNull(), "unknown").when(c("explicit_kind").isNotNull() | c("error_type").isNotNull(), "client").otherwise("derived")
    rate_source = F.when(c("explicit_rate").isNotNull(), _seen(c("rate_limited"))).when(
        c("rate_limited"), F.when(_rate_limited(c("rate_signal")), "client").otherwise("derived")).otherwise("unknown")
    values.update({
        "observed_at": nanos_to_timestamp(nanos),
        "source.kind": F.lit("native_otel"), "source.name": c("source_name"),
        "source.version": F.coalesce(F.nullif(c("scope.version"), F.lit("")), V.as_text(F.try_element_at("resource_attrs", F.lit("service.version")))),
        "reliability.status": F.when(failed, "failed").otherwise(otherwise_status),
        "reliability.error_kind": c("error_kind"), "reliability.retry_count": retry_count,
        "reliability.rate_limited": c("rate_limited"), "reliability.timeout": c("timeout"),
        "reliability.tool_failure": c("tool_failure"), "reliability.agent_failure": c("agent_failure"),
        "reliability.aborted": c("aborted"),
        "reliability.reassessment_count": k.loose("~reassessment.count"), "reliability.rework_count": k.loose("~rework.count"),
        "provenance.adapter": F.lit("otlp-json"), "provenance.content_capture": F.lit("disabled"),
        "provenance.semantic_conventions": F.coalesce(F.nullif(c("schema_url"), F.lit("")), F.lit(schema_default)),
        **_behavior(k), **_bags(c("bag"), ns),
    })
    stated = {"llm.provider": F.lit("client"), "llm.model": F.lit("client"),
              "llm.model_variant": _seen(values["llm.model_variant"]), "usage": values["usage.source"],
              "performance.duration_ms": _seen(values["performance.duration_ms"], duration_source),
              "reliability.error_kind": kind_source, "reliability.rate_limited": rate_source,
              "reliability.timeout": F.when(c("timeout") & c("signal").isNotNull(), "client").when(c("timeout"), "derived").otherwise("unknown")}
    for path in ("performance.latency_ms", "performance.time_to_first_token_ms", "reliability.retry_count",
                 "reliability.tool_failure", "reliability.agent_failure", "reliability.aborted",
                 "reliability.reassessment_count", "reliability.rework_count", *[f"performance.{n}" for n in TIMING_KEYS]):
        stated[path] = _seen(values[path])
    values["provenance.fields"] = _provenance(values, stated)
    values["event_id"] = F.coalesce(_part_id(), values["event_id"])
    reasons = [
        _part_reason(signal),
        F.when(c("rec").isNotNull() & values["observed_at"].isNull(), "timestamp must be an integer number of nanoseconds"),
        *not_number,
    ]
    return _envelope(rows, values, reasons, carry)


def events_from_metrics(payloads: DataFrame, *carry: str, payload: str = "payload", ns: str = "telemetry") -> DataFrame:
    """One event per metric and attribute context of its points."""
    rows = _exploded(payloads, "metrics", ("resourceMetrics", "scopeMetrics", "metrics"), carry, payload)
    kinds = ("gauge", "sum", "histogram", "exponentialHistogram")
    rows = rows.withColumns({
        "metric_type": F.coalesce(*[F.when(F.col(f"rec.{t}").isNotNull(), t) for t in kinds]),
        "all_points": F.coalesce(*[F.col(f"rec.{t}.dataPoints") for t in kinds]),
    })
    number = lambda p: F.coalesce(*[F.nullif(p[n], F.lit("")) for n in ("asDouble", "asInt", "value", "sum", "count")])
    wrong = F.coalesce(F.exists("all_points", lambda p: p.isNull() | p["timeUnixNano"].try_cast("decimal(20,0)").isNull()
                                | (number(p).isNotNull() & number(p).try_cast("double").isNull())), F.lit(True))
    rows = rows.withColumn("wrong", F.coalesce(wrong | (F.size("all_points") == 0), F.lit(True)))

    def described(p: Column) -> Column:
        attrs = attribute_map(p["attributes"])
        shown = F.map_concat(safe_attributes(attrs, ns), unknown_attributes(attrs, ns))
        return F.struct(
            F.sha2(F.to_json(F.to_variant_object(shown)), 256).alias("context"), p["attributes"].alias("attributes"),
            number(p).try_cast("double").alias("value"), p["timeUnixNano"].alias("time_unix_nano"),
            p["startTimeUnixNano"].alias("start_time_unix_nano"),
        )

    # The points of a metric are in one row already, so they are grouped there, by sorting and cutting into runs: no shuffle.
    # One-element explodes keep each step a column of its own, computed once.
    kept = F.transform(F.when(~F.col("wrong"), F.col("all_points")), described)
    rows = rows.select(
        *carry, "sent", "cause", "resource_attrs", "schema_url", "scope", "metric_type", "wrong",
        F.col("rec.name").alias("name"), F.col("rec.unit").alias("unit"), F.explode(F.array(kept)).alias("described"),
    )
    place = F.array_sort(F.transform("described", lambda p, i: F.struct(p["context"], i))).cast("array<struct<context:string,i:int>>")
    rows = rows.select("*", F.explode(F.array(place)).alias("place"))
    before = lambda i: F.get("place", i - 1)["context"]
    starts = F.array_compact(F.transform("place", lambda o, i: F.when((i == 0) | (o["context"] != before(i)), i)))
    rows = rows.select("*", F.explode(F.array(starts)).alias("starts"))
    runs = F.transform("starts", lambda s, j: F.struct(
        s, F.coalesce(F.get("starts", j + 1), F.size("place")) - s)).cast("array<struct<first:int,n:int>>")
    rows = rows.select("*", F.explode_outer(runs).alias("run"))
    own = F.slice("place", F.col("run.first") + 1, F.col("run.n"))
    rows = rows.select("*", F.explode(F.array(F.transform(own, lambda o: F.get("described", o["i"])))).alias("points"))
    rows = rows.withColumn("context", F.element_at("points", 1)["context"]).drop("described", "place", "starts", "run")
    grouped = rows.withColumn("attrs", attribute_map(F.element_at("points", 1)["attributes"]))
    identity = F.map_filter("attrs", lambda k, v: k.isin(*METRIC_IDENTITY_PUBLIC, *[f"{ns}.{n}" for n in METRIC_IDENTITY_PRIVATE]))
    grouped = grouped.withColumn("bag", F.map_concat("resource_attrs", identity))
    service = V.as_text(F.try_element_at("resource_attrs", F.lit("service.name")))
    grouped = grouped.withColumn("source_name", F.coalesce(F.nullif(service, F.lit("")), F.nullif(F.col("scope.name"), F.lit("")), F.lit("otlp")))
    c, k = F.col, Keys(F.col("bag"), ns)
    values = _identity(k, c("source_name"))
    values["execution.subagent_id"] = k.text("~subagent.id", "subagent_id")
    first = F.element_at("points", 1)
    metric_name = F.coalesce(F.nullif(c("name"), F.lit("")), F.lit("unknown.metric"))
    summary = F.transform("points", lambda p: F.struct(p["value"].alias("value"), p["time_unix_nano"].alias("time_unix_nano"), p["start_time_unix_nano"].alias("start_time_unix_nano")))
    nonneg = lambda x: F.when(x >= 0, x)
    values.update({
        "event_id": struct_id(event_type=F.lit("telemetry.metric"), source=c("source_name"), name=metric_name, type=c("metric_type"),
                              unit=c("unit"), first=first["time_unix_nano"], last=F.element_at("points", -1)["time_unix_nano"],
                              count=F.size("points"), context=c("context"), project=values["project.project_id"], session=values["execution.session_id"], agent=values["execution.agent_id"], model=values["llm.model"]),
        "event_type": F.lit("telemetry.metric"), "observed_at": nanos_to_timestamp(first["time_unix_nano"]),
        "source.kind": F.lit("native_otel"), "source.name": c("source_name"),
        "source.version": F.coalesce(F.nullif(c("scope.version"), F.lit("")), V.as_text(F.try_element_at("resource_attrs", F.lit("service.version")))),
        **{f"usage.{n}": k.number(*USAGE_KEYS[n]) for n in ("input_tokens", "output_tokens", "cache_creation_tokens", "cost")},
        "usage.cached_tokens": k.number("gen_ai.usage.cache_read.input_tokens", "cache_read_tokens"),
        "usage.total_tokens": k.number("gen_ai.usage.total_tokens", "total_tokens"),
        "performance.latency_ms": k.loose(*LATENCY), "performance.time_to_first_token_ms": k.loose(*TTFT),
        "performance.duration_ms": k.loose(*DURATION),
        "reliability.agent_failure": k.flag("~agent.failure"),
        "reliability.reassessment_count": nonneg(k.loose("~reassessment.count")),
        "reliability.rework_count": nonneg(k.loose("~rework.count")),
        "provenance.adapter": F.lit("otlp-json"), "provenance.semantic_conventions": F.coalesce(F.nullif(c("schema_url"), F.lit("")), F.lit("otel")),
        "provenance.fields": F.create_map(F.lit("metric"), F.lit("client"), F.lit("metric.value"), F.lit("client")),
        **_behavior(k),
        "extensions": _bags(c("bag"), ns, {"metric_point_attributes": F.when(
            F.size(F.map_filter("attrs", lambda kk, v: ~kk.isin(*known_attributes(ns)))) > 0,
            F.to_variant_object(unknown_attributes(c("attrs"), ns)))})["extensions"],
        "attributes": F.to_json(F.struct(metric_name.alias("metric.name"), summary.alias("metric.points"), c("metric_type").alias("metric.type"), c("unit").alias("metric.unit"))),
    })
    values["event_id"] = F.coalesce(_part_id(), values["event_id"])
    reasons = [F.when(c("cause").isNotNull(), _part_reason("metrics")).when(c("wrong"), "malformed metric")]
    return _envelope(grouped, values, reasons, carry)
