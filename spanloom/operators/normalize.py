"""From parsed JSON documents to typed envelope rows.

Every field is read once from the VARIANT, checked by its JSON type, and turned into a typed
column; what a row violates is collected in ``reasons``. Narrow per-row work, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import variants as V
from ..functions.identity import hashed_id, safe_identity
from ..schema import FLAG_FIELDS, NUMBER_FIELDS, SECTIONS, TEXT_DEFAULTS, TEXT_FIELDS

# ---- Fixed values: other spellings, in order of precedence, and known keys.
RELIABILITY_ALIASES = {
    "agent_failure": ("agent_failed", "agentFailure"),
    "reassessment_count": ("reassessments", "reassessmentCount"),
    "rework_count": ("rework", "rework_loops", "reworkCount"),
}
COUNT_LISTS = {
    "tool_call_count": "tool_calls",
    "files_inspected_count": "files_inspected",
    "files_changed_count": "files_changed",
    "commands_executed_count": "commands_executed",
    "tests_invoked_count": "tests_invoked",
}
PARENT_AGENT_KEYS = ("parent_agent_id", "parentAgentId", "parent_agent")
TOP_KEYS = (
    "schema_version", "event_id", "event_type", "observed_at", "received_at", *SECTIONS,
    "attributes", "extensions",
)
EXTRA_KNOWN = {
    "execution": PARENT_AGENT_KEYS[1:],
    "reliability": ("reassessments", "reassessmentCount", "rework", "rework_loops", "reworkCount"),
    "behavior": ("tool_names", *COUNT_LISTS.values()),
    "provenance": ("fields",),
}
# ---- end of fixed values

_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})$"


def parse_time(text: Column) -> Column:
    """ISO-8601 with a zone as a timestamp; NULL when it is not one."""
    value = F.btrim(text, F.lit(V.BLANKS))
    plain = F.regexp_replace(F.replace(value, F.lit(","), F.lit(".")), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(value.rlike(_ISO), F.try_to_timestamp(plain))


# A key in the text of a JSON type, at any depth.
_KEY = "(?:OBJECT<|, )"
_RESPELLED = {
    "behavior": tuple(COUNT_LISTS.values()),
    "reliability": tuple(k for names in RELIABILITY_ALIASES.values() for k in names),
}
_HOISTED = (
    "tool_names", *COUNT_LISTS, *COUNT_LISTS.values(), *RELIABILITY_ALIASES, *_RESPELLED["reliability"],
)


def _suspicion(section: str) -> str:
    """Pattern of type texts that need the exact check: no object, or a known key of another type.

    It may also meet an unknown nested key of the same name; the exact check then finds nothing.
    """
    parts = ["^(?!OBJECT|VOID)"]
    for group, allowed in (
        (TEXT_FIELDS, "STRING|VOID"),
        (NUMBER_FIELDS, "BIGINT|DECIMAL|DOUBLE|FLOAT|VOID"),
        (FLAG_FIELDS, "BOOLEAN|VOID"),
    ):
        if section in group:
            parts.append(f"{_KEY}(?:{'|'.join(group[section])}): (?!{allowed})")
    if section == "behavior":
        parts.append(f"{_KEY}tool_names: ")
    if section == "provenance":
        parts.append(f"{_KEY}fields: (?!OBJECT|VOID)")
    return "|".join(parts)


def _plain_type(section: str) -> str:
    """Pattern of whole type texts with known keys of their own types only, in the order of their names, in which they come.

    One pass says that a section needs no other look: nothing to reject, respell or keep as unknown.
    """
    return f"^{_plain_part(section)}$"


def _plain_part(section: str) -> str:
    types = {n: "(?:STRING|VOID)" for n in TEXT_FIELDS.get(section, ())}
    types |= {n: r"(?:BIGINT|DECIMAL\(\d+,\d+\)|DOUBLE|FLOAT|VOID)" for n in NUMBER_FIELDS.get(section, ())}
    types |= {n: "(?:BOOLEAN|VOID)" for n in FLAG_FIELDS.get(section, ())}
    if section == "provenance":
        types["fields"] = "(?:OBJECT<[^<>]*>|VOID)"
    parts = [f"(?:{n}: {types[n]}(?:, |(?=>)))?+" for n in sorted(types)]
    return f"(?:VOID|OBJECT<{''.join(parts)}>)"


# Keys of a document that are texts by themselves.
_HEAD = ("schema_version", "event_id", "event_type", "observed_at", "received_at")


def _plain_document() -> str:
    """Pattern of the type texts of whole documents that need no look at their parts.

    Known keys of their own types only, the source without nulls (a default may stand for a missing key), and bags of scalars
    under plain names that are not hoisted.
    """
    types = dict.fromkeys(_HEAD, "STRING") | {s: _plain_part(s) for s in SECTIONS}
    types["source"] = types["source"].replace("(?:STRING|VOID)", "STRING")
    scalar = r"(?:STRING|BIGINT|DECIMAL\(\d+,\d+\)|DOUBLE|FLOAT|BOOLEAN|VOID)"
    for bag in ("attributes", "extensions"):
        types[bag] = rf"(?:VOID|OBJECT<(?:(?!(?:{'|'.join(_HOISTED)}): )\w++: {scalar}(?:, |(?=>)))*+>)"
    parts = [f"(?:{k}: {types[k]}(?:, |(?=>$)))?+" for k in sorted(types)]
    return f"^OBJECT<{''.join(parts)}>$"


def _document_type() -> str:
    """All fields of a plain document, for one cast."""
    fields = [f"`{k}` string" for k in _HEAD]
    for s in SECTIONS:
        inner = _cast_type(s)
        if s == "provenance":
            inner = inner[:-1] + (", " if inner[-2] != "<" else "") + "`fields` map<string,string>>"
        fields.append(f"`{s}` {inner}")
    return f"struct<{', '.join([*fields, '`attributes` variant', '`extensions` variant'])}>"


def _cast_type(section: str) -> str:
    fields = [f"`{n}` string" for n in TEXT_FIELDS.get(section, ())]
    fields += [f"`{n}` double" for n in NUMBER_FIELDS.get(section, ())]
    fields += [f"`{n}` boolean" for n in FLAG_FIELDS.get(section, ())]
    return f"struct<{', '.join(fields)}>"


_BLANKS_SQL = r"' \t\n\r\u000c\u000b'"


def _quick_value(section: str, name: str) -> str:
    """SQL of a field taken from the typed cast of its section."""
    field = f"_v_{section}.`{name}`"
    if name not in TEXT_FIELDS.get(section, ()):
        return field
    text = f"nullif(btrim({field}, {_BLANKS_SQL}), '')"
    default = TEXT_DEFAULTS.get((section, name))
    return text if default is None else f"coalesce({text}, '{default}')"


def _plain_checks(done: tuple[tuple[str, str], ...]) -> str:
    """SQL array with the reason of every field of a wrong type or value, but for ``done``."""
    parts = []
    for group, allowed, reason in (
        (TEXT_FIELDS, "STRING|VOID", "must be a string"),
        (NUMBER_FIELDS, "BIGINT|DECIMAL|DOUBLE|FLOAT|VOID", "must be a non-negative number or null"),
        (FLAG_FIELDS, "BOOLEAN|VOID", "must be boolean or null"),
    ):
        for section, names in group.items():
            for name in names:
                if (section, name) in done:
                    continue
                value = f"try_variant_get(_s_{section}, '$.{name}', 'variant')"
                bad = f"schema_of_variant({value}) RLIKE '^(?!{allowed})'"
                if group is NUMBER_FIELDS:
                    number = f"_v_{section}.`{name}`"
                    bad = f"({bad} OR {number} < 0 OR {number} = double('Infinity'))"
                parts.append(f"CASE WHEN {bad} THEN '{section}.{name} {reason}' END")
    return f"array({', '.join(parts)})"


def known_keys(section: str) -> tuple[str, ...]:
    return (
        *TEXT_FIELDS.get(section, ()), *NUMBER_FIELDS.get(section, ()),
        *FLAG_FIELDS.get(section, ()), *EXTRA_KNOWN.get(section, ()),
    )


@dataclass
class _Field:
    """One typed field: its column, and the test that rejects the row."""

    value: Column
    bad: Column
    reason: str


def _text(leaf: Column, path: str, default: str | None) -> _Field:
    t = V.kind(leaf)
    value = F.when(t == "STRING", V.clean(V.as_text(leaf)))
    if default is not None:
        value = F.coalesce(value, F.lit(default))
    return _Field(value, ~t.isin("STRING", "VOID"), f"{path} must be a string")


def _number(leaf: Column, path: str) -> _Field:
    t = V.kind(leaf)
    value = F.when(V.is_number(t), V.as_double(leaf))
    bad = (t != "VOID") & (~V.is_number(t) | F.isnan(value) | (value < 0) | (value == float("inf")))
    return _Field(value, bad, f"{path} must be a non-negative number or null")


def _flag(leaf: Column, path: str) -> _Field:
    t = V.kind(leaf)
    return _Field(
        F.when(t == "BOOLEAN", V.as_flag(leaf)), ~t.isin("BOOLEAN", "VOID"),
        f"{path} must be boolean or null",
    )


def _list_size(leaf: Column) -> Column:
    """A list becomes the variant of its length; anything else stays."""
    return F.when(V.is_array(leaf), F.size(V.items(leaf)).cast("bigint").cast("variant")).otherwise(leaf)


def _counted(primary: Column, *lists: Column) -> Column:
    """The number itself, else the first given alternative with lists counted."""
    return F.coalesce(V.given(primary), *[V.given(_list_size(alternative)) for alternative in lists])


def _tool_names(raw: Column) -> _Field:
    t = V.kind(raw)
    listed = t.startswith("ARRAY")
    entries = F.transform(
        V.items(raw),
        lambda e: V.strict_text(F.when(V.is_object(e), V.at(e, "name")).otherwise(e)),
    )
    bad = ~listed & ~V.is_number(t) | (listed & F.exists(entries, lambda e: e.isNull()))
    value = F.when(listed, F.array_distinct(entries)).otherwise(F.array().cast("array<string>"))
    return _Field(value, bad, "behavior.tool_names must be an array of names or null")


def normalize(
    docs: DataFrame,
    doc: str = "doc",
    *,
    carry: tuple[str, ...] = (),
    defaults: dict[str, str] | None = None,
    source_defaults: dict[str, str] | None = None,
    assign_ids: bool = False,
    received_at: Column | None = None,
) -> DataFrame:
    """Envelope rows plus ``reasons`` (empty when valid) and the ``carry`` columns.

    ``defaults`` fill missing top-level text keys and ``source_defaults`` missing source keys.
    ``assign_ids`` derives an id for documents without one.
    """
    d = F.col(doc)
    fill = {k: V.literal(f'"{v}"') for k, v in (defaults or {}).items()}
    source_fill = {k: V.literal(f'"{v}"') for k, v in (source_defaults or {}).items()}

    # The id of a document without one, from the document itself: what is taken out of it below does not wait for the function that makes it.
    head = lambda k: F.coalesce(V.at(d, k), fill[k]) if k in fill else V.at(d, k)
    stage = docs.select(*carry, d.alias("_doc"))
    if assign_ids:
        whole = V.entries(d)
        filled = {k: head(k) for k in fill}
        if source_fill:
            none = F.create_map().cast("map<string,variant>")
            origin = F.map_concat(
                F.create_map(*[x for k, v in source_fill.items() for x in (F.lit(k), v)]),
                F.coalesce(V.entries(F.when(V.is_object(head("source")), head("source"))), none),
            )
            filled["source"] = V.from_entries(origin)
        if filled:
            whole = F.map_concat(whole, F.create_map(*[x for k, v in filled.items() for x in (F.lit(k), v)]))
        unnamed = V.strict_text(head("event_id")).isNull()
        stage = docs.select(*carry, d.alias("_doc"), safe_identity(F.when(unnamed, F.to_json(V.from_entries(whole)))).alias("_identity"))
        carry = (*carry, "_identity")
    d = F.col("_doc")

    # A plain document is read by one cast of all its fields; all that follows up to the reasons is for the others, and finds nulls in it.
    quick = F.when(V.kind(d).rlike(_plain_document()), F.try_variant_get(d, "$", _document_type()))
    stage = stage.select(*carry, "_doc", quick.alias("_quick"))
    wrong = F.lit(False)
    for s, names in NUMBER_FIELDS.items():
        numbers = [F.col(f"_quick.{s}.{n}") for n in names]
        wrong = wrong | F.coalesce(F.least(*numbers) < 0, F.lit(False)) | F.coalesce(F.greatest(*numbers) == float("inf"), F.lit(False))
    stage = stage.select(*carry, "_doc", "_quick", (F.col("_quick").isNotNull() & ~wrong).alias("_plain"))
    plain = F.col("_plain")

    # Stage 1: one cast takes the document apart into its top-level values.
    outer = ", ".join(f"`{k}` variant" for k in TOP_KEYS)
    stage = stage.select("*", F.when(~plain, F.try_variant_get(d, "$", f"struct<{outer}>")).alias("_top"))
    values = {k: F.col(f"_top.{k}") for k in TOP_KEYS}
    values.update({k: F.when(~plain, F.coalesce(values[k], v)) for k, v in fill.items()})
    if source_fill:
        values["source"] = F.when(V.is_object(values["source"]), values["source"])
    bags = (*SECTIONS, "attributes", "extensions")
    known = sum((F.col(f"_top.{k}").isNotNull().cast("int") for k in TOP_KEYS), F.lit(0))
    stage = stage.select(
        *carry, "_doc", "_quick", "_plain", (plain | F.col("_top").isNotNull()).alias("_object"),
        F.when(plain, F.lit(False)).otherwise(F.coalesce(F.size(V.entries(F.col("_doc"))) > known, F.lit(False))).alias("_stray"),
        *[values[k].alias(f"_{k}" if k not in bags else f"_s_{k}") for k in TOP_KEYS]
    )

    # Stage 2: per section, its JSON types as one text, and all its fields in one typed cast.
    stage = stage.select(
        "*",
        *[V.kind(F.col(f"_s_{s}")).alias(f"_t_{s}") for s in bags],
        *[F.when(plain, _part_of_quick(s)).otherwise(F.try_variant_get(F.col(f"_s_{s}"), "$", _cast_type(s))).alias(f"_v_{s}")
          for s in SECTIONS],
    )
    types = {s: F.col(f"_t_{s}") for s in bags}
    # A section that is not plain may need the patterns below, any other is not looked at again.
    stage = stage.select("*", *[(~F.coalesce(types[s].rlike(_plain_type(s)), F.lit(True))).alias(f"_odd_{s}") for s in bags])
    odd = {s: F.col(f"_odd_{s}") for s in bags}

    # Rows whose counts or flags may come under other spellings, or from the attributes.
    suspect = odd["attributes"] & types["attributes"].rlike(_KEY + f"(?:{'|'.join(_HOISTED)}): ")
    for s in ("behavior", "reliability"):
        suspect = suspect | (odd[s] & types[s].rlike(_KEY + f"(?:{'|'.join(_RESPELLED[s])}): "))
    suspect = suspect | (odd["execution"] & types["execution"].rlike(_KEY + f"(?:{'|'.join(PARENT_AGENT_KEYS[1:])}): "))
    for s in bags:
        suspect = suspect | (odd[s] & types[s].rlike(_suspicion(s)))
    for s, names in NUMBER_FIELDS.items():
        numbers = [F.col(f"_v_{s}.{n}") for n in names]
        suspect = suspect | F.coalesce(F.least(*numbers) < 0, F.lit(False)) | F.coalesce(
            F.greatest(*numbers) == float("inf"), F.lit(False))
    stage = stage.withColumn("_suspect", suspect)

    # The exact per-field reading, evaluated only where a row needs it.
    def leaf(section: str, name: str) -> Column:
        return V.at(F.col(f"_s_{section}"), name)

    def leaf_of(section: str, name: str) -> Column:
        own = leaf(section, name)
        if section == "source" and name in source_fill:
            return F.coalesce(own, source_fill[name])
        if section == "execution" and name == "parent_agent_id":
            return F.coalesce(*[V.truthy(leaf(section, k)) for k in PARENT_AGENT_KEYS])
        if section == "reliability" and name in RELIABILITY_ALIASES:
            other = RELIABILITY_ALIASES[name]
            hoisted = [leaf("attributes", k) for k in (name, *other)]
            if name == "agent_failure":
                return F.coalesce(own, *[leaf(section, k) for k in other], *hoisted)
            return _counted(F.coalesce(own, *hoisted), *[leaf(section, k) for k in other])
        if section == "behavior":
            both = lambda k: F.coalesce(leaf("behavior", k), leaf("attributes", k))
            return _counted(both(name), both(COUNT_LISTS[name]))
        return own

    # Fields with one spelling are checked by one SQL text, the others one by one.
    special = [("execution", "parent_agent_id"), *[("reliability", n) for n in RELIABILITY_ALIASES]]
    special += [("behavior", n) for n in NUMBER_FIELDS["behavior"]]
    if source_fill:
        special += [("source", n) for n in source_defaults]
    fields: dict[tuple[str, str], _Field] = {}
    # What they are read from is looked up once, as columns; their value and their test use it many times.
    either = lambda k: F.coalesce(leaf("behavior", k), leaf("attributes", k))
    found = {f"_leaf_{s}_{n}": F.when(~plain if s == "source" else F.col("_suspect"), leaf_of(s, n)) for s, n in special}
    listed_tools = (odd["behavior"] & types["behavior"].rlike(_KEY + "tool_names: ")) | F.col("_suspect")
    tools_leaf = F.coalesce(V.given(either("tool_names")), V.given(either("tool_calls")))
    stage = stage.withColumns(found | {"_tools": F.when(listed_tools, tools_leaf), "_listed_tools": listed_tools})
    for s, n in special:
        path, value = f"{s}.{n}", F.col(f"_leaf_{s}_{n}")
        if n in TEXT_FIELDS.get(s, ()):
            fields[s, n] = _text(value, path, TEXT_DEFAULTS.get((s, n)))
        elif n in FLAG_FIELDS.get(s, ()):
            fields[s, n] = _flag(value, path)
        else:
            fields[s, n] = _number(value, path)
    tools = _tool_names(F.col("_tools"))

    def head_text(name: str) -> Column:
        own = F.col(f"_quick.{name}")
        if name in fill:
            own = F.coalesce(own, F.lit(defaults[name]))
        return F.when(plain, V.clean(own)).otherwise(V.strict_text(F.col(f"_{name}")))

    stage = stage.withColumns({f"_text_{k}": head_text(k) for k in _HEAD})
    named = F.col("_text_event_id")
    event_id = F.coalesce(named, hashed_id(F.col("_identity"))) if assign_ids else named

    observed = parse_time(F.col("_text_observed_at"))
    received = parse_time(F.col("_text_received_at"))
    dated = F.when(plain, F.col("_quick.received_at").isNotNull()).otherwise(F.col("_received_at").isNotNull())
    arrival = F.current_timestamp() if received_at is None else received_at
    stage = stage.withColumns({"_observed": observed, "_received": received})
    required = [F.when(~F.col("_object"), "event must be an object")]
    for name in ("schema_version", "event_type"):
        required.append(F.when(F.col(f"_text_{name}").isNull(), f"{name} is required"))
    if not assign_ids:
        required.append(F.when(named.isNull(), "event_id is required"))
    required += [
        F.when(F.col("_observed").isNull(), "observed_at must be ISO-8601 with a timezone"),
        F.when(dated & F.col("_received").isNull(), "received_at must be ISO-8601 with a timezone"),
    ]
    checks = [F.when(types[s].rlike("^(?!OBJECT|VOID)"), f"{s} must be an object") for s in bags]
    prov = V.at(F.col("_s_provenance"), "fields")
    checks.append(F.when(V.kind(prov).rlike("^(?!OBJECT|VOID)"), "provenance.fields must be an object"))
    checks += [F.when(f.bad, f.reason) for f in [*fields.values(), tools]]
    plain_checks = F.expr(_plain_checks(tuple(fields)))
    no_reasons = F.array().cast("array<string>")
    # With NULLs for what holds; they are taken out above the generator, as what ``array_compact`` reads is not compiled.
    reasons = F.when(F.col("_suspect"), F.concat(F.array(*required), F.array(*checks), plain_checks)).otherwise(V.present(*required))

    def field_value(s: str, n: str) -> Column:
        if s == "source" and n in source_fill:
            own = V.clean(F.coalesce(F.col(f"_v_source.{n}"), F.lit(source_defaults[n])))
            default = TEXT_DEFAULTS.get((s, n))
            return F.when(plain, own if default is None else F.coalesce(own, F.lit(default))).otherwise(fields[s, n].value)
        quick = F.expr(_quick_value(s, n))
        if (s, n) in fields:
            return F.when(F.col("_suspect"), fields[s, n].value).otherwise(quick)
        return quick

    def section_struct(s: str) -> Column:
        parts = [
            field_value(s, n).alias(n)
            for group in (TEXT_FIELDS, NUMBER_FIELDS, FLAG_FIELDS) for n in group.get(s, ())
        ]
        if s == "behavior":
            parts.append(F.when(F.col("_listed_tools"), tools.value).otherwise(no_reasons).alias("tool_names"))
        if s == "provenance":
            texts = F.when(plain, F.col("_quick.provenance.fields")).otherwise(F.transform_values(V.entries(prov), lambda k, v: V.as_text(v)))
            parts.append(F.coalesce(texts, F.create_map().cast("map<string,string>")).alias("fields"))
        return F.struct(*parts).alias(s)

    typed = [
        F.col("_text_schema_version").alias("schema_version"),
        event_id.alias("event_id"),
        F.col("_text_event_type").alias("event_type"),
        F.col("_observed").alias("observed_at"),
        F.coalesce(F.col("_received"), arrival).alias("received_at"),
        *[section_struct(s) for s in SECTIONS],
        F.when(plain, _plain_bag("attributes")).when(types["attributes"].startswith("OBJECT"), F.to_json(F.col("_s_attributes"))).otherwise("{}")
        .alias("attributes"),
        F.when(plain, _plain_bag("extensions")).otherwise(_extensions()).alias("extensions"),
        reasons.alias("reasons"),
    ]
    carry = tuple(c for c in carry if c != "_identity")
    stage = stage.select(*carry, *typed)
    # A generator of one row: a later filter on ``reasons`` then stays above the typing instead of
    # being pushed below it, which would parse and check every document twice.
    one = F.struct(*[F.col(c) for c in stage.columns if c not in carry])
    return stage.select(*carry, F.inline(F.array(one))).withColumn("reasons", F.array_compact("reasons"))


def _part_of_quick(section: str) -> Column:
    """Fields of a section as ``_cast_type`` has them."""
    part = F.col(f"_quick.{section}")
    names = [n for group in (TEXT_FIELDS, NUMBER_FIELDS, FLAG_FIELDS) for n in group.get(section, ())]
    if section != "provenance":
        return part
    return F.when(part.isNotNull(), F.struct(*[part[n].alias(n) for n in names]))


def _plain_bag(name: str) -> Column:
    bag = F.col(f"_quick.{name}")
    return F.when(bag.isNotNull() & ~F.is_variant_null(bag), F.to_json(bag)).otherwise("{}")


def _extensions() -> Column:
    """Given extensions plus unknown top-level keys and unknown keys of each section."""
    none = F.create_map().cast("map<string,variant>")
    given = F.coalesce(V.entries(F.col("_s_extensions")), none)

    def inside(key: str) -> Column:
        return F.coalesce(V.entries(F.try_element_at(given, F.lit(key))), none)

    def under(key: str, bag: Column) -> Column:
        return F.when(F.size(bag) > 0, F.create_map(F.lit(key), V.from_entries(bag))).otherwise(none)

    def extra(bag: Column, known: tuple[str, ...]) -> Column:
        return F.coalesce(F.map_filter(bag, lambda k, v: ~k.isin(*known)), none)

    stray = F.when(F.col("_stray"), extra(V.entries(F.col("_doc")), TOP_KEYS)).otherwise(none)
    per_section, strange = [], F.lit(False)
    for s in SECTIONS:
        # Only a section whose type text shows another key is looked at key by key.
        odd = F.col(f"_odd_{s}") & F.coalesce(
            F.col(f"_t_{s}").rlike(f"{_KEY}(?!>|(?:{'|'.join(known_keys(s))}): )"), F.lit(False))
        strange = strange | odd
        found = F.when(odd, extra(V.entries(F.col(f"_s_{s}")), known_keys(s))).otherwise(none)
        prior = F.coalesce(V.entries(F.try_element_at(inside("unknown_fields"), F.lit(s))), none)
        merged = F.when(F.size(found) > 0, F.map_concat(prior, found)).otherwise(none)
        per_section.append(under(s, merged))
    fields = F.map_concat(inside("unknown_fields"), *per_section)
    top = F.map_concat(inside("unknown_top_level"), stray)
    full = F.to_json(V.from_entries(F.map_concat(
        given, under("unknown_top_level", top), under("unknown_fields", fields))))
    own = F.when(F.col("_t_extensions").startswith("OBJECT"), F.to_json(F.col("_s_extensions"))).otherwise("{}")
    return F.when(strange | F.col("_stray"), full).otherwise(own)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("reasons") == 0).drop("reasons")


def rejected(rows: DataFrame, *keep: str) -> DataFrame:
    """Rejected rows with their first reason."""
    return rows.where(F.size("reasons") > 0).select(
        *keep, F.element_at("reasons", 1).alias("reason"), "reasons"
    )
