"""Redaction of envelope rows before digest and write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import privacy as P
from ..schema import FLAG_FIELDS, NUMBER_FIELDS, SECTIONS, TEXT_FIELDS, flat_columns

# Keys that provenance maps use: a section, or one of its fields.
_USUAL_KEYS = (*SECTIONS, *[f"{s}.{n}" for group in (TEXT_FIELDS, NUMBER_FIELDS, FLAG_FIELDS) for s, names in group.items() for n in names])
_PROJECT_PATHS = {"project_id": "project", "worktree": "worktree"}


def _masked(section: str, name: str, policy: P.Policy) -> Column:
    value = F.col(f"{section}.{name}")
    if section == "project":
        if name == "root":
            return F.when(F.lit(policy.keep_paths), P.mask_text(value, policy, "path"))
        if name == "remote":
            return P.clean_remote(P.mask_text(value, policy))
        if name in _PROJECT_PATHS:
            kept = P.mask_text(value, policy, path_check=False)
            return P.pseudonym_if_path(kept, _PROJECT_PATHS[name])
    if (section, name) == ("provenance", "content_capture"):
        return F.lit("enabled" if policy.content_capture else "disabled")
    return P.mask_text(value, policy)


def redact(events: DataFrame, policy: P.Policy = P.Policy(), bags: bool = True) -> DataFrame:
    """Mask every text of the envelope. ``bags`` says whether the open maps may hold anything."""
    columns: dict[str, Column] = {
        name: P.mask_text(F.col(name), policy) for name in ("schema_version", "event_type")
    } | {"event_id": P.safe_id(F.col("event_id"))}
    for section in SECTIONS:
        parts = [_masked(section, n, policy).alias(n) for n in TEXT_FIELDS.get(section, ())]
        parts += [F.col(f"{section}.{n}").alias(n) for n in NUMBER_FIELDS.get(section, ())]
        parts += [F.col(f"{section}.{n}").alias(n) for n in FLAG_FIELDS.get(section, ())]
        if section == "behavior":
            parts.append(P.mask_list(F.col("behavior.tool_names"), policy).alias("tool_names"))
        if section == "provenance":
            parts.append(P.mask_map(F.col("provenance.fields"), policy, _USUAL_KEYS + ("execution.session",)).alias("fields"))
        columns[section] = F.struct(*parts)
    if bags:
        columns["attributes"] = P.redact_bag(F.col("attributes"), policy)
        columns["extensions"] = P.redact_bag(F.col("extensions"), policy)
    # A generator of one row: masking reads a text several times, which must not compute it as often.
    once = events.select(F.inline(F.array(F.struct(*events.columns))))
    return once.withColumns(columns)


def _utc_text(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(name)


def canonical_payload(with_receipt: bool = True) -> Column:
    """Envelope as JSON text: keys sorted at every level, nulls kept."""
    parts: dict[str, Column] = {
        n: F.col(n) for n in ("schema_version", "event_id", "event_type")
    }
    parts["observed_at"] = _utc_text("observed_at")
    if with_receipt:
        parts["received_at"] = _utc_text("received_at")
    for section in SECTIONS:
        names = [
            *TEXT_FIELDS.get(section, ()), *NUMBER_FIELDS.get(section, ()), *FLAG_FIELDS.get(section, ()),
        ]
        inner = {n: F.col(f"{section}.{n}") for n in names}
        if section == "behavior":
            inner["tool_names"] = F.col("behavior.tool_names")
        if section == "provenance":
            entries = F.sort_array(F.map_entries(F.col("provenance.fields")))
            inner["fields"] = F.map_from_entries(entries)
        parts[section] = F.struct(*[inner[n].alias(n) for n in sorted(inner)])
    for bag in ("attributes", "extensions"):
        parts[bag] = F.parse_json(F.col(bag))
    ordered = [parts[n].alias(n) for n in sorted(parts)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def with_digest(events: DataFrame) -> DataFrame:
    """Adds ``payload_digest``: SHA-256 of the canonical payload without the receipt time."""
    return events.withColumn("payload_digest", F.sha2(canonical_payload(with_receipt=False), 256))


def flatten(events: DataFrame, *carry: str) -> DataFrame:
    """Flat event rows with their provenance map; ``carry`` keeps further columns."""
    return events.select(
        *[F.col(path).alias(name) for name, path in flat_columns()],
        F.col("provenance.fields").alias("provenance_fields"),
        *carry,
    )
