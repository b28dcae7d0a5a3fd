"""Stable ids and digests."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .privacy import canonical

# ---- Fixed values: keys that may enter an id, and words that keep a key out of it.
SECTION_KEYS = frozenset("""
source project execution llm usage performance reliability outcome behavior provenance attributes
metric span log
""".split())
SAFE_KEYS = frozenset("""
schema_version event_type observed_at source kind name version project project_id repository branch
commit worktree execution trace_id span_id parent_event_id session_id workflow_id agent_id subagent_id
parent_agent_id role skill lane task_id task_class llm provider model model_family model_variant client
auth_mode route reasoning_effort usage performance latency_ms duration_ms status status_code error_kind
outcome correlation_id correlation_basis evidence_source provenance behavior tool_call_count tool_names
files_inspected_count files_changed_count commands_executed_count tests_invoked_count agent_failure
reassessment_count rework_count adapter semantic_conventions metric metric_name metric_type span_name
severity request_id response_id id code finish_reason finish_reasons tool_name metric_context_sha256
""".split())
UNSAFE_WORDS = frozenset("""
prompt completion content message body argument result secret password credential authorization cookie
token path root command environment request response raw input output file email user private
""".split())
# ---- end of fixed values

_CAMEL = re.compile("(?<=[a-z0-9])(?=[A-Z])")


def _admits(key: str) -> bool:
    name = _CAMEL.sub("_", key).lower().replace("-", "_").rpartition(".")[2]
    return name in SECTION_KEYS or (name in SAFE_KEYS and UNSAFE_WORDS.isdisjoint(name.split("_")))


def _says_nothing(value) -> bool:
    return value == "" or (isinstance(value, float) and not math.isfinite(value))


def _trimmed(value):
    return value.strip() if isinstance(value, str) else value


def identity_part(root: dict) -> dict:
    """The part of a parsed JSON object that may enter an id, whole at every depth; the receipt time is left out."""
    root = {k: v for k, v in root.items() if k != "received_at"}
    work: list[dict | list] = [root]
    while work:
        box = work.pop()
        if isinstance(box, dict):
            kept = {k: _trimmed(v) for k, v in box.items() if _admits(k)}
            box.clear()
            box.update((k, v) for k, v in kept.items() if not _says_nothing(v))
            inner = box.values()
        else:
            box[:] = [v for v in map(_trimmed, box) if not _says_nothing(v)]
            inner = box
        work += [v for v in inner if isinstance(v, (dict, list))]
    return root


@F.pandas_udf(StringType())
def safe_identity(docs: pd.Series) -> pd.Series:
    """Canonical JSON of the identity part of each JSON object; NULL stays NULL."""
    return docs.map(lambda doc: canonical(identity_part(json.loads(doc))), na_action="ignore")


def hashed_id(identity_json: Column) -> Column:
    return F.concat(F.lit("evt_sha256_"), F.sha2(identity_json, 256))


def struct_id(**parts: Column) -> Column:
    """Id from named columns: the same hash over their sorted JSON, all inside Spark."""
    fields = [parts[name].alias(name) for name in sorted(parts)]
    return hashed_id(F.to_json(F.struct(*fields)))
