"""Outcome correlation: which outcomes and operations belong together.

A pair exists between a later and an earlier event when a value matches:
  claim   later outcome    -> earlier event with the value the outcome names (or its own task)
  task    later operation  -> earlier outcome row of the same task
  stated  later operation  -> earlier outcome row that names one of the operation's values

A popular value would make pairs grow with the square of its rows, so pairs are not stored.
Stored are the *keys* (at most ten rows per event). Per-event numbers of partners come from
running counts over the keys, and the pairs themselves are expanded for requested events only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .filters import first_rows
from .projections import hierarchy_edges, relation_evidence
from .skew import earlier_counts, hot_keys, salted_lookup

# Correlation basis -> column it names.
BASES = {
    "task_id": "task_id",
    "session_id": "session_id",
    "workflow_id": "workflow_id",
    "agent_id": "agent_id",
    "subagent_id": "subagent_id",
    "trace_id": "trace_id",
    "worktree": "worktree",
    "event_id": "event_id",
}
BLOCK_BITS = 20  # a running-count block spans 2^20 arrivals

_SEP = "\x1f"


def _is_outcome() -> Column:
    return F.coalesce("outcome_kind", "outcome_status").isNotNull()


def _is_outcome_row() -> Column:
    return F.coalesce("outcome_kind", "outcome_status", "correlation_id", "correlation_basis").isNotNull()


def _key(*parts: Column) -> Column:
    """One text key, NULL when any part is NULL."""
    present = F.lit(True)
    for part in parts:
        present = present & part.isNotNull()
    return F.when(present, F.concat_ws(_SEP, *parts))


def _claim() -> Column:
    """Key that an outcome looks for among earlier events."""
    basis = F.col("correlation_basis")
    value = F.coalesce("correlation_id", *[
        F.when(basis == b, F.col(c)) for b, c in BASES.items() if b != "event_id"
    ])
    return F.when(basis.isin(*BASES), _key(basis, value)).when(
        basis.isNull(), _key(F.lit("task_id"), F.col("task_id"))
    )


def _stated() -> Column:
    """Key an outcome row names explicitly."""
    basis = F.col("correlation_basis")
    return F.when(basis.isin(*BASES), _key(basis, F.col("correlation_id")))


def _own_keys() -> Column:
    """Keys of all values an event carries."""
    keys = F.array(*[_key(F.lit(b), F.col(c)) for b, c in BASES.items()])
    return F.filter(keys, lambda k: k.isNotNull())


def correlation_keys(events: DataFrame, *order: str) -> DataFrame:
    """Key rows (rule, key, side, event_id, order…); side is 'seeks' or 'offers'.

    In each rule a later row that seeks a key pairs with the earlier rows that offer it. The rule
    'both' holds pairs that 'task' and 'stated' would count twice.
    """
    outcome, row = _is_outcome(), _is_outcome_row()
    task = F.col("task_id")
    entry = lambda rule, side, key: F.struct(
        F.lit(rule).alias("rule"), F.lit(side).alias("side"), key.alias("key")
    )
    many = lambda rule, side, keys: F.transform(keys, lambda k: F.struct(
        F.lit(rule).alias("rule"), F.lit(side).alias("side"), k.alias("key")
    ))
    own, none = _own_keys(), F.array().cast("array<string>")
    with_task = F.when(task.isNotNull(), F.transform(own, lambda k: F.concat_ws(_SEP, task, k))).otherwise(none)
    entries = F.concat(
        F.array(
            entry("claim", "seeks", F.when(outcome, _claim())),
            entry("task", "seeks", F.when(~outcome, task)),
            entry("task", "offers", F.when(row, task)),
            entry("stated", "offers", F.when(row, _stated())),
            entry("both", "offers", F.when(row, _key(task, _stated()))),
        ),
        many("claim", "offers", own),
        many("stated", "seeks", F.when(~outcome, own).otherwise(none)),
        many("both", "seeks", F.when(~outcome, with_task).otherwise(none)),
    )
    rows = events.select("event_id", *order, F.explode(entries).alias("e")).where(F.col("e.key").isNotNull())
    return rows.select("e.rule", "e.key", "e.side", "event_id", *order)


def _paired_keys(keys: DataFrame) -> DataFrame:
    """Key rows whose key is both sought and offered, so that something can pair."""
    full = F.concat_ws(_SEP, "rule", "key").alias("full")
    per_key = keys.groupBy(full).agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("side") == "seeks", True)).alias("seekers"),
    )
    useful = per_key.where((F.col("seekers") > 0) & (F.col("seekers") < F.col("n"))).select(
        "full", F.lit(True).alias("useful")
    )
    rows = salted_lookup(
        keys.withColumn("full", full), useful, "full", hot_keys(per_key, "full"), F.col("event_id")
    )
    return rows.where(F.col("useful")).drop("useful")


def correlation_degrees(events: DataFrame, order: tuple[str, ...] = ("arrival_seq",)) -> DataFrame:
    """Per event with any partner: how many earlier and later events it is correlated with.

    The last order column must be a dense-ish counter; it is cut into blocks of 2^20.
    """
    rows = _paired_keys(correlation_keys(events, *order)).withColumns({
        "seeks": F.when(F.col("side") == "seeks", 1).otherwise(0),
        "offers": F.when(F.col("side") == "offers", 1).otherwise(0),
    })
    block = [*[F.col(c) for c in order[:-1]], F.shiftright(F.col(order[-1]), BLOCK_BITS)]
    # At equal position an event's own 'seeks' row comes first, so it never sees its own offer.
    counted = earlier_counts(rows, ["full"], [*order, "offers"], block, ["seeks", "offers"])
    sign = F.when(F.col("rule") == "both", -1).otherwise(1)
    later = F.col("total_seeks") - F.col("earlier_seeks")
    return (
        counted.groupBy("event_id").agg(
            F.sum(sign * F.when(F.col("side") == "seeks", F.col("earlier_offers")).otherwise(0)).alias("earlier_partners"),
            F.sum(sign * F.when(F.col("side") == "offers", later).otherwise(0)).alias("later_partners"),
        )
        .where((F.col("earlier_partners") > 0) | (F.col("later_partners") > 0))
    )


# An id list up to this size goes along with the plan, and its key rows (about 30 an id, as ids are unique) are broadcast.
# Longer lists and frames are joined, with the same result.
INLINE_IDS = 1000


def _short(event_ids: list[str] | DataFrame) -> bool:
    return not isinstance(event_ids, DataFrame) and len(event_ids) <= INLINE_IDS


def _with_ids(df: DataFrame, column: str, event_ids: list[str] | DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose ``column`` is (left_semi) or is not (left_anti) a requested id."""
    if _short(event_ids):
        test = F.coalesce(F.col(column).isin(*event_ids), F.lit(False))
        return df.where(test if how == "left_semi" else ~test)
    if not isinstance(event_ids, DataFrame):
        event_ids = df.sparkSession.createDataFrame([(i,) for i in event_ids], "event_id string")
    return df.join(event_ids.select(F.col("event_id").alias(column)).distinct(), column, how).select(df.columns)


def correlated_pairs(
    events: DataFrame, event_ids: list[str] | DataFrame, order: tuple[str, ...] = ("arrival_seq",),
) -> DataFrame:
    """(later_id, earlier_id) pairs that involve a requested event, each once. Event ids are unique in ``events``."""
    keys = correlation_keys(events, *order)
    position = F.struct(*order)
    asked = _with_ids(keys, "event_id", event_ids).where(F.col("rule") != "both").select(
        "rule", "key", F.col("side").alias("asked_side"), F.col("event_id").alias("asked_id"),
        position.alias("asked_at"),
    )
    if _short(event_ids):
        asked = F.broadcast(asked)
    met = keys.join(asked, ["rule", "key"]).where(F.col("side") != F.col("asked_side"))
    here, there = position, F.col("asked_at")
    ordered = met.where(F.when(F.col("side") == "seeks", here > there).otherwise(here < there))
    seeks = F.col("side") == "seeks"
    return ordered.select(
        F.when(seeks, F.col("event_id")).otherwise(F.col("asked_id")).alias("later_id"),
        F.when(seeks, F.col("asked_id")).otherwise(F.col("event_id")).alias("earlier_id"),
    ).distinct()


def _evidence() -> list[Column]:
    """Evidence of the edge from the later event, and of the one back to it."""
    execution = F.nullif(F.try_element_at("provenance_fields", F.lit("execution")), F.lit(""))
    return [relation_evidence(F.lit("outcome_correlation")).alias("own_evidence"), F.coalesce(execution, F.lit("unknown")).alias("reverse_evidence")]


def _pair_edges(pairs: DataFrame, *carry: str) -> DataFrame:
    """Both edges of each (later_id, earlier_id) with the later event's times and evidence."""
    end = lambda child, parent, ev: F.struct(F.col(child).alias("child"), F.col(parent).alias("parent"), F.col(ev).alias("ev"))
    return pairs.select(
        F.explode(F.array(end("later_id", "earlier_id", "own_evidence"), end("earlier_id", "later_id", "reverse_evidence"))).alias("e"),
        "observed_at", "received_at", *carry,
    ).select(
        F.col("e.child").alias("child_event_id"), F.col("e.parent").alias("parent_event_id"),
        F.lit("outcome_correlation").alias("relation"), F.col("e.parent").alias("target_id"),
        F.col("e.ev").alias("evidence_source"), "observed_at", "received_at", *carry,
    )


KEY_BUCKETS = 16  # stored key rows are cut by key, so that a batch opens only the buckets of its keys
GRID = 8  # a hot key is a grid of GRID x GRID tasks
_LATER = ("observed_at", "received_at", "own_evidence", "reverse_evidence")


def keyed(events: DataFrame, *order: str) -> DataFrame:
    """Key rows as they are stored: with their bucket and what an edge takes from its later event."""
    rows = correlation_keys(events.select("*", *_evidence()), *order, *_LATER)
    return rows.withColumn("key_bucket", F.pmod(F.xxhash64("rule", "key"), F.lit(KEY_BUCKETS)).cast("int"))


def _meet(seeks: DataFrame, offers: DataFrame, hot: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Seeking rows with the earlier rows that offer their key; rows of hot keys are spread over a grid of tasks."""
    position = F.struct(*order)
    hot = F.broadcast(hot.select("full", F.lit(True).alias("hot")))

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.when(F.col("hot"), F.pmod(F.xxhash64("event_id"), F.lit(GRID))).otherwise(F.lit(0)).cast("int")
        every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(GRID - 1))).otherwise(F.array(F.lit(0)))
        return df.withColumn("full", F.concat_ws(_SEP, "rule", "key")).join(hot, "full", "left").withColumn(own, mine).withColumn(other, F.explode(every))

    left = spread(seeks, "x", "y").select(
        "full", "x", "y", F.col("event_id").alias("later_id"), position.alias("later_at"), F.col(order[0]).alias("later_batch"), *_LATER)
    right = spread(offers, "y", "x").select(
        "full", "x", "y", F.col("event_id").alias("earlier_id"), position.alias("earlier_at"), F.col(order[0]).alias("earlier_batch"))
    met = left.join(right, ["full", "x", "y"]).where(F.col("later_at") > F.col("earlier_at"))
    return met.select("later_id", "earlier_id", "later_batch", "earlier_batch", *_LATER)


def delta_edges(new: DataFrame, stored: DataFrame | None, order: tuple[str, ...]) -> DataFrame:
    """Edges of the pairs with at least one end in ``new``, each pair once; what two stored ends make is stored already.

    ``order`` starts with the batch, so either end may be the later one, whatever order batches are committed in.
    """
    new = new.where(F.col("rule") != "both")
    every = new if stored is None else new.unionByName(stored.where(F.col("rule") != "both"), allowMissingColumns=True)
    counts = every.groupBy(F.concat_ws(_SEP, "rule", "key").alias("full")).agg(F.count("*").alias("n"))
    hot = hot_keys(counts, "full")
    side = lambda df, name: df.where(F.col("side") == name)
    pairs = _meet(side(new, "seeks"), side(every, "offers"), hot, order)
    if stored is not None:
        pairs = pairs.unionByName(_meet(side(stored.where(F.col("rule") != "both"), "seeks"), side(new, "offers"), hot, order))
    return _pair_edges(pairs.dropDuplicates(["later_id", "earlier_id"]), "later_batch", "earlier_batch")


def edge_listing(
    events: DataFrame, event_ids: list[str] | DataFrame, limit: int | None = None,
    order: tuple[str, ...] = ("arrival_seq",),
) -> DataFrame:
    """Attribution edges with a requested event as child or parent; with a limit the first by observed time."""
    edges = hierarchy_edges(events)
    places = _with_ids(edges, "child_event_id", event_ids).unionByName(
        _with_ids(_with_ids(edges, "child_event_id", event_ids, "left_anti"), "parent_event_id", event_ids))
    pairs = correlated_pairs(events, event_ids, order)
    later = events.select(F.col("event_id").alias("later_id"), "observed_at", "received_at", *_evidence())
    both = _pair_edges(pairs.join(later, "later_id"))
    return first_rows(places.unionByName(both), limit, "observed_at", "child_event_id", "relation", "target_id")


def edge_counts(events: DataFrame, order: tuple[str, ...] = ("arrival_seq",)) -> DataFrame:
    """Number of edges per relation, correlation edges included (two per pair)."""
    places = hierarchy_edges(events).groupBy("relation").agg(F.count("*").alias("edges"))
    pairs = correlation_degrees(events, order).agg(
        F.coalesce(F.sum("earlier_partners") * 2, F.lit(0)).alias("edges")
    ).select(F.lit("outcome_correlation").alias("relation"), "edges")
    return places.unionByName(pairs)
