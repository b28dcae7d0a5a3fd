"""The stored tables and one intake step over them.

Tables are Parquet folders that a commit log names: a batch writes folders of its own to every table and publishes them in one commit, so
readers see all of a batch or none of it. A batch that runs again replaces all it wrote before, whatever dates that were. Events and what is made from
them row by row are also split by event date.

Ids of earlier batches are looked up through an index (see ``id_index``), correlation edges are made from the batch's keys against stored keys
of the same buckets, and every projection carries its version, so that ``backfill`` rebuilds what is missing or behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.privacy import Policy
from ..schema import STORE_TABLES
from ..session import stage
from . import correlate, id_index, intake, normalize, projections, redact, rollup
from .commits import CommitLog, Part, Snapshot

_DATED = ("events", "measurement_facts", "outcome_events", "attribution_edges")
ORDER = ("ingest_batch", "arrival_seq")
WRITERS = 6  # tables that are written side by side

# Projection -> (version, rows made from events). A higher version makes backfill rebuild older ones.
PROJECTIONS: dict[str, tuple[int, Callable[[DataFrame], DataFrame]]] = {
    "measurement_facts": (1, projections.measurement_facts),
    "outcome_events": (1, projections.outcome_events),
    "attribution_edges": (1, projections.hierarchy_edges),
    "event_rollup": (1, rollup.rollup),
    "correlation_keys": (1, lambda events: correlate.keyed(events, "arrival_seq")),
}


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    root: str

    @property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, self.root)

    def snapshot(self) -> Snapshot:
        return self.log.snapshot()

    def path(self, name: str) -> str:
        if name not in STORE_TABLES:
            raise ValueError(f"unknown table: {name}")
        return f"{self.root.rstrip('/')}/{name}"

    def exists(self, name: str) -> bool:
        self.path(name)
        return self.snapshot().schema(name) is not None

    def read(self, name: str, seen: Snapshot | None = None, parts: list[Part] | None = None) -> DataFrame:
        """The committed rows, of one state if ``seen`` is given; of some folders only if ``parts`` is given."""
        path, seen = self.path(name), seen or self.snapshot()
        schema = seen.schema(name)
        if schema is None:
            raise ValueError(f"nothing is stored in {name}")
        parts = seen.of(name) if parts is None else parts
        if not parts:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", path)
        return reader.parquet(*[f"{self.root.rstrip('/')}/{p.folder}" for p in parts])

    def before(self, name: str, batch: int, seen: Snapshot) -> DataFrame | None:
        """Rows of earlier batches only, so that a repeated batch sees what it saw first."""
        parts = seen.of(name, before=batch)
        return self.read(name, seen, parts) if parts else None

    def write(self, name: str, df: DataFrame, batch: int, version: int = 1, by: str | None = None) -> Written:
        """Write rows to a new folder that the next commit may name."""
        if name in _DATED:
            df, by = df.withColumn("observed_date", F.to_date("observed_at")), "observed_date"
        top = f"{name}/ingest_batch={batch}/attempt={uuid.uuid4().hex}"
        folder = f"{self.root.rstrip('/')}/{top}"
        (df.write.partitionBy(by) if by else df.write).parquet(folder)
        kinds = {f.name: f for f in df.schema.fields}
        tail = [kinds.pop(by)] if by else []
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in kinds.values()] + [
            T.StructField("ingest_batch", T.LongType()), T.StructField("attempt", T.StringType()), *[T.StructField(f.name, f.dataType) for f in tail]])
        return Written(self.folders(name, batch, top, version, by), {name: schema})

    def has(self, folder: str) -> bool:
        return self.log.exists(f"{self.root.rstrip('/')}/{folder}")

    def folders(self, name: str, batch: int, top: str, version: int, by: str | None) -> list[Part]:
        """The parts of one write; each knows how many there are. A write without rows is one empty part."""
        subs = self.log.subfolders(f"{self.root.rstrip('/')}/{top}") if by else []
        if not subs:
            return [Part(name, batch, top, version, {"of": "1"})]
        return [Part(name, batch, f"{top}/{s}", version, {by: s.split("=", 1)[1], "of": str(len(subs))}) for s in subs]

    def commit(self, seen: Snapshot, written: list[Written], drop: list[Part], kind: str) -> Snapshot:
        schemas: dict[str, dict] = {}
        for w in written:
            for name, schema in w.schemas.items():
                known = seen.schema(name)
                mine = {f.name for f in schema.fields}
                more = [f for f in (known.fields if known else []) if f.name not in mine]
                schemas[name] = T.StructType(schema.fields + more).jsonValue()
        return self.log.publish(seen, [p for w in written for p in w.parts], drop, schemas, kind)

    def sweep(self) -> int:
        """Delete folders that no commit names: what crashed or replaced writes left. Only while nobody writes or reads an older state."""
        log, seen = self.log, self.snapshot()
        live, gone = {p.folder for p in seen.parts}, 0
        for name in STORE_TABLES:
            for batch in log.subfolders(self.path(name)):
                for attempt in log.subfolders(f"{self.path(name)}/{batch}"):
                    top = f"{name}/{batch}/{attempt}"
                    subs = [f"{top}/{s}" for s in log.subfolders(f"{self.root.rstrip('/')}/{top}")]
                    for folder in [top] if not any(s in live for s in subs) else subs:
                        if folder not in live:
                            log.delete(f"{self.root.rstrip('/')}/{folder}")
                            gone += 1
        return gone


@dataclass
class Written:
    """Folders of one write and the schema of their table."""

    parts: list[Part]
    schemas: dict[str, T.StructType]


def located(tables: Tables, ids: DataFrame, seen: Snapshot, batch: int | None = None) -> DataFrame | None:
    """(event_id, payload_digest, owner) of stored ids, from the index folders that may hold one of ``ids``; of batches before ``batch``.

    ``owner`` is the batch that stored the event. None if nothing is stored.
    """
    filters = seen.of("id_filters", before=batch)
    if not filters:
        return None
    ids = ids.select("event_id").distinct()
    buckets = [r[0] for r in ids.select(id_index.bucket()).distinct().collect()]  # at most BUCKETS numbers
    held = tables.read("id_filters", seen, filters).where(F.col("bucket").isin(buckets))
    slices = [r[0] for r in held.select("slices").distinct().collect()]
    if not slices:
        return None
    open_ = {(r["name"], str(r["bucket"])) for r in id_index.hits(ids, held, slices).collect()}  # folders, not ids
    parts = [p for p in seen.of("id_index", before=batch) if (p.marks.get("filter"), p.marks.get("bucket")) in open_]
    found = tables.read("id_index", seen, parts)
    return found if batch is None else found.where(F.col("owner") < batch)


def _index(tables: Tables, ids: DataFrame, batch: int) -> list[Written]:
    """New index folders and their filters over (event_id, payload_digest, owner)."""
    name = uuid.uuid4().hex
    index = tables.write("id_index", ids.withColumn("bucket", id_index.bucket()).repartition("bucket"), batch, by="bucket")
    for p in index.parts:
        p.marks["filter"] = name
    return [index, tables.write("id_filters", id_index.filters(ids, name, ids.count()), batch)]


FOLDED = -1  # batch number of an index that holds ids of many batches


def _indexed(tables: Tables, seen: Snapshot, new: DataFrame, batch: int) -> tuple[list[Written], list[Part]]:
    """The index with this batch; folded once ``FOLD`` batches have added to it, or if a repeated batch is already folded."""
    ids = [*seen.of("id_index"), *seen.of("id_filters")]
    own, others = [p for p in ids if p.batch == batch], [p for p in ids if p.batch != batch]
    written = _index(tables, new.select("event_id", "payload_digest", F.lit(batch).cast("long").alias("owner")), batch)
    repeated = any(p.batch == batch for p in seen.of("ingest_ledger"))
    if sum(p.table == "id_filters" for p in others) < id_index.FOLD and not (repeated and not own):
        return written, own
    kept = tables.read("id_index", seen, [p for p in others if p.table == "id_index"]).where(F.col("owner") != batch)
    return written + _index(tables, stage(kept.select("event_id", "payload_digest", "owner"), "folded-ids"), FOLDED), own + others


def ingest(
    tables: Tables, rows: DataFrame, batch: int, policy: Policy = Policy(), arrived_at=None,
) -> DataFrame:
    """Take one batch of envelope rows with ``reasons`` and ``arrival_seq`` into the tables, in one commit.

    Decoding and masking run once, into a staged table; everything after reads from that. Returns the counts and verdict of the batch.
    """
    seen = tables.snapshot()
    arrival = F.current_timestamp() if arrived_at is None else arrived_at
    staged = stage(
        redact.with_digest(redact.redact(rows, policy))
        .withColumns({"payload_json": redact.canonical_payload(), "arrived_at": arrival}),
        f"batch-{batch}",
    )
    good = redact.flatten(
        staged.where(F.size("reasons") == 0), "arrival_seq", "payload_digest", "payload_json", "arrived_at")
    bad = normalize.rejected(staged, "arrival_seq")
    stored = located(tables, good, seen, batch)
    known = None if stored is None else stored.select("event_id", "payload_digest")
    sorted_out = stage(intake.classify(good, known), f"decided-{batch}")
    new = intake.inserted(sorted_out)
    keys = _projected(tables, "correlation_keys", new, batch)
    # The writes do not depend on one another, so their jobs run side by side.
    steps = [
        lambda: ([tables.write("events", new, batch)], []),
        lambda: ([tables.write("ingest_ledger", intake.ledger(sorted_out, "arrival_seq"), batch)], []),
        lambda: ([tables.write("event_conflicts", intake.conflicts(sorted_out, F.col("payload_json")), batch)], []),
        lambda: ([tables.write("rejects", bad, batch)], []),
        *[lambda name=name: ([_projected(tables, name, new, batch)], []) for name in PROJECTIONS if name != "correlation_keys"],
        lambda: _indexed(tables, seen, new, batch),
        lambda: _linked(tables, seen, keys.parts, keys.schemas["correlation_keys"], batch),
    ]
    with ThreadPoolExecutor(WRITERS) as pool:
        done = list(pool.map(lambda step: step(), steps))
    written = [keys, *(w for made, _ in done for w in made)]
    dropped = [p for _, old in done for p in old]
    replaced = [p for p in seen.parts if p.batch == batch and p.table not in ("id_index", "id_filters")]
    tables.commit(seen, written, [*replaced, *dropped], "ingest")
    return intake.batch_counts(
        sorted_out.withColumn("ingest_batch", F.lit(batch)), bad.withColumn("ingest_batch", F.lit(batch)))


def _projected(tables: Tables, name: str, events: DataFrame, batch: int) -> Written:
    version, make = PROJECTIONS[name]
    return tables.write(name, make(events), batch, version, "key_bucket" if name == "correlation_keys" else None)


def _linked(tables: Tables, seen: Snapshot, keys: list[Part], schema: T.StructType, batch: int) -> tuple[list[Written], list[Part]]:
    """Edges between the batch's key rows and all stored ones of the same buckets; each pair belongs to the commit of its last end.

    If the batch is repeated, edges that other batches hold to its former rows are dropped and made anew here.
    """
    state = Snapshot(seen.number, seen.parts, {**seen.schemas, "correlation_keys": schema.jsonValue()})
    mine = tables.read("correlation_keys", state, keys)
    buckets = {p.marks.get("key_bucket") for p in keys}
    parts = [p for p in seen.of("correlation_keys") if p.batch != batch and p.marks.get("key_bucket") in buckets]
    stored = tables.read("correlation_keys", state, parts) if parts else None
    written = [tables.write("correlation_edges", correlate.delta_edges(mine, stored, ORDER), batch)]
    others = [p for p in seen.of("correlation_edges") if p.batch != batch]
    if not others or not any(p.batch == batch for p in seen.of("ingest_ledger")):
        return written, []
    held = tables.read("correlation_edges", seen, others)
    touches = (F.col("later_batch") == batch) | (F.col("earlier_batch") == batch)
    touched = {r["ingest_batch"] for r in held.where(touches).select("ingest_batch").distinct().collect()}
    for other in sorted(touched):
        rows = held.where((F.col("ingest_batch") == other) & ~touches).drop("ingest_batch", "attempt")
        written.append(tables.write("correlation_edges", rows, other))
    return written, [p for p in others if p.batch in touched]


def behind(seen: Snapshot, name: str) -> list[int]:
    """Batches whose folders of a projection are missing, incomplete or of an older version."""
    version = PROJECTIONS[name][0]
    out = []
    for batch in seen.batches("events"):
        mine = [p for p in seen.of(name) if p.batch == batch]
        if not mine or any(p.version != version or p.marks["of"] != str(len(mine)) for p in mine):
            out.append(batch)
    return out


def backfill(tables: Tables) -> dict[str, list[int]]:
    """Rebuild the projections that are behind, from the stored events of their batches, and missing ledger rows; in one commit.

    Returns the batches by table.
    """
    seen = tables.snapshot()
    written, drop, done = [], [], {}
    for name in PROJECTIONS:
        for batch in behind(seen, name):
            events = tables.read("events", seen, [p for p in seen.of("events") if p.batch == batch])
            written.append(_projected(tables, name, events.drop("ingest_batch", "attempt", "observed_date"), batch))
            drop += [p for p in seen.of(name) if p.batch == batch]
            done.setdefault(name, []).append(batch)
    for batch in seen.batches("events"):
        mine = [p for p in seen.of("ingest_ledger") if p.batch == batch]
        if not mine:
            events = tables.read("events", seen, [p for p in seen.of("events") if p.batch == batch])
            empty = tables.read("ingest_ledger", seen, [])
            rows = intake.backfill_ledger(events, empty).join(events.select("event_id", "arrival_seq"), "event_id")
            written.append(tables.write("ingest_ledger", rows, batch))
            done.setdefault("ingest_ledger", []).append(batch)
    if written:
        tables.commit(seen, written, drop, "backfill")
    return done


def event_detail(tables: dict[str, DataFrame], event_id: str) -> DataFrame:
    """Everything stored about one event as rows (part, body)."""
    def part(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("part"), F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("body"))

    mine = lambda name: tables[name].where(F.col("event_id") == event_id)
    edges = tables["edges"]
    parts = [
        part("event", mine("events")),
        part("ledger", mine("ledger")),
        part("measurements", mine("facts")),
        part("outcomes", mine("outcomes")),
        part("attribution", edges),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
