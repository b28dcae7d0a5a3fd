"""Stored tables: commits, the id index, stored correlation edges, purge, expiry and backfill."""

import json
import re

import pytest
from pyspark.sql import functions as F

from spanloom.operators import correlate as C
from spanloom.operators import id_index
from spanloom.operators import retention as RT
from spanloom.operators import series as S
from spanloom.operators import tables as TB
from spanloom.operators.commits import CommitLog
from spanloom.operators.tables import ORDER, Tables, ingest
from spanloom.session import stage
from spanloom.sources import jsonl


def event(event_id, at="2026-08-07T14:00:00Z", **sections):
    return {"schema_version": "1.0", "event_id": event_id, "event_type": "model.operation", "observed_at": at, "received_at": "2026-10-01T00:00:00Z", **sections}


DECODED = {}


def rows(spark, docs):
    """Envelope rows of the documents. Documents of ``linked`` are decoded once for all tests."""
    def decoded(docs):
        frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "arrival_seq long, line string")
        return jsonl.events_from_lines(frame, "arrival_seq")

    if "linked" not in DECODED:
        DECODED["linked"] = stage(decoded(linked(40)), "linked").drop("arrival_seq")
    wanted = [d["event_id"] for d in docs]
    if not all(re.fullmatch(r"e\d+", i) for i in wanted):
        return decoded(docs)
    order = spark.createDataFrame([(i, k) for k, i in enumerate(wanted)], "event_id string, arrival_seq long")
    return DECODED["linked"].join(F.broadcast(order), "event_id").select(*DECODED["linked"].columns, "arrival_seq")


def linked(n, start=0):
    """Operations and outcomes of few sessions and tasks on three days."""
    out = []
    for i in range(start, start + n):
        ex = {"session_id": f"s{i % 3}", "task_id": f"t{i % 2}", **({"parent_event_id": f"e{i - 1}"} if i else {})}
        oc = {"outcome": {"kind": "tests", "status": "passed", "correlation_basis": ["session_id", "task_id"][i % 2]}} if i % 4 == 1 else {}
        out.append(event(f"e{i}", f"2026-08-0{1 + i % 3}T1{i % 10}:00:00Z", execution=ex, usage={"input_tokens": i}, **oc))
    return out


def ids(tables, name="events", column="event_id"):
    return sorted(r[0] for r in tables.read(name).select(column).collect())


def edges(df):
    cols = ["child_event_id", "parent_event_id", "relation", "target_id", "evidence_source", "observed_at", "received_at"]
    return sorted(map(tuple, df.select(cols).collect()), key=str)


@pytest.fixture(scope="module")
def three(spark, tmp_path_factory):
    """Three batches, the second one twice (with other rows first), and the same rows as one batch."""
    tables, once = (Tables(spark, str(tmp_path_factory.mktemp(n))) for n in ("three", "once"))
    docs = linked(18)
    ingest(tables, rows(spark, docs[:6]), 0)
    ingest(tables, rows(spark, linked(4, 30)), 1)
    ingest(tables, rows(spark, docs[6:12]), 1)
    ingest(tables, rows(spark, docs[12:]), 2)
    ingest(once, rows(spark, docs), 0)
    return tables, once


def test_stored_edges_equal_one_batch(spark, three):
    tables, once = three
    assert ids(tables) == ids(once) == sorted(f"e{i}" for i in range(18))
    stored = edges(tables.read("correlation_edges"))
    assert stored == edges(once.read("correlation_edges")) and len(stored) > 20
    events = once.read("events")
    listed = C.edge_listing(events, [f"e{i}" for i in range(18)], None, ORDER).where("relation = 'outcome_correlation'")
    assert stored == edges(listed)


def test_edges_do_not_depend_on_the_order_of_commits(spark, tmp_path, three):
    tables = Tables(spark, str(tmp_path))
    docs = linked(18)
    for batch in (2, 0, 1):
        ingest(tables, rows(spark, docs[6 * batch:6 * batch + 6]), batch)
    assert edges(tables.read("correlation_edges")) == edges(three[1].read("correlation_edges"))
    first = edges(tables.read("correlation_edges"))
    ingest(tables, rows(spark, docs[6:12]), 1)  # a repeated batch, with later ones stored
    assert edges(tables.read("correlation_edges")) == first


def test_a_crash_before_the_commit_shows_nothing(spark, tmp_path, monkeypatch):
    tables = Tables(spark, str(tmp_path))
    ingest(tables, rows(spark, linked(3)), 0)
    before = tables.snapshot()
    for name in ("events", "id_filters", "correlation_edges"):
        write = Tables.write

        def broken(self, table, *args, **how):
            if table == name:
                raise IOError("lost")
            return write(self, table, *args, **how)

        monkeypatch.setattr(Tables, "write", broken)
        with pytest.raises(IOError):
            ingest(tables, rows(spark, linked(9)), 1)
        monkeypatch.undo()
        assert tables.snapshot() == before and tables.read("events").count() == 3
    ingest(tables, rows(spark, linked(9)), 1)
    assert tables.read("events").count() == 9 and tables.sweep() > 0 and tables.read("events").count() == 9
    # A smaller repeat leaves nothing of the larger one, on any date.
    ingest(tables, rows(spark, linked(4)), 1)
    assert ids(tables) == ["e0", "e1", "e2", "e3"] and ids(tables, "correlation_keys", "event_id")[-1] < "e4"


def test_commits_do_not_overtake(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    first = log.snapshot()
    log.publish(first, [], [], {}, "a")
    with pytest.raises(RuntimeError):
        log.publish(first, [], [], {}, "b")
    for _ in range(40):
        log.publish(log.snapshot(), [], [], {"t": {"type": "struct", "fields": []}}, "c")
    assert log.snapshot().number == 41 and log.snapshot().schema("t") is not None


def test_index_opens_only_folders_that_may_hold_an_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(id_index, "FOLD", 2)
    tables = Tables(spark, str(tmp_path))
    for batch in range(2):
        ingest(tables, rows(spark, [event(f"b{batch}-{i}") for i in range(60)]), batch)
    seen = tables.snapshot()
    assert len(seen.of("id_index")) > 40
    asked = spark.createDataFrame([("b0-7",), ("unseen-1",), ("unseen-2",)], "event_id string")
    found = TB.located(tables, asked, seen)
    assert {f.rsplit("/", 1)[0].split("id_index/")[1] for f in found.inputFiles()} == {
        p.folder.split("id_index/")[1] for p in seen.of("id_index") if p.batch == 0 and p.marks["bucket"] == str(asked.limit(1).select(id_index.bucket()).first()[0])}
    assert [r.event_id for r in found.where("event_id = 'b0-7'").collect()] == ["b0-7"]
    assert TB.located(tables, asked, seen, 0) is None
    # the third batch folds the index of the first two; duplicates of both are still seen, and a folded batch can be repeated
    got = ingest(tables, rows(spark, [event("b0-1"), event("b1-1", usage={"input_tokens": 1}), event("new")]), 2).first()
    assert (got.inserted, got.duplicate, got.conflict) == (1, 1, 1)
    assert {p.batch for p in tables.snapshot().of("id_filters")} == {TB.FOLDED, 2}
    ingest(tables, rows(spark, [event("b1-1"), event("other")]), 1)
    got = ingest(tables, rows(spark, [event("b0-1"), event("b1-1"), event("b1-2"), event("other")]), 3).first()
    assert (got.inserted, got.duplicate) == (1, 3)


def test_large_filters_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(id_index, "SLICE", 4)
    ids = spark.range(1000).select(F.col("id").cast("string").alias("event_id"))
    stored = id_index.filters(ids, "n", 1000)
    assert {r.slices for r in stored.collect()} == {8}
    asked = spark.range(990, 3000).select(F.col("id").cast("string").alias("event_id"))
    hit = {r.bucket for r in id_index.hits(asked, stored, [8]).collect()}
    want = {r[0] for r in ids.where("cast(event_id as int) >= 990").select(id_index.bucket()).distinct().collect()}
    assert want <= hit and len(hit) <= len(want) + 3


def test_purge_of_stored_tables(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    docs = linked(18)
    ingest(tables, rows(spark, docs[:9]), 0)
    ingest(tables, rows(spark, docs[9:] + [docs[0]]), 1)
    with pytest.raises(ValueError):
        RT.purge(tables, "2026-08-02T00:00:00Z")
    kept = {p.folder for p in tables.snapshot().of("events") if p.marks["observed_date"] == "2026-08-03"}
    gone = RT.purge(tables, "2026-08-02T12:00:00Z", confirm=True)
    left = sorted(d["event_id"] for d in docs if d["observed_at"] >= "2026-08-02T12:00:00Z")
    assert gone == 18 - len(left) and ids(tables) == left
    assert kept <= {p.folder for p in tables.snapshot().of("events")}  # untouched folders stay
    assert not [p for p in tables.snapshot().of("measurement_facts") if p.marks["observed_date"] == "2026-08-01"]
    for name in ("measurement_facts", "outcome_events", "ingest_ledger", "correlation_keys", "id_index"):
        assert set(ids(tables, name)) <= set(left)
    for name in ("attribution_edges", "correlation_edges"):
        for side in ("child_event_id", "parent_event_id"):
            assert {i for i in ids(tables, name, side) if i} <= set(left) if side == "child_event_id" else True
            assert not {r[0] for r in tables.read(name).select(side).collect()} & {f"e{i}" for i in range(18)} - set(left)
    state = [sorted(map(str, tables.read(n).drop("attempt").collect())) for n in ("events", "ingest_ledger", "attribution_edges", "correlation_edges", "correlation_keys")]
    assert RT.purge(tables, "2026-08-02T12:00:00Z", confirm=True) == 0
    assert state == [sorted(map(str, tables.read(n).drop("attempt").collect())) for n in ("events", "ingest_ledger", "attribution_edges", "correlation_edges", "correlation_keys")]
    assert RT.purge(tables, event_ids=[left[0], "nobody"], confirm=True) == 1 and ids(tables) == left[1:]
    actions = tables.read("maintenance_actions").orderBy("requested_at", F.desc("outcome")).collect()
    assert [(a.outcome, a.affected_events) for a in actions] == [("started", gone), ("completed", gone), ("started", 0), ("completed", 0), ("started", 1), ("completed", 1)]
    assert TB.backfill(tables) == {}  # purged folders are not lost ones
    again = ingest(tables, rows(spark, docs), 2).first()
    assert (again.inserted, again.duplicate) == (18 - len(left) + 1, len(left) - 1)


def test_signal_classes_expire(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    src = lambda kind: {"source": {"kind": kind}}
    docs = []
    for day in ("2026-08-01", "2026-08-20", "2026-09-01"):
        docs += [event(f"otel:{day}:1", f"{day}T00:00:00Z", **src("native_otel")), event(f"log-{day}", f"{day}T00:00:00Z", **src("native_otel")),
                 {**event(f"metric-{day}", f"{day}T00:00:00Z", **src("native_otel")), "event_type": "telemetry.metric"}, event(f"own-{day}", f"{day}T00:00:00Z")]
    ingest(tables, rows(spark, docs), 0)
    assert RT.expire_stored(tables, "2026-09-05T00:00:00Z") == {"metrics": 1, "traces": 1, "logs": 2}
    assert ids(tables) == sorted([d["event_id"] for d in docs if d["observed_at"] > "2026-08-05" or d["event_id"].startswith("own")] and
                                 [d["event_id"] for d in docs if d["event_id"].startswith("own") or d["observed_at"] > "2026-08-21" or
                                  (d["observed_at"] > "2026-08-19" and not d["event_id"].startswith("log"))])


def test_backfill_restores_lost_and_old_projections(spark, tmp_path, monkeypatch):
    tables = Tables(spark, str(tmp_path))
    docs = linked(12)
    for batch in range(2):
        ingest(tables, rows(spark, docs[6 * batch:6 * batch + 6]), batch)
    names = list(TB.PROJECTIONS)
    full = {n: sorted(map(str, tables.read(n).drop("attempt").collect())) for n in [*names, "ingest_ledger"]}
    seen = tables.snapshot()
    lost = [next(p for p in seen.of(n) if p.batch == 1) for n in names] + [p for p in seen.of("ingest_ledger") if p.batch == 0]
    tables.commit(seen, [], lost, "loss")
    assert TB.backfill(tables) == {**{n: [1] for n in names}, "ingest_ledger": [0]}
    assert full == {n: sorted(map(str, tables.read(n).drop("attempt").collect())) for n in names} | {"ingest_ledger": full["ingest_ledger"]}
    assert {r.decision for r in tables.read("ingest_ledger").where("ingest_batch = 0").collect()} == {"backfill"}
    assert TB.backfill(tables) == {}
    version, make = TB.PROJECTIONS["measurement_facts"]
    monkeypatch.setitem(TB.PROJECTIONS, "measurement_facts", (version + 1, lambda e: make(e).where("value > 3")))
    assert TB.backfill(tables) == {"measurement_facts": [0, 1]}
    assert tables.read("measurement_facts").count() == 8 and {p.version for p in tables.snapshot().of("measurement_facts")} == {2}


def test_series_from_stored_minutes(spark, tmp_path):
    """Three batches out of order, events at the edges of minutes, and a purge: stored minutes give what the events give."""
    tables = Tables(spark, str(tmp_path))
    docs = linked(24)
    times = ["2026-08-02T10:00:00Z", "2026-08-02T10:00:00.000500Z", "2026-08-02T10:00:00.001Z", "2026-08-02T10:00:00.001001Z", "2026-08-02T09:59:59.999999Z", "2026-08-03T00:00:00Z"]
    edge = [event(f"x{k}", t, reliability={"status": ["succeeded", "failed"][k % 2], "timeout": k % 3 == 0}, performance={"latency_ms": k}) for k, t in enumerate(times)]
    ingest(tables, rows(spark, docs[12:]), 2)
    ingest(tables, rows(spark, docs[:12]), 0)
    ingest(tables, rows(spark, edge), 1)
    grids = [S.range_grid("2026-08-01T00:00:00Z", "2026-08-03T00:00:00Z", "1h"), S.range_grid("2026-08-02T09:58:00Z", "2026-08-02T10:03:00Z", "1m"),
             S.instant_grid("2026-08-02T10:00:00Z")]

    def same():
        events, minutes = tables.read("events"), tables.read("event_rollup")
        for family in ("events_total", "event_successes_total", "timeouts_total", "latency_average_ms", "input_tokens_total", "success_rate_by_provider_model",
                       "timeouts_by_context_total"):
            for grid in grids:
                of = lambda t: sorted(map(str, S.series(family, t, grid).matrix().collect()))
                assert S.series(family, {"events": events.limit(0), "rollup": minutes}, grid).leaf.stored
                assert of({"events": events.limit(0), "rollup": minutes}) == of({"events": events}), (family, grid)

    same()
    assert RT.purge(tables, "2026-08-02T10:00:00.000700Z", confirm=True) > 4
    same()
    assert not S.series("events_total", {"rollup": None}, S.range_grid("2026-08-02T10:00:01Z", "2026-08-02T11:00:01Z", "1h")).leaf.stored
