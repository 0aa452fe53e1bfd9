import datetime as dt
import json

import pytest

from chronocell.operators import log
from chronocell.plans import flows
from chronocell.sources.store import Store, StoreError
from chronocell.streaming import lifecycle, live

DAY = [dt.datetime(2026, 1, d, tzinfo=dt.UTC) for d in range(1, 10)]
SNAPS = [[(1, "a", 1), (2, "b", 2), (3, "c", 3)], [(2, "b", 5), (3, "c", None)], [(1, "z", 1), (2, "b", 5), (4, "d", 4)], [(4, "d", 4)], [(2, "q", 9), (4, None, 4)]]


def capture(spark, store, k, at=None):
    return store.capture(spark.createDataFrame(SNAPS[k], "id long, name string, n long"), "id", at or DAY[k])


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s.cells")


def run(spark, frame, tmp_path, into, mode="append", checkpoint="check"):
    got = []

    def take(batch, _):
        got.extend(batch.collect())

    query = frame.writeStream.outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{checkpoint}").trigger(availableNow=True).foreachBatch(take).start()
    query.awaitTermination()
    into.extend(got)
    return got


def stream(spark, store):
    return live.captures(spark, store.path)


def events_of(rows):
    return sorted((r["seq"], r["entity_id"], r["field"], r["value"], r["timestamp"]) for r in rows)


def test_only_committed_captures_are_seen_once(spark, store, tmp_path, monkeypatch):
    seen = []
    run(spark, stream(spark, store), tmp_path, seen)
    assert seen == []
    capture(spark, store, 0)
    capture(spark, store, 1)
    assert len(run(spark, stream(spark, store), tmp_path, seen)) > 0

    def fails(*_):
        raise StoreError("lost before the commit")

    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", fails)
        with pytest.raises(StoreError):
            capture(spark, store, 2, DAY[6])
    assert run(spark, stream(spark, store), tmp_path, seen) == []  # its files are there, its commit is not
    capture(spark, store, 2)
    store.checkpoint()
    capture(spark, store, 3)
    run(spark, stream(spark, store), tmp_path, seen)
    assert run(spark, stream(spark, store), tmp_path, seen) == []
    assert events_of(seen) == events_of(store.events().collect())


def test_commit_that_no_manifest_has_yet_is_seen(spark, store, tmp_path, monkeypatch):
    capture(spark, store, 0)
    with monkeypatch.context() as m:
        m.setattr(Store, "_replace", lambda *_: None)
        capture(spark, store, 1)
    assert len(json.loads((tmp_path / "s.cells/manifest.json").read_text())["events"]) == 1
    assert {r["seq"] for r in run(spark, stream(spark, store), tmp_path, [])} == {0, 1}


def test_states_of_a_stream_equal_those_of_the_log_after_restarts(spark, store, tmp_path):
    seen = []
    # Captures come out of order of their instants; each start goes on from the state that is kept.
    for k, at in ((0, DAY[0]), (3, DAY[3]), (1, DAY[1]), (2, DAY[2]), (4, DAY[4])):
        capture(spark, store, k, at)
        run(spark, lifecycle.row_states(stream(spark, store)), tmp_path, seen, "update")
    last = {r["entity_id"]: r for r in seen}
    events = store.events()
    assert {e: (r["state"], r["resurrected"]) for e, r in last.items()} == {r["entity_id"]: (r["state"], r["resurrected"]) for r in log.row_states(events).collect()}
    cells = {}
    for r in log.latest_cells(events).collect():
        cells.setdefault(r["entity_id"], {})[r["field"]] = r["value"]
    assert {e: r["cells"] for e, r in last.items()} == cells


def test_cells_of_the_gone_are_dropped_after_a_while(spark, store, tmp_path):
    seen = []
    for k in (0, 1):
        capture(spark, store, k)
        run(spark, lifecycle.row_states(stream(spark, store), "1 DAY"), tmp_path, seen, "update")
    assert {r["entity_id"]: r for r in seen}["1"]["cells"] == {"name": "a", "n": "1"}
    # A later event moves the watermark on, and the batch after it finds the time run out.
    for k in (7, 8):
        store.capture(spark.createDataFrame([*SNAPS[1], (9, "i", k)], "id long, name string, n long"), "id", DAY[k])
        run(spark, lifecycle.row_states(stream(spark, store), "1 DAY"), tmp_path, seen, "update")
    last = {r["entity_id"]: r for r in seen}["1"]
    assert (last["state"], last["cells"]) == ("deleted", {})


def test_states_of_named_fields_equal_those_of_the_log_after_restarts(spark, store, tmp_path):
    seen = []
    for k, at in ((0, DAY[0]), (3, DAY[3]), (1, DAY[1]), (2, DAY[2]), (4, DAY[4])):
        capture(spark, store, k, at)
        got = run(spark, lifecycle.row_states(stream(spark, store), fields=["n", "name", "never"]), tmp_path, seen, "update")
        # Only what a batch touches is told, and cells that it does not touch are there all the same.
        assert sorted(r["entity_id"] for r in got) == sorted({r["entity_id"] for r in store.events().where(f"seq = {len(store.files()) - 1}").collect()})
    last = {r["entity_id"]: r for r in seen}
    events = store.events()
    assert {e: (r["state"], r["resurrected"]) for e, r in last.items()} == {r["entity_id"]: (r["state"], r["resurrected"]) for r in log.row_states(events).collect()}
    cells = {}
    for r in log.latest_cells(events).collect():
        cells.setdefault(r["entity_id"], {})[r["field"]] = r["value"]
    assert {e: r["cells"] for e, r in last.items()} == cells


def test_fields_that_are_not_named_count_for_the_lifecycle(spark, store, tmp_path):
    seen = []
    for k in range(3):
        capture(spark, store, k)
        run(spark, lifecycle.row_states(stream(spark, store), fields=["n"]), tmp_path, seen, "update")
    last = {r["entity_id"]: r for r in seen}
    assert {e: (r["state"], r["resurrected"]) for e, r in last.items()} == {r["entity_id"]: (r["state"], r["resurrected"]) for r in log.row_states(store.events()).collect()}
    assert last["1"]["cells"] == {"n": "1"} and last["3"]["cells"] == {"n": None}
    none = run(spark, lifecycle.row_states(stream(spark, store), fields=[]), tmp_path, [], "update", "other")
    assert {r["entity_id"]: r["cells"] for r in none} == dict.fromkeys(last, {})
    with pytest.raises(ValueError, match="keep"):
        lifecycle.row_states(stream(spark, store), "1 DAY", ["n"])


def test_query_of_states_calls_no_python_for_each_entity(spark, monkeypatch):
    plans, streamed = [], flows.streamed

    def noted(spark, rows, *more):
        plans.append(rows._jdf.queryExecution().logical().toString())
        return streamed(spark, rows, *more)

    monkeypatch.setattr(flows, "streamed", noted)
    rows = flows.stream_row_states(spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and not any("TransformWithState" in p for p in plans)
    assert rows.count() > 0
