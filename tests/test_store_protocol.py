"""Commits of several writers, places of captures, summaries, lookups, and what other engines see."""

import datetime as dt
import os
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from chronocell.operators import filters, log
from chronocell.sources import exports, scratch, snapshots
from chronocell.sources.store import Conflict, Store, StoreError, _folds

DAY = [dt.datetime(2026, 1, d, tzinfo=dt.UTC) for d in range(1, 8)]
KIND = "id long, name string, n long"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/t.cells")


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equal_captures_at_one_instant_keep_their_places(spark, store):
    a, b = [(1, "a", 1), (2, "b", 2)], [(1, "x", 1)]
    for data in (a, b, a):
        store.capture(frame(spark, data), "id", DAY[0], idempotency="latest")
    listed = store.manifest()["events"]
    events = store.events()
    assert events.count() == sum(e["row_count"] for e in listed) == 9
    assert {r["seq"]: r["count"] for r in events.groupBy("seq").count().collect()} == {k: e["row_count"] for k, e in enumerate(listed)}
    assert rows(store.view()) == a


def test_keys_and_columns_with_dots(spark, store):
    kind = "`i.d` long, `x.y` string"
    for day, data in zip(DAY, ([(1, "a"), (2, "b")], [(2, "c")], [(1, None), (2, "c")]), strict=False):
        store.capture(spark.createDataFrame(data, kind), "i.d", day, strict_resurrection=True)
    store.capture(spark.createDataFrame([(1,), (2,)], "`i.d` long"), "i.d", DAY[4])
    assert rows(store.view(DAY[2])) == [(1, None), (2, "c")] and rows(store.view()) == [(1, None), (2, None)]
    assert rows(store.filter({"i.d": 2}, DAY[2])) == [(2, "c")]


def test_captures_leave_no_scratch(spark, store):
    def left():
        root = scratch.shared_dir(spark).removeprefix("file:")
        return [os.path.join(d, f) for d, _, files in os.walk(root) for f in files if "chronocell-capture" in d]

    before = len(left())
    data = frame(spark, [(1, "a", 1)])
    store.capture(data, "id", DAY[0])
    store.capture(data, "id", DAY[1])
    with pytest.raises(StoreError, match="duplicate"):
        store.capture(data.unionByName(data), "id", DAY[2])
    assert len(left()) == before


def test_two_writers_at_once_are_both_kept_in_order(spark, store):
    store.capture(frame(spark, [(1, "a", 1)]), "id", DAY[0])
    waiting = threading.Barrier(2, timeout=120)
    publish, done, met = Store._publish, [], {}

    def slow(self, *a):
        out = publish(self, *a)
        if met.setdefault(threading.get_ident(), 0) == 0:
            met[threading.get_ident()] = 1
            waiting.wait()  # both have compared with the same state before either commits
        return out

    def write(name, at):
        own = Store(spark, store.path)
        own._publish = slow.__get__(own)
        done_now = own.capture(frame(spark, [(1, name, 1), (7, name, 7)]), "id", at)
        done.append(done_now)

    threads = [threading.Thread(target=write, args=x) for x in (("b", DAY[1]), ("c", DAY[2]))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    listed = store.manifest()["events"]
    assert len(listed) == 3 and len(done) == 2
    # The later commit is a difference from the earlier one: views after each are whole tables.
    last = rows(store.view(max(DAY[1], DAY[2])))
    assert last in ([(1, "b", 1), (7, "b", 7)], [(1, "c", 1), (7, "c", 7)])
    assert store.events().count() == sum(e["row_count"] for e in listed)
    # No files but those of commits.
    folder = store.path.removeprefix("file://")
    assert sorted(os.listdir(f"{folder}/events")) == sorted(e["file"].rpartition("/")[2] for e in listed)


def test_a_number_is_given_once_and_readers_fold_what_the_manifest_lacks(spark, store, monkeypatch):
    store.capture(frame(spark, [(1, "a", 1)]), "id", DAY[0])
    old = store.manifest()
    monkeypatch.setattr(Store, "_replace", lambda *_: None)
    store.capture(frame(spark, [(1, "b", 1)]), "id", DAY[1])
    monkeypatch.undo()
    assert len(store._read("manifest.json")["events"]) == 1 and len(store.manifest()["events"]) == 2
    with pytest.raises(Conflict):
        store._commit({"checkpoint": {"file": "checkpoints/x_1_y", "as_of": ""}}, old)
    os.remove(store.path.removeprefix("file://") + "/manifest.json")
    assert rows(store.view()) == [(1, "b", 1)]


def test_summaries_read_the_delta_alone(spark, store):
    days = [[(1, "a", 1), (2, "b", 2), (3, "c", 3)], [(2, "b", 9)], [(1, "a", 1), (2, None, 9)], [(2, "q", 9), (4, "d", 4)], [(1, "a", 5), (4, "d", 4)]]
    for k, data in enumerate(days):
        store.capture(frame(spark, data), "id", DAY[k])
        if k in (1, 3):
            store.checkpoint()
    events = store.events()
    assert rows(store.row_states()) == rows(log.row_states(events))
    assert rows(store.change_counts()) == rows(log.change_counts(events))
    assert rows(store.kpis(["name", "n"])) == rows(log.kpis(events, ["name", "n"]))
    assert rows(store.row_states(DAY[2])) == rows(log.row_states(store.events(DAY[2])))
    assert rows(store.summary().select(*log.SUMMARY.names)) == rows(log.summary(events).select(*log.SUMMARY.names))
    read = store.row_states().inputFiles()
    last = store.manifest()["events"][-1]["file"]
    assert {f.split("/t.cells/")[1].rpartition("/")[0] for f in read} == {max(store.manifest()["checkpoints"], key=_folds)["file"], last}


def test_lookups_open_only_files_that_may_hold_an_entity(spark, store):
    made = []
    for k in range(12):
        data = frame(spark, [(i, "x", k) for i in range(5 * k, 5 * k + 5)] + [(1000, "all", k)])
        # Entities that are missing would be deletions; a store of one-day parts is written below the diff.
        rows_ = data.select(F.col("id").cast("string").alias("entity_id"), F.lit(DAY[0] + dt.timedelta(hours=k)).alias("timestamp"), F.lit("n").alias("field"), F.col("n").cast("string").alias("value"), F.lit("int64").alias("dtype"), F.lit(f"s{k}").alias("snapshot_id"))
        place = f"events/2026_{k:02d}"
        count = store._publish(rows_.coalesce(1), place)
        iso = (DAY[0] + dt.timedelta(hours=k)).isoformat()
        store._commit({"event": {"file": place, "snapshot_id": f"s{k}", "ts_min": iso, "ts_max": iso, "row_count": count}, "key_column": "id", "schema": {"id": "int64", "n": "int64"}}, store.manifest())
        made.append(place)
        if k == 7:
            assert store.index() == 8
    assert store.index() == 4 and store.index() == 0
    everything = store.events()
    ids = [r[0] for r in everything.select("entity_id").distinct().collect()]
    own = {i: {r[0] for r in everything.where(F.col("entity_id") == i).select("seq").distinct().collect()} for i in ("0", "33", "1000")}
    for i, seqs in own.items():
        opened = {p.split("/")[1] for p in store.paths_of([i])}
        assert {made[s].split("/")[1] for s in seqs} <= opened and (i == "1000" or len(opened) <= 4)
    # No id is missed, all at once and with an instant.
    assert rows(store.events_of(ids)) == rows(everything)
    assert rows(store.events_of(["33", "1000"], DAY[0] + dt.timedelta(hours=6))) == rows(store.events(DAY[0] + dt.timedelta(hours=6)).where("entity_id IN ('33', '1000')"))
    assert rows(store.events_of(["never"])) == []
    # A capture that no index knows yet is read whole.
    store.capture(frame(spark, [(33, "x", 77)]), "id", DAY[3])
    assert "77" in {r["value"] for r in store.events_of(["33"]).collect()}


def test_another_engine_reads_the_store_by_glob(spark, store):
    store.capture(frame(spark, [(1, "a", 1), (2, "b", 2)]), "id", DAY[0])
    store.capture(frame(spark, [(1, "a", 3)]), "id", DAY[1])
    folder = store.path.removeprefix("file://")
    got = duckdb.sql(f"SELECT entity_id, field, value FROM read_parquet('{folder}/events/*/*.parquet')").fetchall()
    assert sorted(got, key=repr) == rows(store.events().select("entity_id", "field", "value"))


def test_range_ends_filters_and_nulls_of_a_store(spark, store):
    store.capture(frame(spark, [(1, "a", 1), (2, None, 2)]), "id", DAY[0])
    store.capture(frame(spark, [(1, "z", 1)]), "id", DAY[2])
    assert rows(store.view((DAY[0], DAY[1]))) == [(1, "a", 1), (2, None, 2)]
    assert rows(store.filter({"name": "a"}, (DAY[0], DAY[1]))) == [(1, "a", 1)] and rows(store.filter({"name": "a"})) == []
    assert rows(store.with_nulls(None, (DAY[0], DAY[1]))) == rows(store.with_nulls("name", DAY[1])) == [(2, None, 2)]
    assert rows(store.filter({"n": lambda v: v in (1, 5), "name": filters.over_batches(lambda arrays: ([x == "z" for x in a.to_pylist()] for a in arrays))})) == [(1, "z", 1)]
    with pytest.raises(Exception, match="the filter of column 'n' failed: ZeroDivisionError"):
        store.filter({"n": lambda v: int(v) // 0 == 1}).collect()


def test_tables_of_the_catalogue(spark):
    name = f"exported_{os.getpid()}"
    try:
        exports.save_table(frame(spark, [(1, "a", 1)]), name)
        exports.save_table(frame(spark, [(2, "b", 2)]), name, append=True)
        assert rows(snapshots.from_catalog(spark, name)) == [(1, "a", 1), (2, "b", 2)]
        exports.save_table(frame(spark, [(3, "c", 3)]), name)
        assert rows(snapshots.from_catalog(spark, name)) == [(3, "c", 3)]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    with pytest.raises(ValueError, match="no table"):
        snapshots.from_catalog(spark, name)


def test_golden_store(spark, store):
    """Five days whose events, probes, views and snap points are known."""

    def at(day):
        return DAY[day - 1]

    bob, carol = (200, "bob", None, False, at(1)), (300, "carol", 3.0, True, at(2))
    days = [
        [(100, "alice", 1.0, True, at(1)), (200, "bob", 2.0, False, at(1))],
        [(100, "alice2", 1.5, True, at(2)), bob, carol],
        [bob, carol],
        [(100, "alice3", 9.0, True, at(4)), bob, carol],
        [(50, "eve", 5.0, True, at(5)), (40, "dan", 4.0, False, at(5)), (30, "cara", 3.0, True, at(5))],
    ]
    for k, data in enumerate(days):
        store.capture(spark.createDataFrame(data, "id long, name string, score double, flag boolean, seen timestamp"), "id", DAY[k])
    events = store.events()
    assert events.count() == 36
    before, noon, now = dt.datetime(2025, 12, 31, tzinfo=dt.UTC), DAY[1] + dt.timedelta(hours=12), DAY[6]
    probes = [("100", "name", before), ("100", "name", DAY[1]), ("100", "score", noon), ("200", "score", DAY[1]), ("100", "seen", now), ("300", "score", now)]
    asked = spark.createDataFrame([(k, *p) for k, p in enumerate(probes)], "probe_id long, entity_id string, field string, instant timestamp")
    got = {r["probe_id"]: (r["date"] and r["date"].astimezone(dt.UTC), r["value"]) for r in log.as_of_probes(events, asked).collect()}
    want = [(None, None), (at(2), "alice2"), (at(2), "1.5"), (at(2), None), (at(4), "2026-01-04T00:00:00+00:00"), (at(2), "3.0")]
    assert [got[k] for k in range(6)] == want
    for (entity, field, instant), one in zip(probes, want, strict=True):
        found = [(r["date"].astimezone(dt.UTC), r["value"]) for r in log.as_of(events, entity, field, F.lit(instant)).collect()]
        assert found == ([] if one == (None, None) else [one])
    lines = {(e, f): [(r["value"], r["date"].astimezone(dt.UTC)) for r in log.timeline(events, e, f).collect()] for e, f in (("100", "name"), ("200", "score"))}
    assert lines == {("100", "name"): [("alice", at(1)), ("alice2", at(2)), ("alice3", at(4))], ("200", "score"): [("2.0", at(1)), (None, at(2))]}
    known = events.select("entity_id")
    states = {day: {r["entity_id"]: (r["state"], r["resurrected"]) for r in log.row_states(events, F.lit(t), known).collect()} for day, t in (("old", before), ("third", DAY[2]), ("now", now))}
    assert (states["third"]["100"], states["now"]["100"], states["old"]["100"], states["now"]["200"]) == (("deleted", False), ("deleted", True), ("unborn", False), ("deleted", False))
    assert {e: n for e, n, _ in rows(log.change_counts(events)) if e in ("100", "200", "300")} == {"100": 13, "200": 6, "300": 5}
    empty = store.view(before)
    assert (len(empty.columns), empty.count()) == (5, 0)

    def seen(instant):
        return [(*r[:4], r[4].astimezone(dt.UTC)) for r in store.view(instant).collect()]

    assert seen(DAY[1]) == days[1] and seen(DAY[2]) == days[2]
    assert seen(DAY[4]) == seen(None) == sorted(days[4])
    assert [r[0].astimezone(dt.UTC) for r in log.snap_points(events).collect()] == DAY[:5]
