import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronocell.operators import log
from chronocell.sources.store import Store, StoreError

DAY = [dt.datetime(2026, 1, d) for d in range(1, 8)]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/t.cells")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_lifecycle_and_views(spark, store):
    schema = "id long, name string, score double"
    days = [[(1, "a", 10.0), (2, "b", 20.0), (3, "c", 30.0)], [(2, "b", 25.0), (3, "c", None), (4, "d", 40.0)], [(1, "a", 10.0), (2, "b2", 27.5), (3, "c", None), (4, "d", 40.0)]]
    for day, data in zip(DAY, days, strict=False):
        assert not store.capture(spark.createDataFrame(data, schema).repartition(3), "id", day)["noop"]
    assert store.capture(spark.createDataFrame(days[2][::-1], schema), "id", DAY[4])["noop"]
    for day, data in zip(DAY, days, strict=False):
        assert rows(store.view(day)) == data
    assert rows(store.view(dt.datetime(2025, 1, 1))) == [] and store.view(dt.datetime(2025, 1, 1)).columns == ["id", "name", "score"]
    e = store.events()
    assert [r["value"] for r in log.timeline(e, "2", "score").collect()] == ["20.0", "25.0", "27.5"]
    states = {r["entity_id"]: (r["state"], r["resurrected"]) for r in log.row_states(e).collect()}
    assert states["1"] == ("active", True) and states["2"] == ("active", False)
    assert store.info()["files"] == 3 and store.info()["events"] == e.count()


def test_nulls_of_rows_that_come_back(spark, store):
    schema = "id long, name string, state string"
    for day, data in zip(DAY, ([(1, "a", "x"), (2, "b", "y")], [(2, "b", "y")], [(1, "a", None), (2, "b", None)]), strict=False):
        store.capture(spark.createDataFrame(data, schema), "id", day, strict_resurrection=day == DAY[2])
    assert rows(store.view()) == [(1, "a", None), (2, "b", None)]
    # Without it the cell from before shows.
    store.capture(spark.createDataFrame([(2, "b", "z")], schema), "id", DAY[3])
    store.capture(spark.createDataFrame([(1, "a", None), (2, None, "z")], schema), "id", DAY[4])
    store.capture(spark.createDataFrame([(1, "a", "q")], schema), "id", DAY[5])
    assert store.capture(spark.createDataFrame([(1, "a", "q"), (2, "b", None)], schema), "id", DAY[6])["events_added"] == 1
    assert rows(store.view()) == [(1, "a", "q"), (2, "b", "z")]


def test_columns_come_and_go(spark, store):
    store.capture(spark.createDataFrame([(1, 5, 99.5)], "id long, a long, b double"), "id", DAY[0])
    assert store.capture(spark.createDataFrame([(1, 5)], "id long, a long"), "id", DAY[1])["events_added"] == 1
    assert store.capture(spark.createDataFrame([(1, 5)], "id long, a long"), "id", DAY[2])["noop"]
    store.capture(spark.createDataFrame([(1, 5)], "id long, c long"), "id", DAY[3])
    assert rows(store.view(DAY[0])) == [(1, 5, 99.5, None)]
    assert rows(store.view(DAY[2])) == [(1, 5, None, None)]
    assert rows(store.view()) == [(1, None, None, 5)]


def test_types_survive(spark, store):
    t = dt.datetime(2026, 1, 1, 12, 0, 0, 123456)
    data = [(9007199254740993, float("inf"), True, t, "x|y"), (-9223372036854775808, 1e-7, False, None, "")]
    store.capture(spark.createDataFrame(data, "id long, f double, b boolean, t timestamp, s string"), "id", DAY[0])
    assert rows(store.view()) == sorted(data)


def test_bad_snapshots(spark, store):
    for data, word in (([(1,), (1,)], "duplicate"), ([(None,), (1,)], "null")):
        with pytest.raises(StoreError, match=word):
            store.capture(spark.createDataFrame(data, "id long"), "id", DAY[0])
    with pytest.raises(StoreError, match="key column"):
        store.capture(spark.createDataFrame([(1,)], "id long"), "nope", DAY[0])
    with pytest.raises(StoreError, match="no store"):
        store.events()


def test_wide_table_writes_changed_cells_only(spark, store):
    wide = ", ".join(f"f{c} double" for c in range(60))
    base = [(r, *[r * 1000.0 + c for c in range(60)]) for r in range(400)]
    store.capture(spark.createDataFrame(base, f"id long, {wide}"), "id", DAY[0])
    changed = [(r, *[v + 7 for v in x]) if r % 50 == 0 else (r, *x) for r, *x in base]
    assert store.capture(spark.createDataFrame(changed, f"id long, {wide}"), "id", DAY[1])["events_added"] == 8 * 60


def test_checkpoints_change_no_view(spark, store):
    schema = "id long, name string, score double"
    days = [[(1, "a", 10.0), (2, "b", 20.0)], [(2, None, 25.0), (3, "c", 1.0)], [(1, "a2", None), (3, "c", 1.0)], [(1, "a2", 4.0), (2, "b", 5.0)]]
    assert store.manifest()["checkpoints"] == []
    for k, data in enumerate(days[:3]):
        store.capture(spark.createDataFrame(data, schema), "id", DAY[k + 1])
        if k < 2:
            made = store.checkpoint()
            assert set(made) == {"file", "as_of"} and store.checkpoint() is None
    # One that is captured late counts after the checkpoint, though its instant is before it.
    late = store.capture(spark.createDataFrame([(1, "early", None), (3, "c", 1.0)], schema), "id", DAY[0])
    assert late["events_added"] == 2
    store.capture(spark.createDataFrame(days[3], schema), "id", DAY[5])
    plain = Store(spark, store.path)
    plain.latest = plain.events
    for day in [None, dt.datetime(2025, 1, 1), *DAY]:
        assert rows(store.view(day)) == rows(plain.view(day)), day
    assert rows(store.view()) == days[3]
    assert store.latest().count() < store.events().count()
    # Captures over a checkpoint add what they would add without it.
    assert store.checkpoint() and store.capture(spark.createDataFrame([(1, "a2", 4.0), (2, "B", 5.0)], schema), "id", DAY[6])["events_added"] == 1


def test_wide_and_narrow_views_agree(spark, monkeypatch):
    fields = [f"f{k}" for k in range(50)]
    data = [(str(e), dt.datetime(2026, 1, 1 + s), f, None if (e + s + k) % 7 == 0 else f"{e}{s}{k}", s) for e in range(9) for k, f in enumerate(fields) for s in range(3) if (e * k + s) % 3]
    data += [(str(e), dt.datetime(2026, 1, 1 + e % 5), log.DELETED, None, 3) for e in range(5)] + [("only", dt.datetime(2026, 1, 1), log.DELETED, None, 0), (None, dt.datetime(2026, 1, 1), "f1", "x", 0), ("odd", dt.datetime(2026, 1, 1), None, "x", 0)]
    own = spark.createDataFrame(data, "entity_id string, timestamp timestamp, field string, value string, seq int")

    def views():
        return [sorted(map(repr, rows(f(own, fields, at)))) for f in (log.mirror_view, log.temporal_view) for at in (None, F.lit(DAY[1]), F.lit(dt.datetime(2020, 1, 1)))]

    wide = views()
    monkeypatch.setattr(log, "WIDE", 1000)
    assert wide == views() and len(wide[0]) > 5
