import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronocell.functions import display
from chronocell.operators import audit, diff, filters, log

SCHEMA = "entity_id string, timestamp timestamp, field string, value string, seq long"


def at(day, hour=0):
    return dt.datetime(2026, 1, day, hour)


EVENTS = [
    ("a", at(1), "x", "1", 1), ("a", at(1), "y", "p", 2), ("a", at(2), "x", "3", 3), ("a", at(3), "x", None, 4),
    ("b", at(1), "x", "5", 5), ("b", at(2), log.DELETED, None, 6), ("b", at(3), "x", "2", 7),
    ("c", at(2), "y", "q", 8), ("c", at(4), log.DELETED, None, 9), ("d", at(5), "x", "9", 10),
]


@pytest.fixture
def events(spark):
    return spark.createDataFrame(EVENTS, SCHEMA)


def lit(t):
    return F.lit(t)


def test_audit_view(events):
    rows = {r["entity_id"]: r for r in audit.audit_view(events, ["x", "y"], ["x"], lit(at(4))).collect()}
    assert set(rows) == {"a", "b", "c"}  # d is not born yet
    a, b, c = (rows[k] for k in "abc")
    assert (a["state"], a["resurrected"], a["flagged"], a["changes"]) == ("active", False, True, 4)
    assert [tuple(x) for x in a["cells"]] == [("x", None, "3", "na", 3), ("y", "p", None, None, 1)]
    assert (b["state"], b["resurrected"], [tuple(x) for x in b["spark"]]) == ("active", True, [(1, "active", 0, 0), (2, "deleted", 1, 1), (3, "resurrected", 2, 2)])
    assert tuple(b["cells"][0]) == ("x", "2", "5", "down", 2)
    assert (c["state"], c["flagged"], tuple(c["cells"][0])) == ("deleted", False, ("x", None, None, None, 0))


def test_cap_sort_and_slice(events):
    rows = audit.audit_view(events, ["x"])
    got = audit.capped(rows, ["first_seen", "entity_id"], 2).select("entity_id", "total_rows", "capped").collect()
    assert [tuple(r) for r in got] == [("a", 4, True), ("b", 4, True)]
    assert not audit.capped(rows, ["entity_id"], 4).first()["capped"]
    state = None
    turns = [state := audit.next_sort(state, c) for c in ("x", "x", "x", "x", "y")]
    assert turns == [("x", "asc"), ("x", "desc"), None, ("x", "asc"), ("y", "asc")]
    view = log.temporal_view(events, ["x"])
    order = {s: [r["entity_id"] for r in audit.sorted_rows(view, s, ["entity_id"]).collect()] for s in (None, ("x", "asc"), ("x", "desc"))}
    assert order == {None: ["a", "b", "c", "d"], ("x", "asc"): ["b", "d", "a", "c"], ("x", "desc"): ["d", "b", "a", "c"]}
    assert [r["entity_id"] for r in audit.slice_rows(audit.sorted_rows(view, None, ["entity_id"]), 1, 2).collect()] == ["b", "c"]


def test_compare_by_state_and_documents(events):
    got = {r["entity_id"]: r["change"] for r in audit.compare_by_state(events, ["x", "y"], lit(at(2)), lit(at(5))).collect()}
    assert got == {"a": "CHG", "b": "ADD", "c": "DROP", "d": "ADD"}
    view = log.mirror_view(events, ["x", "y"])
    assert audit.as_dict(view, "entity_id")["a"] == {"x": None, "y": "p"}
    assert {r["entity_id"]: r["document"] for r in audit.as_documents(view, "entity_id").collect()}["a"] == '{"x":null,"y":"p"}'


def test_pages_lose_no_event_at_ties(spark):
    ties = [("a", at(1), "x", str(k), k) for k in range(7)] + [("a", at(1), "w", "0", 9), ("b", at(1), "x", "0", 8)]
    events = spark.createDataFrame(ties, SCHEMA)
    seen, cursor = [], None
    while True:
        page = log.key_page(events, cursor, 2)
        rows = page.collect()
        if not rows:
            break
        seen += [(r["timestamp"], r["entity_id"], r["field"], r["seq"]) for r in rows]
        cursor = tuple(log.next_cursor(page).first())
    assert seen == sorted((t, e, f, s) for e, t, f, _, s in ties)
    assert log.next_cursor(log.key_page(events, cursor, 2)).count() == 0
    assert log.key_page(events, None, 9, ["b"], ["x"], lit(at(1))).count() == 1


def test_probes_equal_single_lookups(spark, events):
    probes = [(k % 5, e, f, t) for k, (e, f, t) in enumerate((e, f, t) for e in "abz" for f in "xy" for t in (at(1), at(2), at(3, 5), dt.datetime(2000, 1, 1)))] + [(1, "a", "x", None), (1, "a", "x", at(2)), (1, "a", "x", at(2))]
    got = [tuple(r) for r in log.as_of_probes(events, spark.createDataFrame(probes, "probe_id long, entity_id string, field string, instant timestamp")).collect()]
    want = []
    for p, e, f, t in probes:
        own = [x for x in EVENTS if x[0] == e and x[2] == f and t is not None and x[1] <= t]
        last = max(own, key=lambda x: (x[1], x[4]), default=None)
        want.append((p, e, f, last and last[1], last and last[3]))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_nearest_first_seen_and_future(events):
    r = log.nearest_snaps(events, lit(at(2, 12))).first()
    assert (r["previous"], r["next"], r["at"], r["nearest"]) == (at(2), at(3), at(2), at(2))
    assert log.with_future(events, lit(at(3))).where("future").count() == 2
    assert log.of_entities(events, ["a", "zz"]).count() == 4


def test_small_operators(events):
    counts = defaultdict(int)
    for e, _, f, _, _ in EVENTS:
        counts[e] += f != log.DELETED
    assert {r["entity_id"]: r["changes"] for r in log.callouts(events, ["y"], 2).collect()} == {"a": 4, "b": 2}
    k = log.kpis(events, ["x"]).first()
    assert (k["entities"], k["events"], k["deleted"], k["resurrected"], k["flagged"]) == (4, 10, 1, 1, 2)
    assert {(r["entity_id"], r["field"], r["place"], r["earlier"]) for r in log.peek(events, 2).where("entity_id = 'a' AND field = 'x'").collect()} == {("a", "x", 1, 1), ("a", "x", 2, 1)}
    got = {(r["entity_id"], r["field"], r["before"], r["after"]) for r in log.scrub_diff(events, ["x", "y"], lit(at(1)), lit(at(2))).collect()}
    assert got == {("a", "x", "1", "3"), ("c", "y", None, "q")}
    assert sum(r["changes"] for r in log.density(events, 7).collect()) == 10
    assert log.density(events.limit(0), 7).count() == 0
    rows = filters.filter_rows(events, ["x"], ["x"])
    assert {r["id"] for r in filters.where(rows, "flagged AND NOT deleted").collect()} == {"a", "b"}
    with pytest.raises(filters.BadFilter):
        filters.where(rows, "no_such = 1").collect()


def test_kinds_of_events(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    after = spark.createDataFrame([(1, "a"), (2, None), (4, "d")], "id long, v string")
    assert {tuple(r) for r in diff.classed_events(before, after, "id").collect()} == {("2", "v", None, "update"), ("3", log.DELETED, None, "delete"), ("4", "v", "d", "insert")}
    assert {r["id"]: r["change"] for r in diff.classify(before, after, "id").collect()} == {1: "SAME", 2: "CHG", 3: "DROP", 4: "ADD"}


def test_display(spark):
    rows = spark.createDataFrame([(None, None, 0.0), (1.5, -2.0, 59.9), (True and 3.0, 0.123456, 3725.0)], "v double, d double, s double")
    got = [tuple(r) for r in rows.select(display.shown(F.col("v"), rows.schema["v"].dataType), display.shown_delta(F.col("d")), display.runtime(F.col("s"))).collect()]
    assert got == [("ø", None, "0s"), ("1.5", "-2", "59s"), ("3.0", "+0.1235", "1h 2m 5s")]
    r = spark.range(1).select(display.opacity(F.lit(0), F.lit(4)), display.opacity(F.lit(4), F.lit(4)), display.percent_along(F.lit(15), F.lit(10), F.lit(20)), display.percent_along(F.lit(1), F.lit(10), F.lit(20))).first()
    assert r[0] == 0 and abs(r[1] - 0.88) < 1e-9 and r[2] == 50 and r[3] == 0


def test_audit_view_reads_the_log_twice(spark, tmp_path):
    """Once for cells and once for segments, whatever its fields; no fields and write-once ones are fine."""
    rows = [("a", 1, "x", 1), ("a", 2, "x", 2), ("b", 1, "y", 1), ("a", 3, log.DELETED, None), ("b", 9, "y", 5)]
    spark.createDataFrame(rows, "entity_id string, at long, field string, value long").withColumn("timestamp", F.timestamp_seconds("at")).write.parquet(f"{tmp_path}/log")
    events = spark.read.parquet(f"{tmp_path}/log")
    view = audit.audit_view(events, ["x", "y"], ["x", "y"], F.timestamp_seconds(F.lit(5)))
    assert view._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 2
    got = {r["entity_id"]: r for r in view.collect()}
    assert (got["a"]["state"], got["a"]["flagged"], got["a"]["changes"]) == ("deleted", True, 2)
    # A violation counts whenever it is; what is shown is as of the instant.
    assert (got["b"]["flagged"], got["b"]["changes"], [c["value"] for c in got["b"]["cells"]]) == (True, 1, [None, 1])
    assert {r["entity_id"]: (r["flagged"], r["cells"]) for r in audit.audit_view(events, []).collect()} == {"a": (False, []), "b": (False, [])}
