import datetime as dt
import json

import pytest

from chronocell.cli import main
from chronocell.operators import log
from chronocell.sources import exports, history, snapshots
from chronocell.sources.store import Store


@pytest.fixture
def run(spark, capsys):
    def call(*argv):
        code = main([str(x) for x in argv], spark)
        return code, capsys.readouterr().out

    return call


def csv(path, text):
    path.write_text(text)
    return f"file://{path}"


def test_capture_travel_and_states(run, tmp_path):
    store = f"file://{tmp_path}/s.cells"
    one = csv(tmp_path / "one.csv", "id,name,score\n1,a,1.5\n2,b,\n")
    two = csv(tmp_path / "two.csv", "id,name,score\n2,B,4.0\n3,c,2.0\n")
    code, out = run("capture", store, one, "--key", "id", "--at", "2026-01-01", "--json")
    assert code == 0 and json.loads(out)["events_added"] == 3
    assert json.loads(run("capture", store, one, "--key", "id", "--at", "2026-01-02", "--json")[1])["noop"]
    assert run("capture", store, two, "--key", "id", "--at", "2026-01-03")[0] == 0
    assert json.loads(run("travel", store, "--as-of", "2026-01-02", "--json")[1]) == [{"id": 1, "name": "a", "score": 1.5}, {"id": 2, "name": "b", "score": None}]
    assert json.loads(run("travel", store, "--as-of", "2020-01-01", "--json")[1]) == []
    assert [r["id"] for r in json.loads(run("view", store, "--json")[1])] == [2, 3]
    assert [r["value"] for r in json.loads(run("timeline", store, "2", "--field", "name", "--json")[1])] == ["b", "B"]
    assert json.loads(run("row-state", store, "1", "--json")[1]) == {"state": "deleted", "resurrected": False}
    assert json.loads(run("row-state", store, "3", "--as-of", "2026-01-02", "--json")[1])["state"] == "unborn"
    assert json.loads(run("info", store, "--json")[1])["files"] == 2
    assert not json.loads(run("checkpoint", store, "--json")[1])["noop"] and json.loads(run("checkpoint", store, "--json")[1])["noop"]
    assert [r["id"] for r in json.loads(run("view", store, "--json")[1])] == [2, 3]
    code, out = run("view", store, "--format", "csv", "--out", f"file://{tmp_path}/out.csv", "--json")
    assert code == 0 and json.loads(out)["format"] == "csv"


def test_bad_arguments_end_with_their_codes(run, tmp_path):
    store = f"file://{tmp_path}/none.cells"
    good = csv(tmp_path / "good.csv", "id,x\n1,a\n")
    assert run("travel", store, "--as-of", "yesterday")[0] == 2
    assert run("travel", store, "--as-of", "now")[0] == 1
    assert run("info", store)[0] == 1
    assert run("capture", store, f"file://{tmp_path}/none.csv", "--key", "id")[0] == 2
    assert run("capture", store, f"file://{tmp_path}/x.txt", "--key", "id")[0] == 2
    assert run("capture", store, good, "--key", "nope")[0] == 2
    assert run("capture", store, csv(tmp_path / "twice.csv", "id,x\n1,a\n1,b\n"), "--key", "id")[0] == 2
    assert run("capture", store, good, "--key", "id")[0] == 0
    assert run("view", store, "--format", "parquet")[0] == 2
    assert run("gen-fixture", f"{store}2", "--cols", "3")[0] == 2


def test_compare_by_composite_key(run, tmp_path):
    before = csv(tmp_path / "b.csv", "k,l,x\n1,a,1\n1,b,2\n2,a,3\n")
    after = csv(tmp_path / "a.csv", "k,l,x\n1,a,1\n1,b,9\n3,a,3\n")
    store = f"file://{tmp_path}/c.cells"
    assert run("compare", store, before, after, "--key", "k")[0] == 2
    code, out = run("compare", store, before, after, "--key", "k", "l", "--json")
    found = json.loads(out)
    assert code == 0 and found["key"] == "row_key"
    assert [found[k] for k in ("before", "after", "added", "dropped", "changed", "unchanged")] == [3, 3, 1, 1, 1, 1]


def test_same_instant_keeps_the_order_of_captures(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/t.cells")
    for at in (dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 1, 0, 0, 0, 500)):
        store = Store(spark, f"file://{tmp_path}/t{at.microsecond}.cells")
        for value in ("z", "a"):
            store.capture(spark.createDataFrame([(1, value)], "id long, x string"), "id", at)
        assert store.view().first()["x"] == "a"
        assert sorted(r[0] for r in store.events().select("seq").collect()) == [0, 1]


def test_generated_history(spark, tmp_path):
    made = [Store(spark, f"file://{tmp_path}/{n}.cells") for n in "ab"]
    found = [history.generate(s, rows=200, steps=4, violations=3) for s in made]
    assert found[0] == found[1] and 0.01 < found[0]["mean_change"] < 0.05
    a, b = (s.events().drop("seq") for s in made)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert len({r["entity_id"] for r in log.violations(made[0].events(), history.WRITE_ONCE).collect()}) == 3
    assert log.row_states(made[0].events()).where("resurrected").count() > 0
    at = history.FIRST_DAY + dt.timedelta(days=2)
    whole = history.snapshot(spark, 2, 200, 4, violations=3)
    assert made[0].view(at).select(whole.columns).exceptAll(whole).isEmpty()
    assert made[0].view(at).count() == whole.count()


def test_schema_churn(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/churn.cells")
    assert not any(x["noop"] for x in history.generate_schema_churn(store))
    day = lambda n: store.view(history.FIRST_DAY + dt.timedelta(days=n)).orderBy("id").first()
    assert day(3)["score"] == 1.5 and day(4)["score"] is None and day(6)["score"] == 9.0
    assert day(4)["name"] == "ann" and day(5)["name"] is None and day(5)["full_name"] == "ann"


def test_export_forms(spark, tmp_path):
    view = spark.createDataFrame([(1, None), (2, "b")], "id long, x string")
    assert exports.export(view) is view and exports.export(view, "arrow").num_rows == 2
    both = exports.export(view, parquet=f"{tmp_path}/v.parquet", csv=f"{tmp_path}/v.csv")
    assert both == f"{tmp_path}/v.parquet" and snapshots.load(spark, f"{tmp_path}/v.csv").count() == 2
    for bad in ({"form": "xls"}, {"form": "csv"}, {"form": "parquet", "csv": "x"}):
        with pytest.raises(ValueError):
            exports.export(view, **bad)
    assert snapshots.parts_of_name("a.b.c") == ("a", "b", "c")
    with pytest.raises(ValueError):
        snapshots.parts_of_name("a.b")
