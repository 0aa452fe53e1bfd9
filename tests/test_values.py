import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronocell.functions import codec, legacy
from chronocell.sources.store import Store, StoreError


def test_float_texts(spark):
    values = [0.0, -0.0, 1.0, -1.5, 1e-4, 1.25e-4, 1e-5, 1e-7, -2.5e-10, 1e7, 12345678.0, 123456789.125, 1e15, 1.5e15, 9007199254740993.0, 1e16, 1.5e16, 1e22, 1e100, 1e-300, 0.1, 1 / 3, 100.0, math.inf, -math.inf, math.nan]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    texts = [r[0] for r in rows.select(codec.encoded(F.col("v"), T.DoubleType())).collect()]
    assert texts == [repr(v) for v in values]
    back = rows.select(codec.decoded(codec.encoded(F.col("v"), T.DoubleType()), "float64")).collect()
    assert all(b[0] == v or (math.isnan(v) and math.isnan(b[0])) for b, v in zip(back, values, strict=True))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_are_the_same_text_in_every_zone(spark, zone):
    rows = [(1, 1767268800_000000, "2026-03-08 02:30:00.5"), (2, -1, "1969-12-31 23:59:59.999999")]
    df = spark.createDataFrame(rows, "id long, us long, w string").select("id", F.timestamp_micros("us").alias("t"), F.col("w").cast("timestamp_ntz").alias("w"))
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = [tuple(r) for r in df.select(codec.encoded(F.col("t"), T.TimestampType()), codec.encoded(F.col("w"), T.TimestampNTZType())).collect()]
        back = [r[0] for r in df.select(F.unix_micros(codec.decoded(codec.encoded(F.col("t"), T.TimestampType()), "datetime[us, UTC]"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [("2026-01-01T12:00:00+00:00", "2026-03-08T02:30:00.500000+00:00"), ("1969-12-31T23:59:59.999999+00:00", "1969-12-31T23:59:59.999999+00:00")]
    assert back == [r[1] for r in rows]


def test_store_keeps_instants_in_another_zone(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        store = Store(spark, f"file://{tmp_path}/z.cells")
        store.capture(spark.range(1).select("id", F.timestamp_micros(F.lit(1767268800_000000)).alias("t")), "id", dt.datetime(2026, 1, 1))
        assert store.view().select(F.unix_micros("t")).first()[0] == 1767268800_000000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_captures_out_of_order_and_repeated(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/o.cells")
    a, b = spark.createDataFrame([(1, 5)], "id long, v long"), spark.createDataFrame([(1, 6)], "id long, v long")
    store.capture(a, "id", dt.datetime(2026, 1, 2))
    with pytest.raises(StoreError, match="events after"):
        store.capture(b, "id", dt.datetime(2026, 1, 1), allow_out_of_order=False)
    store.capture(b, "id", dt.datetime(2026, 1, 3))
    assert store.capture(a, "id", dt.datetime(2026, 1, 4))["noop"]
    assert store.capture(a, "id", dt.datetime(2026, 1, 4), idempotency="latest")["events_added"] == 1
    assert store.view().first()["v"] == 5
    assert not any(p.name.startswith(".staging") and any(p.rglob("*.parquet")) for p in (tmp_path / "o.cells").iterdir())


NOW = "2026-01-01 00:00:00"


def first(spark, text, mode, kind="string"):
    rows = spark.createDataFrame([(text,)], f"c {kind}")
    found = rows.select(legacy.initial(F.col("c"), rows.schema["c"].dataType, F.lit(NOW), mode)).first()[0]
    return [tuple(e) for e in found]


def test_modes_of_the_older_mirror(spark):
    history = '[{"date":"2020-01-01 00:00:00","value":"a"},{"date":"2021-01-01 00:00:00","value":"b"}]'
    whole = [("2020-01-01 00:00:00", "a"), ("2021-01-01 00:00:00", "b")]
    for mode in legacy.MODES:
        assert first(spark, history, mode) == whole and first(spark, f"[{history}]", mode) == whole
        assert first(spark, '[{"date":"2020', mode) == [(NOW, '[{"date":"2020')]
        assert first(spark, None, mode) == [(NOW, "NULL")]
    assert first(spark, ' "q" ', "new") == [(NOW, '"q"')] and first(spark, ' "q" ', "serialized") == [(NOW, ' "q" ')] and first(spark, ' "q" ', "compare") == [(NOW, "q")]
    assert first(spark, dt.datetime(2026, 1, 2, 3, 4, 5, 678), "new", "timestamp") == [(NOW, "2026-01-02 03:04:05")]
    with pytest.raises(ValueError, match="unknown mode"):
        legacy.initial(F.lit("x"), T.StringType(), F.lit(NOW), "other")


def test_validation_of_histories(spark):
    def validated(text):
        found = spark.createDataFrame([(text,)], "c string").select(legacy.validated(F.col("c"), F.lit(NOW))).first()[0]
        return [tuple(e) for e in found]

    assert validated('[{"date":"2020-01-01T10:11:12.5","value":null},{"date":"2020-01-02","value":"7"},"bare",8]') == [("2020-01-01 10:11:12", "NULL"), ("2020-01-02 00:00:00", "7"), (NOW, "bare"), (NOW, "8")]
    assert validated(None) == [] and validated("[]") == []
    for bad in ('[{"date":"soon","value":"x"}]', '[[{"date":"2020-01-01","value":"x"}]]', '[{"date":"2020-13-01 00:00:00","value":"x"}]'):
        with pytest.raises(Exception, match="history"):
            validated(bad)


def test_table_of_text_says_that_there_is_more(spark, capsys, monkeypatch):
    from chronocell import cli

    monkeypatch.setattr(cli, "SHOWN", 3)
    cli._show(spark.range(3).toDF("x"), False)
    assert "rows;" not in capsys.readouterr().out
    cli._show(spark.range(5).toDF("x"), False)
    assert "the first 3 of 5 rows" in capsys.readouterr().out


def test_filters_and_keys(spark):
    from chronocell.operators import diff, filters

    rows = spark.createDataFrame([("a", 1, 3, False), ("ab", None, 9, True), ("b", 5, 0, False)], "id string, n long, changes long, deleted boolean")
    assert {r["id"] for r in rows.where(filters.simple("n", least=1, most=4)).collect()} == {"a"}
    assert {r["id"] for r in rows.where(filters.simple(id_contains="a", min_changes=4, deleted=True)).collect()} == {"ab"}
    assert {r["id"] for r in filters.with_nulls(rows, "id").collect()} == {"ab"} == {r["id"] for r in filters.with_nulls(rows, "id", "n").collect()}
    twice = rows.unionByName(rows.where("id = 'b'").withColumn("n", rows["n"] - 4))
    assert [tuple(r) for r in diff.duplicate_keys(twice, ["id"]).collect()] == [("b", 2)]
    assert {(r["id"], r["n"]) for r in diff.keep_first(twice, ["id"], ["n"]).collect()} == {("a", 1), ("ab", None), ("b", 1)}
    for text in ("no_such > 1", "n >"):
        try:
            filters.where(rows, text)
            raise AssertionError(text)
        except filters.BadFilter:
            pass
