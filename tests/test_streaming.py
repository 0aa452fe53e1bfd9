import datetime as dt

from pyspark.sql import functions as F

from chronocell.operators import log
from chronocell.sources.store import Store
from chronocell.streaming import live


def drained(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_stream_of_captures(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/t.cells")
    for k, data in enumerate([[(1, "a"), (2, "b")], [(1, "A")], [(1, "A"), (2, "c")]]):
        store.capture(spark.createDataFrame(data, "id long, x string"), "id", dt.datetime(2026, 1, 1 + k))
    events = live.tail(spark, store.path, files_a_batch=1)

    def into(df, name, mode):
        return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()

    drained(into(live.latest_cells(events), "cells", "complete"))
    expected = log.latest_cells(store.events()).collect()
    assert sorted(spark.table("cells").collect()) == sorted(expected)
    drained(into(live.density(events), "days", "complete"))
    assert [tuple(r) for r in spark.table("days").orderBy("start").select("changes", "deletions").collect()] == [(2, 0), (2, 1), (1, 0)]
    drained(into(live.once(events), "once", "append"))
    assert spark.table("once").count() == store.events().count()


def test_capture_of_arriving_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    rows.where("id = 1").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/t.cells")
    each = live.capture_batches(store, "id", lambda n: dt.datetime(2026, 1, 1 + n))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drained(stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start())
    assert store.info()["files"] == 2
    assert store.events().where(F.col("field") == log.DELETED).count() <= 1
    each(rows.where("id = 1"), 1)
    assert store.info()["files"] == 2
