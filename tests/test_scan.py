import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronocell.operators import log as L
from chronocell.operators import scan


@pytest.fixture(params=[3, 1000])
def small(request, monkeypatch):
    monkeypatch.setattr(scan, "ROWS", request.param)
    monkeypatch.setattr(scan, "SMALL", 0)


def made(spark, n, hot_share=0.9, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        entity = "hot" if rng.random() < hot_share else rng.choice(["a", "b", None, "c"])
        field = rng.choice(["x", "x", "x", "y", L.DELETED])
        rows.append((entity, rng.randrange(n), field, None if field == L.DELETED else rng.choice([None, 1, 2, 3]), k))
    return spark.createDataFrame(rows, "entity_id string, at long, field string, value long, seq int").withColumn("timestamp", F.timestamp_seconds("at")).drop("at")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_scan_equals_windows(spark, small):
    log = made(spark, 300)
    o = [F.col("timestamp"), F.col("seq")]
    w = Window.partitionBy("entity_id").orderBy(*o)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = log.select("*", F.lag("value").over(w).alias("p1"), F.lag("value", 2).over(w).alias("p2"), F.last("value", True).over(upto).alias("f"), F.sum("value").over(upto).alias("s"))
    want = want.withColumn("s", F.coalesce("s", F.lit(0)))
    got = scan.Scan(log, ["entity_id"], o).add(previous={"p1": (F.col("value"), 1), "p2": (F.col("value"), 2)}, filled={"f": F.col("value")}, sums={"s": F.col("value")}).rows()
    got = got.withColumn("s", F.coalesce("s", F.lit(0)))
    assert rows_of(got.select(*want.columns)) == rows_of(want)


def questions(log, probes):
    return [rows_of(df) for df in (L.spark_segments(log), L.resurrections(log), L.changes_with_direction(log), L.violations(log, ["x", "y"]), L.as_of_probes(log, probes))]


def test_answers_are_the_same_with_hot_keys(spark, small, monkeypatch):
    log = made(spark, 250, seed=2)
    probes = log.select(F.monotonically_increasing_id().alias("probe_id"), "entity_id", "field", F.timestamp_seconds(F.col("seq") + 1).alias("instant")).unionByName(
        log.limit(3).select(F.lit(-1).cast("long").alias("probe_id"), "entity_id", "field", F.lit(None).cast("timestamp").alias("instant"))
    )
    split = questions(log, probes)
    monkeypatch.setattr(scan, "SMALL", 1 << 40)
    assert split == questions(log, probes)


def test_hot_key_is_spread_over_tasks(spark, monkeypatch):
    """One key has nine tenths of a million events; no task has more than a few stretches of it."""
    monkeypatch.setattr(scan, "ROWS", 20_000)
    monkeypatch.setattr(scan, "SMALL", 0)
    n = 1_000_000
    log = spark.range(n).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("e"), F.col("id") % 5000)).alias("entity_id"), F.when(F.col("id") % 97 == 0, L.DELETED).otherwise("x").alias("field"), F.col("id").alias("value"), F.timestamp_seconds("id").alias("timestamp"), F.lit(0).alias("seq"))
    s = scan.Scan(log, ["entity_id"], [L.order(log)])
    ranges = s.hot.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(ranges) >= 45 and max(r["n"] for r in ranges) <= 20_000
    out = s.add(sums={"pos": F.lit(1)})
    tasks = out.hot.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(tasks) > 1 and max(r["n"] for r in tasks) < 0.6 * n
    assert out.rows().where("entity_id = 'hot'").agg(F.max("pos"), F.count_distinct("pos")).first()[:] == (900_000, 900_000)
