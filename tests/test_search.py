"""Pattern joins, deep slices, sketches: against plain Python and without the plans that they replace."""

import random

import pytest
from pyspark.sql import functions as F

from chronocell.operators import audit, log
from chronocell.operators.positions import position_join


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("gram", [1, 2, 3])
def test_positions_equal_search_of_all_pairs(spark, gram):
    rng = random.Random(gram)
    texts = ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "", "abcabc", "abcabc", "🙂ab🙂"]
    patterns = ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 5))) for _ in range(40)] + [None, "", "a", "ab", "ab", "🙂", "b🙂", "zzz"]
    left = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    right = spark.createDataFrame(list(enumerate(patterns)), "j int, pattern string")
    want = sorted((i, j, t.index(p) + 1) for i, t in enumerate(texts) for j, p in enumerate(patterns) if t and p and p in t)
    got = position_join(left, "text", right, "pattern", gram)
    assert sorted(tuple(r) for r in got.select("i", "j", "position").collect()) == want
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert position_join(left.limit(0), "text", right, "pattern", gram).count() == position_join(left, "text", right.limit(0), "pattern", gram).count() == 0


def test_deep_slices_equal_offsets(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([None, 1, 1, 2, 3, 3, 3]), rng.choice("xyz")) for i in range(400)]
    table = spark.createDataFrame(data, "id int, part int, x string").repartition(7)
    for state in (("part", "asc"), ("part", "desc"), None):
        whole = [tuple(r) for r in audit.sorted_rows(table, state, ["x", "id"]).collect()]
        deep = audit.SortedRows(table, state, ["x", "id"], 12)
        for first, n in ((0, 5), (137, 30), (395, 30), (400, 3), (1000, 1), (0, 400)):
            assert [tuple(r) for r in deep.slice(first, n).collect()] == whole[first : first + n]
        assert len(deep.parts_of(200, 10)[0]) <= 2


def test_fields_at_the_limit_of_distinct_values(spark):
    log_rows = [(f"e{i}", i, f"f{n}", i % n if i % 5 else None) for n in (1, 3, 4, 5, 2000) for i in range(2000 if n > 100 else 60)]
    table = spark.createDataFrame(log_rows, "entity_id string, at long, field string, value long").withColumn("timestamp", F.timestamp_seconds("at"))
    want = {}
    for _, _, f, v in log_rows:
        if v is not None:
            want.setdefault(f, set()).add(v)
    want = {f: sorted(v) for f, v in want.items() if len(v) <= 4}
    assert {r["field"]: r["choices"] for r in log.low_cardinality_values(table, 4).collect()} == want
    halves = log.field_sketches(table.where("at < 30")).unionByName(log.field_sketches(table.where("at >= 30")))
    assert {r["field"]: r["choices"] for r in log.low_cardinality_values(table, 4, halves).collect()} == want


def test_page_after_a_cursor_reaches_the_files(spark, tmp_path):
    table = spark.range(100).select(F.timestamp_seconds("id").alias("timestamp"), F.concat(F.lit("e"), F.col("id") % 7).alias("entity_id"), F.lit("f").alias("field"), F.lit(1).alias("value"), F.col("id").cast("int").alias("seq"))
    table.write.parquet(f"{tmp_path}/log")
    stored = spark.read.parquet(f"{tmp_path}/log")
    after = tuple(stored.where("seq = 42").select(*log.page_keys(stored)).first())
    page = log.key_page(stored, after, 10)
    assert [r["seq"] for r in page.collect()] == list(range(43, 53))
    assert "GreaterThanOrEqual(timestamp" in page._jdf.queryExecution().toString()
