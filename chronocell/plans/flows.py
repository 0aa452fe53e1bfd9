"""Queries that go through sinks, readers and streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocell.operators import filters
from chronocell.plans.inputs import SNAPS, snapshot
from chronocell.plans.stores import DAYS, captured
from chronocell.sources import exports, snapshots
from chronocell.sources.scratch import Scratch
from chronocell.sources.store import Store
from chronocell.sources.tables import table
from chronocell.streaming import lifecycle, live

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def streamed(spark: SparkSession, rows: DataFrame, mode: str = "append", scratch: Scratch | None = None) -> DataFrame:
    """What a stream gives until nothing is left to read, with the ``batch`` of each row; the last batch alone in mode ``complete``.

    With the ``scratch`` of an earlier call it goes on where that ended.
    """
    scratch = Scratch(spark, "stream") if scratch is None else scratch
    out = scratch.folder("out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    running = rows.writeStream.outputMode(mode).option("checkpointLocation", scratch.folder("checkpoint")).trigger(availableNow=True).foreachBatch(keep).start()
    running.awaitTermination()
    return spark.read.schema(rows.schema.add("batch", "long")).parquet(out)


B_ROWS = f"WITH {SNAPS} SELECT o_orderkey, o_orderstatus, total_cents, o_orderpriority FROM b"


@query(B_ROWS)
def exported_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view of the store written as Parquet and read as a snapshot; that form goes before CSV."""
    folder = Scratch(spark, "export").folder
    view = captured(spark, sf_dir).view(DAYS[1])
    return snapshots.load(spark, exports.export(view, parquet=folder("b.parquet"), csv=folder("b.csv")))


@query(B_ROWS)
def exported_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = captured(spark, sf_dir).view(DAYS[1])
    rows = snapshots.load(spark, exports.export(view, "csv", csv=Scratch(spark, "export").folder("b.csv")))
    return rows.withColumn("o_orderkey", F.col("o_orderkey").cast("long")).withColumn("total_cents", F.col("total_cents").cast("long"))


@query(f"WITH {SNAPS} SELECT o_orderkey, o_orderstatus, total_cents, o_orderpriority FROM a UNION ALL SELECT o_orderkey, o_orderstatus, total_cents, o_orderpriority FROM c")
def catalog_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view saved as a table, another appended, read back by name."""
    store = captured(spark, sf_dir)
    scratch = Scratch(spark, "table")
    name = "chronocell_" + scratch.root.rpartition("-")[2]
    for day, append in ((DAYS[0], False), (DAYS[2], True)):
        exports.save_table(store.view(day), name, append, path=scratch.folder("rows"))
    return snapshots.from_catalog(spark, name)


@query(f"WITH {SNAPS} SELECT to_json({{'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus, 'total_cents': total_cents, 'o_orderpriority': o_orderpriority}})::VARCHAR AS record FROM b")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.json_records(captured(spark, sf_dir).view(DAYS[1]))


@query(f"WITH {SNAPS} SELECT o_orderkey, o_orderstatus, total_cents, o_orderpriority FROM b WHERE o_orderpriority LIKE '_-%H' OR o_orderpriority ILIKE '%urg%' AND o_orderstatus NOT LIKE 'X%' AND total_cents BETWEEN 100 AND 20000000 AND o_orderkey NOT IN (1, 2, 3)")
def filter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions as text over a typed view: LIKE in its forms, BETWEEN, IN."""
    text = "o_orderpriority LIKE '_-%H' OR o_orderpriority ILIKE '%urg%' AND o_orderstatus NOT LIKE 'X%' AND total_cents BETWEEN 100 AND 20000000 AND o_orderkey NOT IN (1, 2, 3)"
    return filters.where(captured(spark, sf_dir).view(DAYS[1]), text)


@query(f"WITH {SNAPS} SELECT o_orderkey, o_orderstatus, total_cents, o_orderpriority FROM b WHERE total_cents IS NULL")
def store_nulls_at_range_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls in a column as of the end of a range of instants."""
    return captured(spark, sf_dir).with_nulls("total_cents", (DAYS[0], DAYS[1]))


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM orders WHERE o_orderkey % 17 <> 0)
SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, field, value, seq FROM (
  SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS value, 0 AS seq FROM o UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority, 0 FROM o
  UNION ALL SELECT o_orderkey, 'o_orderpriority', NULL, 1 FROM o UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS VARCHAR), 1 FROM o)""")
def store_column_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that goes leaves a null for each of its live cells, one that comes its values."""
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 17 <> 0")
    store = Store(spark, Scratch(spark, "drift").folder("orders.cells"))
    store.capture(rows.select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey", DAYS[0])
    store.capture(rows.select("o_orderkey", "o_orderstatus", "o_custkey"), "o_orderkey", DAYS[1])
    return store.events().select("entity_id", "field", "value", "seq")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 'moved' ELSE o_orderpriority END AS new_priority, o_orderpriority FROM orders WHERE o_orderkey % 17 <> 0)
SELECT o_orderkey, o_orderstatus, NULL::VARCHAR AS o_orderpriority, new_priority FROM o""")
def store_view_of_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of all columns ever: one that went is null now."""
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 17 <> 0")
    store = Store(spark, Scratch(spark, "columns").folder("orders.cells"))
    store.capture(rows.select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey", DAYS[0])
    moved = F.when(F.col("o_orderkey") % 3 == 0, "moved").otherwise(F.col("o_orderpriority")).alias("new_priority")
    store.capture(rows.select("o_orderkey", "o_orderstatus", moved), "o_orderkey", DAYS[1])
    return store.view()


@query(f"WITH {SNAPS} SELECT entity_id, field, value, seq FROM slog")
def stream_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed captures as a stream, one a batch."""
    return streamed(spark, live.captures(spark, captured(spark, sf_dir).path)).select("entity_id", "field", "value", "seq")


@query(f"WITH {SNAPS} SELECT timestamp AS start, count(*) AS changes, count(*) FILTER (WHERE field = '__deleted__') AS deletions FROM slog GROUP BY 1")
def stream_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes a day of the stream of captures."""
    days = streamed(spark, live.density(live.captures(spark, captured(spark, sf_dir).path)), "complete")
    return days.select(F.to_utc_timestamp("start", F.current_timezone()).cast("timestamp_ntz").alias("start"), "changes", "deletions")


@query(f"WITH {SNAPS} SELECT entity_id, field, seq FROM slog")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in which every event comes twice, each kept once."""
    events = live.captures(spark, captured(spark, sf_dir).path)
    return streamed(spark, live.once(events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))))).select("entity_id", "field", "seq")


@query(f"""WITH {SNAPS}, s AS (SELECT entity_id, arg_max(field, seq) AS last_field, min(CASE WHEN field = '__deleted__' THEN seq END) AS d0, max(CASE WHEN field <> '__deleted__' THEN seq END) AS s1 FROM slog GROUP BY 1),
v AS (SELECT entity_id, arg_max(coalesce(value, 'null'), seq) AS status FROM slog WHERE field = 'o_orderstatus' GROUP BY 1)
SELECT entity_id, CASE WHEN last_field = '__deleted__' THEN 'deleted' ELSE 'active' END AS state, coalesce(s1 > d0, false) AS resurrected, status FROM s LEFT JOIN v USING (entity_id)""")
def stream_row_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's state and a last cell after all captures, from state that is kept from start to start."""
    scratch = Scratch(spark, "states")
    store = Store(spark, scratch.folder("orders.cells"))
    for day, name in zip(DAYS, "ABC", strict=True):
        store.capture(snapshot(spark, sf_dir, name), "o_orderkey", day)
        states = lifecycle.row_states(live.captures(spark, store.path), fields=list(store.fields()))
        told = states.select("entity_id", "state", "resurrected", F.coalesce(F.col("cells")["o_orderstatus"], F.lit("null")).alias("status"))
        rows = streamed(spark, told, "update", scratch)
    last = rows.groupBy("entity_id").agg(F.max_by(F.struct("state", "resurrected", "status"), "batch").alias("r"))
    return last.select("entity_id", "r.state", "r.resurrected", "r.status")


@query(f"WITH {SNAPS} SELECT entity_id, field, value, seq FROM slog")
def stream_capture_on_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that arrive in a folder are captured by a stream; each start takes what is new."""
    scratch = Scratch(spark, "arrivals")
    store = Store(spark, scratch.folder("orders.cells"))
    arrived, take = scratch.folder("in"), live.capture_batches(store, "o_orderkey", lambda n: DAYS[n])
    for name in "ABC":
        rows = snapshot(spark, sf_dir, name)
        rows.write.mode("append").parquet(arrived)
        running = spark.readStream.schema(rows.schema).parquet(arrived).writeStream.foreachBatch(take).option("checkpointLocation", scratch.folder("checkpoint")).trigger(availableNow=True).start()
        running.awaitTermination()
    return store.events().select("entity_id", "field", "value", "seq")


@query(f"WITH {SNAPS} SELECT entity_id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field ORDER BY seq DESC) AS rn FROM slog WHERE field <> '__deleted__') WHERE rn = 1")
def stream_latest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = streamed(spark, live.latest_cells(live.captures(spark, captured(spark, sf_dir).path)), "complete")
    return cells.select("entity_id", "field", "value")
