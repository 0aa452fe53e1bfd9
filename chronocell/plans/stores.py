"""Queries over a store on disk: snapshots captured for real, then read back, and their SQL.

Snapshots A, B and C of ``inputs`` are captured on three days into a store among the scratch
tables, with a checkpoint after B; a session makes it once for each folder of tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocell.functions import codec
from chronocell.operators import log
from chronocell.plans.inputs import SNAPS, snapshot
from chronocell.sources.scratch import Scratch
from chronocell.sources.store import Store
from chronocell.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}
DAYS = [dt.datetime(2026, 1, d, tzinfo=dt.UTC) for d in (1, 2, 3)]
_made: dict[tuple[str, str], Store] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def captured(spark: SparkSession, sf_dir: str) -> Store:
    made = (spark.sparkContext.applicationId, sf_dir)
    if made not in _made:
        store = Store(spark, Scratch(spark, "store").folder("orders.cells"))
        for day, name in zip(DAYS, "ABC", strict=True):
            store.capture(snapshot(spark, sf_dir, name), "o_orderkey", day)
            if name == "B":
                store.checkpoint()
        _made[made] = store
    return _made[made]


@query(f"WITH {SNAPS} SELECT o_orderkey, o_orderstatus, total_cents, o_orderpriority FROM a")
def store_view_before_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view that no checkpoint is old enough for."""
    return captured(spark, sf_dir).view(DAYS[0])


@query(f"WITH {SNAPS} SELECT entity_id, field, arg_max(value, seq) AS value, max(seq) AS seq FROM (SELECT entity_id, field, coalesce(value, 'null') AS value, seq FROM slog WHERE seq < 2) GROUP BY 1, 2")
def store_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checkpoint after B holds: the last event of every cell."""
    rows = captured(spark, sf_dir).latest(DAYS[1])
    return rows.select("entity_id", "field", F.coalesce("value", F.lit("null")).alias("value"), "seq")


@query(f"WITH {SNAPS} SELECT o_orderkey, o_orderstatus, total_cents, o_orderpriority FROM b")
def store_view_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured(spark, sf_dir).view(DAYS[1] + dt.timedelta(hours=5))


@query(f"WITH {SNAPS} SELECT o_orderkey, o_orderstatus, total_cents, o_orderpriority FROM c")
def store_view_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured(spark, sf_dir).view()


@query(f"""WITH {SNAPS} SELECT entity_id, timestamp, field, value, CASE field WHEN '__deleted__' THEN 'null' WHEN 'total_cents' THEN 'int64' ELSE 'utf8' END AS dtype, seq FROM slog""")
def store_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = captured(spark, sf_dir).events()
    return events.select("entity_id", F.to_utc_timestamp("timestamp", F.current_timezone()).cast("timestamp_ntz").alias("timestamp"), "field", "value", "dtype", "seq")


@query(f"WITH {SNAPS} SELECT seq, count(*) AS row_count, strftime(min(timestamp), '%Y-%m-%dT%H:%M:%S+00:00') AS ts_min, strftime(max(timestamp), '%Y-%m-%dT%H:%M:%S+00:00') AS ts_max FROM slog WHERE timestamp <= TIMESTAMP '2026-01-02' GROUP BY 1")
def store_files_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = captured(spark, sf_dir).files(DAYS[1])
    return spark.createDataFrame([(f["seq"], f["row_count"], f["ts_min"], f["ts_max"]) for f in files], "seq int, row_count long, ts_min string, ts_max string")


@query(f"""WITH {SNAPS}, f AS (SELECT seq, min(epoch_us(timestamp)) AS us, count(*) AS n FROM slog GROUP BY 1), span AS (SELECT min(us) AS lo, max(us) AS hi FROM f),
per AS (SELECT least(59, (us - lo) * 60 // greatest(hi - lo, 1)) AS bucket, sum(n) AS n FROM f, span GROUP BY 1)
SELECT b::INTEGER AS bucket, coalesce(n, 0)::BIGINT AS changes FROM range(60) AS r(b) LEFT JOIN per ON per.bucket = b""")
def store_file_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density from the manifest's entries alone."""
    files = [(dt.datetime.fromisoformat(f["ts_min"]), dt.datetime.fromisoformat(f["ts_max"]), f["row_count"]) for f in captured(spark, sf_dir).files()]
    return log.file_density(spark.createDataFrame(files, "ts_min timestamp, ts_max timestamp, row_count long"))


@query(f"WITH {SNAPS} SELECT 3::BIGINT AS files, 3::BIGINT AS snapshots, count(*) AS events, 4::BIGINT AS columns, 'o_orderkey' AS key_column FROM slog")
def store_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = captured(spark, sf_dir).info()
    return spark.createDataFrame([(i["files"], i["snapshots"], i["events"], i["columns"], i["key_column"])], "files long, snapshots long, events long, columns long, key_column string")


@query(f"""WITH {SNAPS}, s AS (SELECT entity_id, arg_max(field, seq) AS last_field, min(CASE WHEN field = '__deleted__' THEN seq END) AS d0, max(CASE WHEN field <> '__deleted__' THEN seq END) AS s1 FROM slog GROUP BY 1)
SELECT entity_id, CASE WHEN last_field = '__deleted__' THEN 'deleted' ELSE 'active' END AS state, coalesce(s1 > d0, false) AS resurrected FROM s""")
def store_row_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the checkpoint's summary and the events after it."""
    return captured(spark, sf_dir).row_states()


@query(f"WITH {SNAPS} SELECT entity_id, count(*) AS changes, count(*) FILTER (WHERE field <> '__deleted__') AS set_changes FROM slog GROUP BY 1")
def store_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured(spark, sf_dir).change_counts()


@query(f"""WITH {SNAPS}, s AS (SELECT entity_id, count(*) AS events, arg_max(field, seq) = '__deleted__' AS gone, min(CASE WHEN field = '__deleted__' THEN seq END) AS d0, max(CASE WHEN field <> '__deleted__' THEN seq END) AS s1,
count(DISTINCT coalesce(value, 'null')) FILTER (WHERE field = 'o_orderstatus') > 1 AS flagged FROM slog GROUP BY 1)
SELECT count(*) AS entities, count(*) FILTER (WHERE gone) AS deleted, count(*) FILTER (WHERE s1 > d0) AS resurrected, sum(events)::BIGINT AS events, count(*) FILTER (WHERE flagged) AS flagged FROM s""")
def store_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured(spark, sf_dir).kpis(["o_orderstatus"])


@query(f"WITH {SNAPS} SELECT entity_id, field, value, seq FROM slog WHERE entity_id IN ('35', '77', '1001', 'none')")
def store_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some entities' events from the files that may hold them."""
    store = captured(spark, sf_dir)
    store.index()
    return store.events_of(["35", "77", "1001", "none"]).select("entity_id", "field", "value", "seq")


@query(f"WITH {SNAPS} SELECT entity_id, field, value, k::INTEGER AS seq FROM za, range(3) AS r(k) WHERE k <> 1 UNION ALL SELECT entity_id, '__deleted__', NULL, 1 FROM (SELECT DISTINCT entity_id FROM za)")
def store_equal_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table, an empty one and the table again, all captured at one instant: each event has its own capture's place."""
    store = Store(spark, Scratch(spark, "equal").folder("orders.cells"))
    a = snapshot(spark, sf_dir, "A")
    for rows in (a, a.limit(0), a):
        store.capture(rows, "o_orderkey", DAYS[0], idempotency="latest")
    return store.events().select("entity_id", "field", "value", "seq")


@query(f"WITH {SNAPS} SELECT field, value, seq FROM slog WHERE entity_id = '35'")
def store_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity's history through the store's own order of captures."""
    events = captured(spark, sf_dir).events().where(F.col("entity_id") == "35")
    return events.select("field", "value", "seq")


@query("SELECT true AS same_if_shuffled, true AS noop_again, true AS differs_from_b, 16::BIGINT AS digits")
def store_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of A over other partitions and column orders, a repeated capture, and B."""

    def digest(rows: DataFrame) -> str:
        text = rows.select(*[codec.encoded(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields])
        return codec.snapshot_digest(text, "o_orderkey")

    a, b = snapshot(spark, sf_dir, "A"), snapshot(spark, sf_dir, "B")
    first, again = digest(a), digest(a.select(*reversed(a.columns)).repartition(7))
    own = Store(spark, Scratch(spark, "digest").folder("orders.cells"))
    own.capture(a, "o_orderkey", DAYS[0])
    noop = own.capture(a, "o_orderkey", DAYS[2])
    return spark.createDataFrame([(first == again, noop["noop"] and noop["snapshot_id"] == first, first != digest(b), len(first))], "same_if_shuffled boolean, noop_again boolean, differs_from_b boolean, digits long")


@query("SELECT o_orderkey, o_totalprice, o_orderdate::TIMESTAMP AS o_orderdate, o_orderkey % 2 = 0 AS even, o_orderpriority, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 1000000000 END AS small, o_totalprice * 1e14 AS large FROM orders")
def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type to its canonical text and back."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"),
        (F.col("o_orderkey") % 2 == 0).alias("even"),
        "o_orderpriority",
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") / 1000000000).alias("small"),
        (F.col("o_totalprice") * F.lit(1e14)).alias("large"),
    )
    text = rows.select(*[codec.encoded(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields])
    back = text.select(*[codec.decoded(F.col(f.name), codec.tag(f.dataType)).alias(f.name) for f in rows.schema.fields])
    return back.withColumn("o_orderdate", F.to_utc_timestamp("o_orderdate", F.current_timezone()).cast("timestamp_ntz"))


@query("""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key_text, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS date_text, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS even_text,
CAST((o_orderkey % 100) / 1000000.0 AS VARCHAR) AS small_text, CAST(CAST(o_orderkey * 10000000 + 0.5 AS DOUBLE) AS VARCHAR) AS large_text FROM orders""")
def codec_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = {f.name: f.dataType for f in table(spark, sf_dir, "orders").schema.fields}
    rows = table(spark, sf_dir, "orders").withColumn("small", (F.col("o_orderkey") % 100) / F.lit(1000000.0)).withColumn("large", (F.col("o_orderkey") * 10000000 + 0.5).cast("double"))
    kind |= {f.name: f.dataType for f in rows.schema.fields}
    text = {"key_text": "o_orderkey", "date_text": "o_orderdate", "small_text": "small", "large_text": "large"}
    even = codec.encoded(F.col("o_orderkey") % 2 == 0, rows.select(F.lit(True)).schema[0].dataType).alias("even_text")
    return rows.select("o_orderkey", *[codec.encoded(F.col(c), kind[c]).alias(n) for n, c in text.items()], even)
