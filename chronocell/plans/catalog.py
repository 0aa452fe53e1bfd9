"""The registered queries of the change-history engine and their SQL.

``elog`` reads the table ``events`` as a change log; A, B and C are three snapshots made of
``orders`` (see ``inputs``).  Each query is one or two operators on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocell.operators import diff, filters, log
from chronocell.plans import audits, flows, stores, workload
from chronocell.plans.inputs import ELOG, FIELDS, SNAPS, T0, T1, elog, snapshot, snapshot_log
from chronocell.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def ntz(text: str):
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


def _view_sql(where: str, live: bool = True, extra: str = "") -> str:
    keep = "WHERE last_field <> '__deleted__'" if live else ""
    cells = ", ".join(f"max(CASE WHEN field = '{f}' AND rn = 1 THEN value END) AS {f if f != 'view' else 'view_value'}" for f in FIELDS)
    return f"""WITH {ELOG},
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, field ORDER BY timestamp DESC, seq DESC) AS rn,
             first_value(field) OVER (PARTITION BY entity_id ORDER BY timestamp DESC, seq DESC) AS last_field,
             min(CASE WHEN field = '__deleted__' THEN timestamp END) OVER (PARTITION BY entity_id) AS d0,
             max(CASE WHEN field <> '__deleted__' THEN timestamp END) OVER (PARTITION BY entity_id) AS s1
      FROM e WHERE {where})
SELECT entity_id{extra}, {cells} FROM r {keep} GROUP BY entity_id{", last_field, d0, s1" if extra else ""}"""


STATE_SQL = ", CASE WHEN last_field = '__deleted__' THEN 'deleted' ELSE 'active' END AS state, coalesce(s1 > d0, false) AS resurrected"


def _named(view: DataFrame) -> DataFrame:
    return view.withColumnRenamed("view", "view_value")


@query(_view_sql(f"timestamp <= TIMESTAMP '{T1}'"))
def asof_mirror_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(log.mirror_view(elog(spark, sf_dir), FIELDS, ntz(T1)))


@query(_view_sql("true"))
def mirror_view_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(log.mirror_view(elog(spark, sf_dir), FIELDS))


@query(_view_sql("timestamp <= TIMESTAMP '2000-01-01'"))
def mirror_view_before_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(log.mirror_view(elog(spark, sf_dir), FIELDS, ntz("2000-01-01")))


@query(_view_sql(f"timestamp <= TIMESTAMP '{T1}'", live=False, extra=STATE_SQL))
def temporal_view_with_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(log.temporal_view(elog(spark, sf_dir), FIELDS, ntz(T1)))


@query(f"WITH {ELOG} SELECT timestamp AS date, value FROM e WHERE entity_id = '7' AND field = 'click' AND timestamp <= TIMESTAMP '{T1}' ORDER BY timestamp DESC, seq DESC LIMIT 1")
def asof_cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.as_of(elog(spark, sf_dir), "7", "click", ntz(T1))


@query(f"""WITH {ELOG},
p AS (SELECT c_custkey AS probe_id, CAST(c_custkey % 150 AS VARCHAR) AS entity_id, CASE WHEN c_custkey % 2 = 0 THEN 'click' ELSE 'view' END AS field,
             TIMESTAMP '{T0}' + to_days(CAST(c_custkey % 10 AS INTEGER)) AS instant FROM customer),
h AS (SELECT probe_id, timestamp, value, row_number() OVER (PARTITION BY probe_id ORDER BY timestamp DESC, seq DESC) AS rn
      FROM p JOIN e USING (entity_id, field) WHERE timestamp <= instant)
SELECT p.probe_id, entity_id, field, timestamp AS date, value FROM p LEFT JOIN h ON h.probe_id = p.probe_id AND rn = 1""")
def asof_batch_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    probes = table(spark, sf_dir, "customer").select(
        key.alias("probe_id"),
        (key % 150).cast("string").alias("entity_id"),
        F.when(key % 2 == 0, "click").otherwise("view").alias("field"),
        (ntz(T0) + F.make_dt_interval((key % 10).cast("int"))).alias("instant"),
    )
    return log.as_of_probes(elog(spark, sf_dir), probes)


@query(f"WITH {ELOG} SELECT timestamp AS date, value FROM e WHERE entity_id = '7' AND field = 'view'")
def cell_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.timeline(elog(spark, sf_dir), "7", "view")


@query(f"WITH {ELOG} SELECT timestamp AS date, field, value FROM e WHERE entity_id = '7'")
def entity_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.timeline(elog(spark, sf_dir), "7")


def _state_sql(where: str) -> str:
    return f"""WITH {ELOG},
s AS (SELECT entity_id, arg_max(field, timestamp) AS last_field, min(CASE WHEN field = '__deleted__' THEN timestamp END) AS d0,
             max(CASE WHEN field <> '__deleted__' THEN timestamp END) AS s1 FROM e WHERE {where} GROUP BY entity_id)
SELECT entity_id{STATE_SQL} FROM s"""


@query(_state_sql("timestamp <= TIMESTAMP '2024-01-03'"))
def row_state_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.row_states(elog(spark, sf_dir), ntz("2024-01-03"))


@query(_state_sql("true"))
def row_state_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.row_states(elog(spark, sf_dir))


@query(f"""WITH {ELOG} SELECT DISTINCT entity_id FROM e WHERE entity_id NOT IN (SELECT entity_id FROM e WHERE timestamp <= TIMESTAMP '2024-01-01 06:00:00')""")
def unborn_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elog(spark, sf_dir)
    return log.row_states(e, ntz("2024-01-01 06:00:00"), e).where("state = 'unborn'").select("entity_id")


@query(f"WITH {ELOG} SELECT entity_id, count(*) AS changes, count(*) FILTER (WHERE field <> '__deleted__') AS set_changes FROM e GROUP BY entity_id")
def change_count_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.change_counts(elog(spark, sf_dir))


@query(f"""WITH {ELOG},
live AS (SELECT entity_id FROM e GROUP BY entity_id HAVING arg_max(field, timestamp) <> '__deleted__'),
c AS (SELECT count(*) AS cells FROM (SELECT DISTINCT entity_id, field FROM e WHERE field <> '__deleted__' AND entity_id IN (SELECT entity_id FROM live))),
n AS (SELECT count(*) AS events FROM e WHERE field <> '__deleted__')
SELECT cells, events, CASE WHEN cells > 0 THEN round(events * 100.0 / cells, 6) ELSE 0.0 END::DOUBLE AS percent_changed FROM c, n""")
def change_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = log.change_statistics(elog(spark, sf_dir))
    return out.withColumn("percent_changed", F.col("percent_changed").cast("double"))


@query(f"WITH {ELOG} SELECT DISTINCT timestamp FROM e")
def snap_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.snap_points(elog(spark, sf_dir))


@query(f"""WITH {ELOG} SELECT max(timestamp) FILTER (WHERE timestamp < TIMESTAMP '{T1}') AS previous, min(timestamp) FILTER (WHERE timestamp > TIMESTAMP '{T1}') AS next,
max(timestamp) FILTER (WHERE timestamp <= TIMESTAMP '{T1}') AS at, (SELECT timestamp FROM e ORDER BY abs(epoch_us(timestamp) - epoch_us(TIMESTAMP '{T1}')), timestamp LIMIT 1) AS nearest FROM e""")
def nearest_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.nearest_snaps(elog(spark, sf_dir), ntz(T1))


@query(f"""WITH {ELOG}, u AS (SELECT epoch_us(timestamp) AS us FROM e), s AS (SELECT min(us) AS lo, max(us) AS hi FROM u),
c AS (SELECT least(59, (us - lo) * 60 // greatest(hi - lo, 1))::INT AS bucket, count(*) AS n FROM u, s GROUP BY 1)
SELECT b.bucket::INT AS bucket, coalesce(n, 0) AS changes FROM (SELECT unnest(range(60)) AS bucket) b LEFT JOIN c ON b.bucket = c.bucket""")
def density_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.density(elog(spark, sf_dir), 60)


@query(f"WITH {ELOG} SELECT CAST(timestamp AS DATE) AS day, count(*) AS changes FROM e GROUP BY 1")
def density_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.density_by_day(elog(spark, sf_dir))


@query(f"WITH {ELOG} SELECT entity_id, min(timestamp) AS first_seen FROM e GROUP BY 1")
def entity_order_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.first_seen(elog(spark, sf_dir))


@query(f"""WITH {ELOG}, c AS (SELECT entity_id, field, count(*) AS changes FROM e WHERE field <> '__deleted__' GROUP BY 1, 2)
SELECT *, CASE WHEN changes >= 8 THEN 'v4' WHEN changes >= 5 THEN 'v3' WHEN changes >= 3 THEN 'v2' ELSE 'v1' END AS heat FROM c""")
def cell_frequency_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.cell_frequencies(elog(spark, sf_dir))


@query(f"WITH {ELOG} SELECT entity_id, count(*) FILTER (WHERE field IN ('click', 'view')) AS changes FROM e WHERE timestamp <= TIMESTAMP '{T1}' GROUP BY 1")
def row_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.row_frequencies(elog(spark, sf_dir), ["click", "view"], ntz(T1))


DIRECTION_SQL = "CASE WHEN {b} IS NULL OR value IS NULL THEN 'na' WHEN value > {b} THEN 'up' WHEN value < {b} THEN 'down' ELSE 'same' END AS direction, value - {b} AS delta"


@query(f"""WITH {ELOG}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, field ORDER BY timestamp DESC, seq DESC) AS rn,
lag(value) OVER (PARTITION BY entity_id, field ORDER BY timestamp, seq) AS ghost FROM e WHERE field <> '__deleted__' AND timestamp <= TIMESTAMP '{T1}')
SELECT entity_id, field, value, ghost, {DIRECTION_SQL.format(b="ghost")} FROM r WHERE rn = 1""")
def ghost_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.ghosts(elog(spark, sf_dir), ntz(T1))


@query(f"""WITH {ELOG}, r AS (SELECT *, lag(value) OVER (PARTITION BY entity_id, field ORDER BY timestamp, seq) AS before FROM e WHERE field <> '__deleted__')
SELECT entity_id, field, timestamp, value, before, {DIRECTION_SQL.format(b="before")} FROM r""")
def direction_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.changes_with_direction(elog(spark, sf_dir))


@query(f"""WITH {ELOG}, p AS (SELECT entity_id, row_number() OVER w - 1 AS pos,
CASE WHEN field = '__deleted__' THEN 'deleted' WHEN lag(field) OVER w = '__deleted__' THEN 'resurrected' ELSE 'active' END AS kind
FROM e WINDOW w AS (PARTITION BY entity_id ORDER BY timestamp, seq)),
s AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY entity_id ORDER BY pos) IS DISTINCT FROM kind THEN 1 ELSE 0 END AS starts FROM p),
g AS (SELECT *, sum(starts) OVER (PARTITION BY entity_id ORDER BY pos) AS segment FROM s)
SELECT entity_id, segment::BIGINT AS segment, min(kind) AS kind, min(pos) AS first, max(pos) AS last FROM g GROUP BY 1, 2""")
def lifecycle_spark_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.spark_segments(elog(spark, sf_dir))


@query(f"""WITH {ELOG}, p AS (SELECT *, lag(field) OVER (PARTITION BY entity_id ORDER BY timestamp, seq) AS before FROM e)
SELECT entity_id, timestamp, field FROM p WHERE before = '__deleted__' AND field <> '__deleted__'""")
def resurrection_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.resurrections(elog(spark, sf_dir))


@query(f"""WITH {ELOG}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, field ORDER BY timestamp DESC, seq DESC) AS place,
count(*) OVER (PARTITION BY entity_id, field) AS total FROM e WHERE field <> '__deleted__')
SELECT entity_id, field, timestamp, value, place, greatest(total - 3, 0) AS earlier FROM r WHERE place <= 3""")
def peek_last3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.peek(elog(spark, sf_dir), 3)


#: Changes of the write-once column ``o_orderstatus`` in the log of the three snapshots.
VIOLATIONS = f"""{SNAPS}, v AS (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS place FROM slog WHERE field = 'o_orderstatus'
WINDOW w AS (PARTITION BY entity_id ORDER BY timestamp)),
bad AS (SELECT entity_id, field, timestamp, before, value AS after FROM v WHERE place > 1 AND value IS DISTINCT FROM before)"""


@query(f"WITH {VIOLATIONS} SELECT * FROM bad")
def immutable_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.violations(snapshot_log(spark, sf_dir), ["o_orderstatus"])


@query(f"WITH {VIOLATIONS} SELECT DISTINCT entity_id FROM bad WHERE timestamp <= TIMESTAMP '2026-01-02'")
def violating_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = log.violations(log.until(snapshot_log(spark, sf_dir), ntz("2026-01-02")), ["o_orderstatus"])
    return bad.select("entity_id").distinct()


@query(f"""WITH {VIOLATIONS}, n AS (SELECT entity_id, count(*) FILTER (WHERE field <> '__deleted__') AS changes, min(timestamp) AS seen FROM slog GROUP BY 1),
calm AS (SELECT * FROM n WHERE changes > 0 AND entity_id NOT IN (SELECT entity_id FROM bad) ORDER BY changes DESC, seen, entity_id LIMIT 3)
SELECT entity_id, 'violation' AS kind, changes FROM n WHERE entity_id IN (SELECT entity_id FROM bad)
UNION ALL SELECT entity_id, 'volatile', changes FROM calm""")
def callouts_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.callouts(snapshot_log(spark, sf_dir), ["o_orderstatus"])


@query(f"""WITH {VIOLATIONS}, s AS (SELECT entity_id, arg_max(field, timestamp) AS last_field, min(CASE WHEN field = '__deleted__' THEN timestamp END) AS d0,
max(CASE WHEN field <> '__deleted__' THEN timestamp END) AS s1 FROM slog GROUP BY 1)
SELECT count(*) AS entities, count(*) FILTER (WHERE last_field = '__deleted__') AS deleted, count(*) FILTER (WHERE s1 > d0) AS resurrected,
(SELECT count(*) FROM slog) AS events, (SELECT count(DISTINCT entity_id) FROM bad) AS flagged FROM s""")
def kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.kpis(snapshot_log(spark, sf_dir), ["o_orderstatus"])


@query(f"""WITH {ELOG}, r AS (SELECT entity_id, field, arg_max(value, timestamp) FILTER (WHERE timestamp <= TIMESTAMP '{T0}') AS before, arg_max(value, timestamp) AS after
FROM e WHERE field <> '__deleted__' AND timestamp <= TIMESTAMP '{T1}' GROUP BY 1, 2) SELECT * FROM r WHERE before IS DISTINCT FROM after""")
def scrub_diff_t0_t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.scrub_diff(elog(spark, sf_dir), FIELDS, ntz(T0), ntz(T1))


@query(f"WITH {SNAPS} SELECT entity_id, field, value FROM ab")
def keyed_diff_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_events(snapshot(spark, sf_dir, "A"), snapshot(spark, sf_dir, "B"), "o_orderkey")


@query(f"WITH {SNAPS} SELECT entity_id, field, value FROM ab WHERE entity_id NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM a) AND field <> '__deleted__'")
def insert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = diff.classed_events(snapshot(spark, sf_dir, "A"), snapshot(spark, sf_dir, "B"), "o_orderkey")
    return events.where("kind = 'insert'").drop("kind")


@query(f"WITH {SNAPS} SELECT entity_id FROM ab WHERE field = '__deleted__'")
def delete_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_diff_events(spark, sf_dir).where(log.is_deletion()).select("entity_id")


@query(f"WITH {SNAPS} SELECT entity_id, field, value FROM ab WHERE entity_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM a) AND field <> '__deleted__'")
def update_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = diff.classed_events(snapshot(spark, sf_dir, "A"), snapshot(spark, sf_dir, "B"), "o_orderkey")
    return events.where("kind = 'update'").drop("kind")


@query(f"WITH {SNAPS} SELECT entity_id, field, value, timestamp, seq FROM slog")
def three_capture_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_log(spark, sf_dir)


@query(f"WITH {SNAPS} SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, 'total_cents' AS field, CAST(NULL AS VARCHAR) AS value FROM b WHERE total_cents IS NOT NULL")
def column_drop_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.tombstones(snapshot(spark, sf_dir, "B"), "o_orderkey", ["total_cents"])


@query(f"""WITH {SNAPS} SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, 'cents' AS field, CAST(total_cents AS VARCHAR) AS value FROM b WHERE total_cents IS NOT NULL
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'total_cents', NULL FROM b WHERE total_cents IS NOT NULL""")
def column_rename_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = snapshot(spark, sf_dir, "B")
    return diff.diff_events(b, b.withColumnRenamed("total_cents", "cents"), "o_orderkey")


CLASSES = f"""{SNAPS}, k AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
CASE WHEN a.o_orderkey IS NULL THEN 'ADD' WHEN b.o_orderkey IS NULL THEN 'DROP'
     WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.total_cents IS DISTINCT FROM b.total_cents OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'CHG' ELSE 'SAME' END AS change
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)"""


@query(f"""WITH {CLASSES} SELECT count(*) FILTER (WHERE change <> 'ADD') AS n_before, count(*) FILTER (WHERE change <> 'DROP') AS n_after, count(*) FILTER (WHERE change = 'ADD') AS added,
count(*) FILTER (WHERE change = 'DROP') AS dropped, count(*) FILTER (WHERE change = 'CHG') AS changed, count(*) FILTER (WHERE change = 'SAME') AS unchanged FROM k""")
def ab_compare_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.compare_counts(snapshot(spark, sf_dir, "A"), snapshot(spark, sf_dir, "B"), "o_orderkey")


@query(f"WITH {CLASSES} SELECT o_orderkey, change FROM k")
def ab_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.classify(snapshot(spark, sf_dir, "A"), snapshot(spark, sf_dir, "B"), "o_orderkey")


@query("""WITH a AS (SELECT conv_id || '|' || turn AS row_key, role, text FROM conversations WHERE conv_id % 5 <> 0),
b AS (SELECT conv_id || '|' || turn AS row_key, role, CASE WHEN turn = 1 THEN upper(role) ELSE text END AS text FROM conversations WHERE conv_id % 7 <> 0)
SELECT coalesce(a.row_key, b.row_key) AS row_key, CASE WHEN a.row_key IS NULL THEN 'ADD' WHEN b.row_key IS NULL THEN 'DROP'
WHEN a.text IS DISTINCT FROM b.text OR a.role IS DISTINCT FROM b.role THEN 'CHG' ELSE 'SAME' END AS change FROM a FULL JOIN b ON a.row_key = b.row_key""")
def composite_key_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("row_key", diff.composite_key(["conv_id", "turn"]))
    before = rows.where("conv_id % 5 <> 0").select("row_key", "role", "text")
    after = rows.where("conv_id % 7 <> 0").select("row_key", "role", F.when(F.col("turn") == 1, F.upper("role")).otherwise(F.col("text")).alias("text"))
    return diff.classify(before, after, "row_key")


@query(f"WITH {SNAPS} SELECT * FROM b WHERE o_orderstatus = 'X'")
def view_filter_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.equals(snapshot(spark, sf_dir, "B"), {"o_orderstatus": "X", "no_such_column": 1})


@query(f"""WITH {ELOG}, c AS (SELECT entity_id, count(*) FILTER (WHERE field <> '__deleted__') AS changes, arg_max(field, timestamp) = '__deleted__' AS deleted,
arg_max(value, timestamp) FILTER (WHERE field = 'click') AS click FROM e GROUP BY 1) SELECT entity_id, changes, click FROM c WHERE NOT deleted AND changes > 20 AND click > 10""")
def view_filter_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.filter_rows(elog(spark, sf_dir), ["click"])
    return filters.where(rows, "NOT deleted AND changes > 20 AND click > 10").select(F.col("id").alias("entity_id"), "changes", "click")


@query(f"""WITH {ELOG}, c AS (SELECT entity_id, count(*) FILTER (WHERE field <> '__deleted__') AS changes, arg_max(field, timestamp) = '__deleted__' AS deleted FROM e GROUP BY 1)
SELECT entity_id FROM c WHERE entity_id LIKE '%1%' AND changes >= 10 AND deleted""")
def view_filter_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.filter_rows(elog(spark, sf_dir), ["click"])
    return rows.where(filters.simple(id_contains="1", min_changes=10, deleted=True)).select(F.col("id").alias("entity_id"))


@query(f"WITH {SNAPS} SELECT * FROM b WHERE o_orderstatus IS NULL OR total_cents IS NULL OR o_orderpriority IS NULL")
def null_rows_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.with_nulls(snapshot(spark, sf_dir, "B"), "o_orderkey")


@query(f"WITH {SNAPS} SELECT * FROM b WHERE total_cents IS NULL")
def null_rows_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.with_nulls(snapshot(spark, sf_dir, "B"), "o_orderkey", "total_cents")


@query(f"""WITH {ELOG}, keep AS (SELECT entity_id FROM e WHERE field <> '__deleted__' GROUP BY 1 HAVING count(*) > 20),
r AS (SELECT entity_id, arg_max(field, timestamp) AS last_field, arg_max(value, timestamp) FILTER (WHERE field = 'click') AS click FROM e WHERE timestamp <= TIMESTAMP '{T1}' GROUP BY 1)
SELECT entity_id, click FROM r WHERE last_field <> '__deleted__' AND entity_id IN (SELECT entity_id FROM keep)""")
def stable_filter_then_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elog(spark, sf_dir)
    ids = filters.where(filters.filter_rows(e, []), "changes > 20").select(F.col("id").alias("entity_id"))
    return log.mirror_view(e, ["click"], ntz(T1)).join(ids, "entity_id", "left_semi")


@query(f"WITH {ELOG} SELECT timestamp, entity_id, field, seq FROM e WHERE (timestamp, entity_id, field, seq) > (TIMESTAMP '{T1}', '', '', 0) ORDER BY 1, 2, 3, 4 LIMIT 25")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.key_page(elog(spark, sf_dir), (ntz(T1), "", "", 0), 25).select("timestamp", "entity_id", "field", "seq")


@query(f"""WITH {SNAPS}, v AS (SELECT DISTINCT field, value FROM slog WHERE field <> '__deleted__' AND value IS NOT NULL)
SELECT field, string_agg(value, ',' ORDER BY value) AS choices FROM v GROUP BY field HAVING count(*) <= 40""")
def distinct_low_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.low_cardinality_values(snapshot_log(spark, sf_dir)).withColumn("choices", F.array_join("choices", ","))


#: Events by type, with the type's name as the value of a field that is called as the lifecycle is.
STATE_LOG = """s AS (SELECT CAST(user_id AS VARCHAR) AS entity_id, ts AS timestamp, event_id AS seq, CASE WHEN event_type = 'error' THEN '__deleted__' ELSE 'state' END AS field,
CASE WHEN event_type <> 'error' THEN event_type END AS value FROM events)"""


def _state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("entity_id"), F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"), F.when(error, log.DELETED).otherwise("state").alias("field"), F.when(~error, F.col("event_type")).alias("value"))


@query(f"""WITH {STATE_LOG}, c AS (SELECT entity_id, count(*) FILTER (WHERE field = 'state') AS changes, arg_max(field, timestamp) = '__deleted__' AS deleted,
arg_max(value, timestamp) FILTER (WHERE field = 'state') AS state FROM s GROUP BY 1) SELECT entity_id, state, changes FROM c WHERE NOT deleted AND state = 'view'""")
def view_filter_field_named_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field named as the lifecycle's column is filtered as any other."""
    rows = filters.filter_rows(_state_log(spark, sf_dir), ["state"])
    return filters.where(rows, "NOT deleted AND state = 'view'").select(F.col("id").alias("entity_id"), "state", "changes")


@query(f"WITH {SNAPS} SELECT o_orderkey, o_orderstatus, total_cents, o_orderpriority FROM b WHERE o_orderpriority LIKE '%H%' AND total_cents % 7 = 3")
def view_filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain functions of values as filters of columns, one of which has nulls; a condition of a column stays one."""
    return filters.equals(snapshot(spark, sf_dir, "B"), {"total_cents": lambda v: int(v) % 7 == 3, "o_orderpriority": lambda v: "H" in str(v) and v[0].isdigit(), "o_orderkey": lambda c: c >= 0, "absent": 1})


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return diff.keep_first(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query(f"WITH {ELOG} SELECT DISTINCT entity_id FROM (SELECT entity_id, field FROM e WHERE field <> '__deleted__' GROUP BY 1, 2 HAVING count(*) > 1)")
def multi_entry_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.cell_frequencies(elog(spark, sf_dir)).where("changes > 1").select("entity_id").distinct()


@query(f"WITH {CLASSES} SELECT o_orderkey FROM k WHERE change = 'CHG'")
def snapshot_row_changed_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.changed_keys(snapshot(spark, sf_dir, "A"), snapshot(spark, sf_dir, "B"), "o_orderkey")


LATEST_SQL = f"""{ELOG}, o AS (SELECT *, row_number() OVER (PARTITION BY entity_id, field ORDER BY timestamp DESC, seq DESC) AS rn FROM e WHERE field <> '__deleted__' AND timestamp <= TIMESTAMP '{T1}'),
latest AS (SELECT entity_id, field, timestamp, value FROM o WHERE rn = 1)"""


@query(f"WITH {LATEST_SQL} SELECT * FROM latest")
def latest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.latest_cells(elog(spark, sf_dir), ntz(T1))


@query(f"WITH {LATEST_SQL} SELECT *, arg_max(field, timestamp) OVER (PARTITION BY entity_id) AS last_field FROM latest")
def latest_by_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.latest_by_row_number(elog(spark, sf_dir), ntz(T1))


#: A log of many columns: a part's place among them is the field of its supplier.
WIDE_FIELDS = [f"p{k:02d}" for k in range(64)]
WLOG = """w AS (SELECT CAST(l_suppkey AS VARCHAR) AS entity_id, l_shipdate AS timestamp, l_orderkey * 10 + l_linenumber AS seq,
'p' || lpad(CAST(l_partkey % 64 AS VARCHAR), 2, '0') AS field, l_quantity AS value FROM lineitem)"""


def wide_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("entity_id"),
        F.col("l_shipdate").alias("timestamp"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.concat(F.lit("p"), F.lpad((F.col("l_partkey") % 64).cast("string"), 2, "0")).alias("field"),
        F.col("l_quantity").alias("value"),
    )


def _wide_sql() -> str:
    cells = ", ".join(f"max(value) FILTER (WHERE field = '{f}') AS {f}" for f in WIDE_FIELDS)
    return f"WITH {WLOG}, c AS (SELECT entity_id, field, value FROM w QUALIFY row_number() OVER (PARTITION BY entity_id, field ORDER BY timestamp DESC, seq DESC) = 1) SELECT entity_id, {cells} FROM c GROUP BY 1"


@query(_wide_sql())
def wide_mirror_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view of 64 columns."""
    return log.mirror_view(wide_log(spark, sf_dir), WIDE_FIELDS)


for part in (workload, audits, stores, flows):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
