"""Queries of audit views, paging, sorting and display, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocell.functions import display
from chronocell.operators import audit, log
from chronocell.plans.inputs import ELOG, FIELDS, SNAPS, T0, T1, elog, snapshot_log
from chronocell.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def ntz(text: str):
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


def _audit_sql(where: str) -> str:
    return f"""{ELOG}, t AS (SELECT * FROM e WHERE {where}),
s AS (SELECT entity_id, min(timestamp) AS first_seen, arg_max(field, timestamp) AS last_field, min(CASE WHEN field = '__deleted__' THEN timestamp END) AS d0,
             max(CASE WHEN field <> '__deleted__' THEN timestamp END) AS s1, count(*) FILTER (WHERE field <> '__deleted__') AS changes FROM t GROUP BY 1),
v AS (SELECT entity_id, value, lag(value) OVER w AS before, row_number() OVER w AS place FROM e WHERE field = 'signup' WINDOW w AS (PARTITION BY entity_id ORDER BY timestamp, seq)),
bad AS (SELECT DISTINCT entity_id FROM v WHERE place > 1 AND value IS DISTINCT FROM before),
audit AS (SELECT s.entity_id, first_seen, CASE WHEN last_field = '__deleted__' THEN 'deleted' ELSE 'active' END AS state, coalesce(s1 > d0, false) AS resurrected,
                 s.entity_id IN (SELECT entity_id FROM bad) AS flagged, changes FROM s)"""


@query(f"WITH {_audit_sql(f"timestamp <= TIMESTAMP '{T1}'")} SELECT entity_id, first_seen, state, resurrected, flagged, changes FROM audit")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_view(elog(spark, sf_dir), FIELDS, ["signup"], ntz(T1)).drop("cells", "spark")


@query(f"""WITH {ELOG}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, field ORDER BY timestamp DESC, seq DESC) AS rn, count(*) OVER (PARTITION BY entity_id, field) AS changes,
lag(value) OVER (PARTITION BY entity_id, field ORDER BY timestamp, seq) AS ghost FROM e WHERE field <> '__deleted__' AND timestamp <= TIMESTAMP '{T1}'),
g AS (SELECT i.entity_id, f.field FROM (SELECT DISTINCT entity_id FROM e WHERE timestamp <= TIMESTAMP '{T1}') i, (SELECT unnest(['click', 'purchase', 'signup', 'view']) AS field) f)
SELECT g.entity_id, g.field, value, ghost, CASE WHEN changes IS NULL OR changes < 2 THEN NULL WHEN ghost IS NULL OR value IS NULL THEN 'na' WHEN value > ghost THEN 'up' WHEN value < ghost THEN 'down' ELSE 'same' END AS direction,
coalesce(changes, 0) AS changes FROM g LEFT JOIN r ON r.entity_id = g.entity_id AND r.field = g.field AND rn = 1""")
def audit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.audit_view(elog(spark, sf_dir), FIELDS, instant=ntz(T1))
    return rows.select("entity_id", F.inline("cells"))


@query(f"""WITH {ELOG}, p AS (SELECT entity_id, row_number() OVER w - 1 AS pos,
CASE WHEN field = '__deleted__' THEN 'deleted' WHEN lag(field) OVER w = '__deleted__' THEN 'resurrected' ELSE 'active' END AS kind
FROM e WHERE timestamp <= TIMESTAMP '{T1}' WINDOW w AS (PARTITION BY entity_id ORDER BY timestamp, seq)),
s AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY entity_id ORDER BY pos) IS DISTINCT FROM kind THEN 1 ELSE 0 END AS starts FROM p),
g AS (SELECT *, sum(starts) OVER (PARTITION BY entity_id ORDER BY pos) AS segment FROM s)
SELECT entity_id, segment::BIGINT AS segment, min(kind) AS kind, min(pos) AS first, max(pos) AS last FROM g GROUP BY 1, 2""")
def audit_spark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.audit_view(elog(spark, sf_dir), FIELDS, instant=ntz(T1))
    return rows.select("entity_id", F.inline("spark"))


@query(f"""WITH {_audit_sql("true")}, n AS (SELECT count(*) AS total_rows FROM audit)
SELECT entity_id, state, changes, total_rows, total_rows > 100 AS capped FROM audit, n ORDER BY first_seen, entity_id LIMIT 100""")
def audit_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.audit_view(elog(spark, sf_dir), FIELDS, ["signup"])
    return audit.capped(rows, ["first_seen", "entity_id"], 100).select("entity_id", "state", "changes", "total_rows", "capped")


def _view_sql() -> str:
    cells = ", ".join(f"arg_max(value, timestamp) FILTER (WHERE field = '{f}') AS {'view_value' if f == 'view' else f}" for f in FIELDS)
    return f"{ELOG}, m AS (SELECT entity_id, min(timestamp) AS first_seen, {cells} FROM e GROUP BY 1 HAVING arg_max(field, timestamp) <> '__deleted__')"


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elog(spark, sf_dir)
    view = log.mirror_view(e, FIELDS).withColumnRenamed("view", "view_value")
    return view.join(log.first_seen(e), "entity_id")


@query(f"WITH {_view_sql()} SELECT entity_id, click, row_number() OVER (ORDER BY click DESC NULLS LAST, first_seen, entity_id) - 1 AS place FROM m ORDER BY place LIMIT 30 OFFSET 20")
def sorted_slice_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = audit.next_sort(audit.next_sort(None, "click"), "click")
    rows = audit.slice_rows(audit.sorted_rows(_view(spark, sf_dir), state, ["first_seen", "entity_id"]), 0, 50)
    # The place is told from the order of the slice itself.
    packed = rows.groupBy().agg(F.collect_list(F.struct("entity_id", "click")).alias("r"))
    placed = packed.select(F.posexplode("r").alias("place", "c")).select("c.entity_id", "c.click", F.col("place").cast("long").alias("place"))
    return placed.where("place >= 20")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey LIMIT 500 OFFSET (SELECT count(*) * 3 // 5 FROM lineitem)")
def sorted_slice_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice deep in a sort, from the parts that it lies in."""
    rows = table(spark, sf_dir, "lineitem")
    ordered = audit.SortedRows(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), ("l_extendedprice", "desc"), ["l_orderkey", "l_linenumber", "l_partkey"], 50)
    return ordered.slice(rows.count() * 3 // 5, 500).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(f"WITH {_view_sql()} SELECT entity_id, signup FROM m ORDER BY signup ASC NULLS LAST, first_seen, entity_id LIMIT 40 OFFSET 10")
def sorted_slice_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.sorted_rows(_view(spark, sf_dir), audit.next_sort(("click", "desc"), "signup"), ["first_seen", "entity_id"])
    return audit.slice_rows(rows, 10, 40).select("entity_id", "signup")


@query(f"WITH {_view_sql()} SELECT entity_id, first_seen FROM m ORDER BY first_seen, entity_id LIMIT 25")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.sorted_rows(_view(spark, sf_dir), audit.next_sort(("click", "desc"), "click"), ["first_seen", "entity_id"])
    return audit.slice_rows(rows, 0, 25).select("entity_id", "first_seen")


@query(f"""WITH {SNAPS}, s AS (SELECT o_orderkey, 0 AS at FROM a UNION ALL SELECT o_orderkey, 1 FROM b)
SELECT CAST(coalesce(a.o_orderkey, b.o_orderkey) AS VARCHAR) AS entity_id, CASE WHEN a.o_orderkey IS NULL THEN 'ADD' WHEN b.o_orderkey IS NULL THEN 'DROP'
WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.total_cents IS DISTINCT FROM b.total_cents OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'CHG' ELSE 'SAME' END AS change
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def ab_by_lifecycle_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["o_orderpriority", "o_orderstatus", "total_cents"]
    return audit.compare_by_state(snapshot_log(spark, sf_dir), fields, ntz("2026-01-01"), ntz("2026-01-02"))


@query(f"""WITH {SNAPS} SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, '{{"o_orderstatus":' || coalesce('"' || o_orderstatus || '"', 'null') || ',"total_cents":' || coalesce('"' || total_cents || '"', 'null') || '}}' AS document FROM b""")
def historical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = log.mirror_view(snapshot_log(spark, sf_dir), ["o_orderstatus", "total_cents"], ntz("2026-01-02"))
    return audit.as_documents(view, "entity_id")


@query(f"""WITH {ELOG}, f AS (SELECT epoch_us(min(timestamp)) AS lo_us, epoch_us(max(timestamp)) AS hi_us, count(*) AS n FROM e GROUP BY CAST(timestamp AS DATE)),
s AS (SELECT min(lo_us) AS lo, max(hi_us) AS hi FROM f), c AS (SELECT least(11, (lo_us - lo) * 12 // greatest(hi - lo, 1))::INT AS bucket, sum(n) AS n FROM f, s GROUP BY 1)
SELECT b.bucket::INT AS bucket, coalesce(n, 0)::BIGINT AS changes FROM (SELECT unnest(range(12)) AS bucket) b LEFT JOIN c ON b.bucket = c.bucket""")
def file_density_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density from files alone, a day's events standing for a file."""
    files = elog(spark, sf_dir).groupBy(F.to_date("timestamp").alias("day")).agg(F.min("timestamp").alias("ts_min"), F.max("timestamp").alias("ts_max"), F.count(F.lit(1)).alias("row_count"))
    return log.file_density(files, 12)


@query(f"WITH {ELOG} SELECT entity_id, timestamp, field, value FROM e WHERE entity_id IN ('3', '7', '11')")
def window_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.of_entities(elog(spark, sf_dir), ["3", "7", "11"]).select("entity_id", "timestamp", "field", "value")


@query(f"WITH {ELOG} SELECT entity_id, timestamp, field, timestamp > TIMESTAMP '{T1}' AS future FROM e WHERE entity_id = '7'")
def now_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = log.of_entities(elog(spark, sf_dir), ["7"])
    return log.with_future(own, ntz(T1)).select("entity_id", "timestamp", "field", "future")


@query(f"WITH {ELOG} SELECT timestamp, entity_id, field, seq FROM e WHERE (timestamp, entity_id, field, seq) > (TIMESTAMP '{T1}', '', '', 0) AND entity_id IN ('3', '7', '11') AND field IN ('click', 'view') ORDER BY 1, 2, 3, 4 LIMIT 10")
def keyset_page_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = log.key_page(elog(spark, sf_dir), (ntz(T1), "", "", 0), 10, ["3", "7", "11"], ["click", "view"])
    return page.select("timestamp", "entity_id", "field", "seq")


def _ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to the day, so that many share time, entity and field and only ``seq`` tells them apart."""
    return elog(spark, sf_dir).withColumn("timestamp", F.date_trunc("day", "timestamp").cast("timestamp_ntz"))


@query(f"WITH {ELOG}, d AS (SELECT date_trunc('day', timestamp) AS timestamp, entity_id, field, seq FROM e), p AS (SELECT * FROM d ORDER BY 1, 2, 3, 4 LIMIT 7 OFFSET 7) SELECT * FROM p")
def keyset_second_page_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page through the first page's own cursor."""
    e = _ties(spark, sf_dir)
    c = log.next_cursor(log.key_page(e, None, 7)).first()
    return log.key_page(e, tuple(c), 7).select("timestamp", "entity_id", "field", "seq")


@query(f"WITH {ELOG}, d AS (SELECT date_trunc('day', timestamp) AS timestamp, entity_id, field, seq FROM e), p AS (SELECT * FROM d ORDER BY 1, 2, 3, 4 LIMIT 7) SELECT * FROM p ORDER BY 1 DESC, 2 DESC, 3 DESC, 4 DESC LIMIT 1")
def keyset_next_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.next_cursor(log.key_page(_ties(spark, sf_dir), None, 7))


@query("""SELECT o_orderkey, coalesce(CAST(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS VARCHAR), 'ø') AS key_text, strftime(o_orderdate, '%Y-%m-%d') AS day_text,
CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS even_text,
CASE WHEN o_custkey - o_orderkey < 0 THEN '-' ELSE '+' END || CAST(abs(o_custkey - o_orderkey) AS VARCHAR) AS delta_text,
CASE WHEN o_orderkey // 3600 > 0 THEN (o_orderkey // 3600) || 'h ' || (o_orderkey // 60 % 60) || 'm ' || (o_orderkey % 60) || 's'
     WHEN o_orderkey // 60 > 0 THEN (o_orderkey // 60) || 'm ' || (o_orderkey % 60) || 's' ELSE o_orderkey || 's' END AS took FROM orders""")
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("k", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey"))).withColumn("even", F.col("o_orderkey") % 2 == 0)
    kind = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(
        "o_orderkey",
        display.shown(F.col("k"), kind["k"]).alias("key_text"),
        display.shown(F.col("o_orderdate"), kind["o_orderdate"]).alias("day_text"),
        display.shown(F.col("even"), kind["even"]).alias("even_text"),
        display.shown_delta(F.col("o_custkey") - F.col("o_orderkey")).alias("delta_text"),
        display.runtime(F.col("o_orderkey")).alias("took"),
    )


@query(f"""WITH {ELOG}, c AS (SELECT CAST(timestamp AS DATE) AS day, count(*) AS n, min(timestamp) AS t FROM e GROUP BY 1), m AS (SELECT max(n) AS most, min(epoch_us(t)) AS lo, max(epoch_us(t)) AS hi FROM c)
SELECT day, round(CASE WHEN n > 0 THEN 0.16 + 0.72 * (n / most) ELSE 0 END, 9)::DOUBLE AS opacity, round(greatest(0, least(100, (epoch_us(t) - lo) / greatest(hi - lo, 1) * 100)), 9)::DOUBLE AS along,
strftime(t, '%Y-%m-%dT%H:%M:%S.%gZ') AS stamp FROM c, m""")
def density_opacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = elog(spark, sf_dir).groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("t")).withColumn("us", log.micros("t"))
    both = days.crossJoin(F.broadcast(days.agg(F.max("n").alias("most"), F.min("us").alias("lo"), F.max("us").alias("hi"))))
    return both.select("day", F.round(display.opacity(F.col("n"), F.col("most")), 9).alias("opacity"), F.round(display.percent_along(F.col("us"), F.col("lo"), F.col("hi")), 9).alias("along"), display.stamp_ms(F.col("t")).alias("stamp"))
