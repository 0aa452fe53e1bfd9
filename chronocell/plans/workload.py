"""Relational queries of the kinds that feed snapshots: semi and anti joins, lists, rollups, one-hot columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronocell.functions import legacy
from chronocell.operators.positions import position_join
from chronocell.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND lower(o.o_orderstatus) = 'f')")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where(F.lower("o_orderstatus") == "f")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return customers.join(done, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O')")
def anti_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    still = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return table(spark, sf_dir, "customer").select("c_custkey").join(still, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""WITH l AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',') AS list FROM orders GROUP BY 1)
SELECT o_custkey, p FROM l, (SELECT unnest(['URGENT', 'HIGH', 'LOW', 'I', '4-NOT']) AS p) WHERE position(p IN list) > 0""")
def theta_position_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a few given texts occur anywhere in a comma list: searched for in each list, one pass over the lists."""
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_set("o_orderpriority"), ",").alias("list"))
    wanted = F.array(*[F.lit(p) for p in ("URGENT", "HIGH", "LOW", "I", "4-NOT")])
    return lists.select("o_custkey", F.explode(F.filter(wanted, lambda p: F.position(p, F.col("list")) > 0)).alias("p"))


_PATTERNS = """SELECT DISTINCT pattern FROM (SELECT left(p_type, 1) AS pattern FROM part UNION ALL SELECT right(p_name, 2) FROM part UNION ALL SELECT p_brand FROM part
UNION ALL SELECT split_part(p_name, ' ', 1) FROM part UNION ALL SELECT left(p_brand, 7) || ' ' || left(p_type, 2) FROM part UNION ALL SELECT '')"""


@query(f"""WITH t AS (SELECT p_partkey, p_name || '|' || p_brand || ' ' || p_type AS text FROM part), w AS ({_PATTERNS})
SELECT p_partkey, pattern, position(pattern IN text) AS position FROM t JOIN w ON pattern <> '' AND position(pattern IN text) > 0""")
def position_join_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where patterns of one, two and many letters occur in descriptions; both sides are tables."""
    part = table(spark, sf_dir, "part")
    texts = part.select("p_partkey", F.concat("p_name", F.lit("|"), "p_brand", F.lit(" "), "p_type").alias("text"))
    some = F.array(F.left("p_type", F.lit(1)), F.right("p_name", F.lit(2)), F.col("p_brand"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.concat(F.left("p_brand", F.lit(7)), F.lit(" "), F.left("p_type", F.lit(2))), F.lit(""))
    patterns = part.select(F.explode(some).alias("pattern")).distinct()
    return position_join(texts, "text", patterns, "pattern").select("p_partkey", "pattern", F.col("position").cast("long").alias("position"))


@query("""WITH dim(code, name) AS (VALUES ('1-URGENT', 'now'), ('2-HIGH', 'soon'), ('3-MEDIUM', 'later')),
l AS (SELECT o_custkey, o_orderpriority AS code, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, string_agg(coalesce(name, 'unknown'), ', ' ORDER BY code) AS names FROM l LEFT JOIN dim USING (code) GROUP BY 1""")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a comma list by their names, unknown ones marked: split, looked up, joined again."""
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("codes"))
    names = F.create_map(*[F.lit(x) for pair in (("1-URGENT", "now"), ("2-HIGH", "soon"), ("3-MEDIUM", "later")) for x in pair])
    return lists.select("o_custkey", F.array_join(F.transform(F.split("codes", ","), lambda c: F.coalesce(F.try_element_at(names, c), F.lit("unknown"))), ", ").alias("names"))


@query("""SELECT l_orderkey, l_linenumber, sn.n_name AS supplier_nation, cn.n_name AS customer_nation, sr.r_name AS supplier_region FROM lineitem
LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey LEFT JOIN region sr ON sn.n_regionkey = sr.r_regionkey
LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey""")
def role_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dimension in two roles of a row, each by a left join of its own."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("supplier_region"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    owner = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("l_orderkey"), "c_nationkey")
    rows = lines.join(supplier, "l_suppkey", "left").join(owner, "l_orderkey", "left")
    of_supplier = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation"), F.col("n_regionkey").alias("r_regionkey"))
    of_customer = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation"))
    rows = rows.join(of_supplier, "s_nationkey", "left").join(region, "r_regionkey", "left").join(of_customer, "c_nationkey", "left")
    return rows.select("l_orderkey", "l_linenumber", "supplier_nation", "customer_nation", "supplier_region")


@query("""SELECT o_orderkey, coalesce(contains(lower(CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END), 'urgent'), false) AS urgent,
CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) END AS days
FROM orders WHERE upper(o_orderstatus) IN ('F', 'O') AND (o_orderkey % 13 = 0) IS FALSE""")
def lenient_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are not deleted, of some states in any case; a search without case; dates that may not be dates."""
    rows = table(spark, sf_dir, "orders").withColumn("deleted_at", F.when(F.col("o_orderkey") % 13 == 0, F.col("o_orderdate")))
    rows = rows.where(F.col("deleted_at").isNull() & F.upper("o_orderstatus").isin("F", "O"))
    priority = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority"))
    text = F.when(F.col("o_orderkey") % 3 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    day = F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))
    return rows.select("o_orderkey", F.coalesce(F.lower(priority).contains("urgent"), F.lit(False)).alias("urgent"), day.alias("day"), F.datediff(day, F.lit("1995-01-01").cast("date")).cast("long").alias("days"))


@query("""WITH t AS (SELECT date_trunc('week', DATE '1996-07-04')::DATE AS monday)
SELECT o_orderkey FROM orders, t WHERE CAST(o_orderdate AS DATE) BETWEEN monday - 7 AND monday - 1 OR o_orderkey % 50 = 0 AND (CASE WHEN o_orderkey % 100 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END IS NULL OR CAST(o_orderdate AS DATE) >= monday)""")
def previous_week_or_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the week before a day's week, and of some the ones without a date or later than that."""
    monday = F.trunc(F.lit("1996-07-04").cast("date"), "week")
    day = F.to_date("o_orderdate")
    closed = F.when(F.col("o_orderkey") % 100 != 0, day)
    before = day.between(F.date_sub(monday, 7), F.date_sub(monday, 1))
    open_or_later = (F.col("o_orderkey") % 50 == 0) & (closed.isNull() | (closed >= monday))
    return table(spark, sf_dir, "orders").where(before | open_or_later).select("o_orderkey")


@query("SELECT upper(c_mktsegment) AS segment, count(*) AS n FROM customer GROUP BY 1")
def sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source given as SQL over views of the tables."""
    return spark.sql("SELECT upper(c_mktsegment) AS segment, count(*) AS n FROM {customer} GROUP BY 1", customer=table(spark, sf_dir, "customer"))


@query("SELECT range AS id, lpad(CAST(range AS VARCHAR), 6, '0') AS name FROM range(1, 11)")
def generated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 11).select("id", F.lpad(F.col("id").cast("string"), 6, "0").alias("name"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def listagg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(sets.alias("priorities"))


@query("""SELECT o_custkey, min(CASE WHEN f = 1 THEN o_orderkey END) AS first_order, min(CASE WHEN l = 1 THEN o_orderkey END) AS last_order FROM (
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS l FROM orders) GROUP BY 1""")
def first_last_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(by)["o_orderkey"].alias("first_order"), F.max(by)["o_orderkey"].alias("last_order"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Billed' WHEN o_totalprice > 300000 THEN 'Disagree' WHEN o_orderstatus = 'P' THEN 'Pending' ELSE 'Ignored' END AS status,
(o_orderpriority = '1-URGENT')::INT AS is_urgent, (o_orderpriority = '5-LOW')::INT AS is_low, CAST(o_orderdate AS DATE) + 7 AS due, date_trunc('week', o_orderdate)::DATE AS week FROM orders""")
def status_case_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Billed").when(F.col("o_totalprice") > 300000, "Disagree").when(F.col("o_orderstatus") == "P", "Pending").otherwise("Ignored")
    hot = [(F.col("o_orderpriority") == p).cast("int").alias(n) for p, n in (("1-URGENT", "is_urgent"), ("5-LOW", "is_low"))]
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), *hot, F.date_add(day, 7).alias("due"), F.trunc(day, "week").alias("week"))


@query("""SELECT n_name, count(*) AS orders, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS done,
round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 4)::DOUBLE AS percent_done
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def provider_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    done = F.count_if(F.col("o_orderstatus") == "F")
    percent = F.round(done * F.lit(100.0) / F.count(F.lit(1)), 4)
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("o_custkey").alias("customers"), done.alias("done"), percent.alias("percent_done"))


#: Cells of the older form by the remainder of the key: a history, one nested once, a broken text, a scalar, null.
LEGACY_SQL = """SELECT o_orderkey, o_orderkey % 5 AS r, CASE o_orderkey % 5
WHEN 0 THEN '[{"date":"2020-01-01 00:00:00","value":"a"},{"date":"2021-01-01 00:00:00","value":"' || o_orderpriority || '"}]'
WHEN 1 THEN '[[{"date":"2020-01-01 00:00:00","value":"b"}]]' WHEN 2 THEN '[{"date":"2020-01-01' WHEN 3 THEN '"quoted"' END AS cell FROM orders"""


def _legacy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("o_orderkey") % 5
    one = F.concat(F.lit('[{"date":"2020-01-01 00:00:00","value":"a"},{"date":"2021-01-01 00:00:00","value":"'), F.col("o_orderpriority"), F.lit('"}]'))
    cell = F.when(r == 0, one).when(r == 1, '[[{"date":"2020-01-01 00:00:00","value":"b"}]]').when(r == 2, '[{"date":"2020-01-01').when(r == 3, '"quoted"')
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", cell.alias("cell"))


def _legacy_sql(quoted: str) -> str:
    return f"""WITH l AS ({LEGACY_SQL}) SELECT l.o_orderkey, CASE r WHEN 0 THEN 2 ELSE 1 END AS entries, CASE WHEN r < 2 THEN '2020-01-01 00:00:00' ELSE '2026-01-01 00:00:00' END AS date,
CASE r WHEN 0 THEN o_orderpriority WHEN 1 THEN 'b' WHEN 2 THEN '[{{"date":"2020-01-01' WHEN 3 THEN '{quoted}' ELSE 'NULL' END AS value FROM l JOIN orders o ON o.o_orderkey = l.o_orderkey"""


def _legacy(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    rows = _legacy_cells(spark, sf_dir)
    h = rows.select("o_orderkey", legacy.initial(F.col("cell"), rows.schema["cell"].dataType, F.lit("2026-01-01 00:00:00"), mode).alias("h"))
    return h.select("o_orderkey", F.size("h").alias("entries"), F.col("h")[0]["date"].alias("date"), legacy.as_of(F.col("h"), F.lit("2030-01-01 00:00:00")).alias("value"))


@query(_legacy_sql('"quoted"'))
def legacy_history_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first form of a mirror: cells that are histories stay so, others become one."""
    return _legacy(spark, sf_dir, "new")


@query(_legacy_sql('"quoted"'))
def legacy_serialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legacy(spark, sf_dir, "serialized")


@query(_legacy_sql("quoted"))
def legacy_compare_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legacy(spark, sf_dir, "compare")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date, CASE WHEN o_orderkey % 4 = 0 THEN 'NULL' ELSE o_orderpriority END AS value, 2 AS entries,
CASE WHEN o_orderkey % 7 = 0 THEN 'plain' ELSE 'x' END AS second FROM orders""")
def legacy_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of history texts with dates in ISO form, nulls and items that are no entries, made uniform."""
    value = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"'))).otherwise("null")
    second = F.when(F.col("o_orderkey") % 7 == 0, '"plain"').otherwise('{"date":"2020-01-01","value":"x"}')
    text = F.concat(F.lit('[{"date":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('","value":'), value, F.lit("},"), second, F.lit("]"))
    h = table(spark, sf_dir, "orders").select("o_orderkey", legacy.validated(text, F.lit("2026-01-01 00:00:00")).alias("h"))
    return h.select("o_orderkey", F.col("h")[0]["date"].alias("date"), F.col("h")[0]["value"].alias("value"), F.size("h").alias("entries"), F.col("h")[1]["value"].alias("second"))


@query("""SELECT o_orderkey, o_orderkey % 3 <> 0 AS valid FROM orders""")
def legacy_valid_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.when(F.col("o_orderkey") % 3 == 0, "yesterday").otherwise("2020-01-01 00:00:00")
    cell = F.array(F.struct(date.alias("date"), F.col("o_orderpriority").alias("value")))
    return table(spark, sf_dir, "orders").select("o_orderkey", legacy.is_valid(cell).alias("valid"))


@query("""SELECT c_mktsegment, o_orderpriority, count(*) AS n, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def segment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"))


@query("""SELECT s_suppkey, n_name, r_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def role_joins_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return rows.select("s_suppkey", "n_name", "r_name", place.alias("place"))
