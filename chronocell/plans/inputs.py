"""The driver's tables as change logs and snapshots, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocell.operators import diff, log
from chronocell.sources.tables import table

FIELDS = ["click", "purchase", "signup", "view"]
T0, T1 = "2024-01-08 00:00:00", "2024-01-15 00:00:00"

ELOG = """e AS (SELECT CAST(user_id AS VARCHAR) AS entity_id, ts AS timestamp, event_id AS seq,
CASE WHEN event_type = 'error' THEN '__deleted__' ELSE event_type END AS field, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"""


def elog(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("entity_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("seq"),
        F.when(error, log.DELETED).otherwise(F.col("event_type")).alias("field"),
        F.when(~error, F.col("value")).alias("value"),
    )


#: Snapshot: keys kept, then what differs.
_KEPT = {"A": "o_orderkey % 17 <> 0", "B": "o_orderkey % 13 <> 0", "C": "o_orderkey % 11 <> 0"}


def snapshot(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    status = F.col("o_orderstatus")
    if name == "B":
        cents = F.when(F.col("o_orderkey") % 7 != 0, cents)
        status = F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(status)
    rows = table(spark, sf_dir, "orders").where(_KEPT[name])
    return rows.select("o_orderkey", status.alias("o_orderstatus"), cents.alias("total_cents"), "o_orderpriority")


def snapshot_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of A, B and C captured on three days."""
    none = snapshot(spark, sf_dir, "A").limit(0)
    states = [none, *[snapshot(spark, sf_dir, s) for s in "ABC"]]
    parts = []
    for day in range(3):
        events = diff.diff_events(states[day], states[day + 1], "o_orderkey")
        parts.append(events.withColumns({"timestamp": F.expr(f"TIMESTAMP_NTZ'2026-01-0{day + 1}'"), "seq": F.lit(day)}))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _diff_sql(old: str, new: str) -> str:
    """Changes of two snapshots in long form, from nothing where ``old`` is empty."""
    return f"""(SELECT n.key AS entity_id, n.field, n.value FROM {new}_long n LEFT JOIN {old}_long o ON o.key = n.key AND o.field = n.field
WHERE CASE WHEN o.key IS NULL THEN n.value IS NOT NULL ELSE n.value IS DISTINCT FROM o.value END
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '__deleted__', NULL FROM {old} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {new}))"""


def _snaps_sql() -> str:
    parts = [
        "a AS (SELECT o_orderkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents, o_orderpriority FROM orders WHERE o_orderkey % 17 <> 0)",
        "b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS total_cents, o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0)",
        "c AS (SELECT o_orderkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents, o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0)",
        "z AS (SELECT * FROM a WHERE false)",
    ]
    for s in "zabc":
        columns = ("o_orderstatus", "total_cents", "o_orderpriority")
        parts.append(f"{s}_long AS (" + " UNION ALL ".join(f"SELECT CAST(o_orderkey AS VARCHAR) AS key, '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM {s}" for c in columns) + ")")
    parts += [f"za AS {_diff_sql('z', 'a')}", f"ab AS {_diff_sql('a', 'b')}", f"bc AS {_diff_sql('b', 'c')}"]
    days = " UNION ALL ".join(f"SELECT *, TIMESTAMP '2026-01-0{k + 1}' AS timestamp, {k} AS seq FROM {t}" for k, t in enumerate(("za", "ab", "bc")))
    return ", ".join([*parts, f"slog AS ({days})"])


SNAPS = _snaps_sql()
