"""Audit views: whole rows with their history at a glance, and how they are shown in parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronocell.operators import log as L
from chronocell.operators.scan import Scan
from chronocell.sources.scratch import Scratch


def audit_view(log: DataFrame, fields: Sequence[str], write_once: Sequence[str] = (), instant: Column | None = None) -> DataFrame:
    """``entity_id, first_seen, state, resurrected, flagged, changes, cells, spark`` of every entity born by ``instant``.

    ``cells`` has for each of ``fields`` in order the last value, the one before it (``ghost``), the
    direction from that (null for none) and the number of changes; ``changes`` sums them.  ``spark``
    are the runs of ``log.spark_segments`` in order.  Deleted entities stay with their last cells;
    ``flagged`` tells whether a ``write_once`` field has ever changed.
    """
    seen = F.lit(True) if instant is None else F.col("timestamp") <= instant
    events = log.select("entity_id", "field", "value", "timestamp", L.order(log).alias("o"))
    # Every event beside the one before it in its cell, and its number there; then a row a cell, then one an entity.
    events = Scan(events, ["entity_id", "field"], [F.col("o")]).add(previous={"before": (F.struct("value"), 1)}, sums={"changes": F.lit(1)}).rows()
    place = F.when(seen, F.col("o"))
    broken = F.col("before").isNotNull() & ~F.col("value").eqNullSafe(F.col("before.value")) & (F.col("field").isin(*write_once) if write_once else F.lit(False))
    cell = events.groupBy("entity_id", "field").agg(F.max_by(F.struct("value", "before", "changes"), place).alias("c"), F.min(place).alias("first"), F.max(place).alias("last"), F.bool_or(broken).alias("broken"))
    c = F.col("c")
    turn = F.when(c["before"].isNotNull(), L.direction(c["before"]["value"], c["value"])).alias("direction")
    shown = F.struct(c["value"].alias("value"), c["before"]["value"].alias("ghost"), turn, c["changes"].alias("changes")).alias("c")
    wanted = F.when(F.col("field").isin(*fields) & c.isNotNull(), F.struct("field", shown)) if fields else F.lit(None)
    rows = cell.groupBy("entity_id").agg(
        F.min("first.timestamp").alias("first_seen"),
        F.max_by("field", "last").alias("last_field"),
        F.min(F.when(L.is_deletion(), F.col("first"))).alias("first_deletion"),
        F.max(F.when(~L.is_deletion(), F.col("last"))).alias("last_set"),
        F.bool_or("broken").alias("flagged"),
        (F.map_from_entries(F.collect_list(wanted)) if fields else F.lit(None)).alias("m"),
    )
    rows = rows.where("first_seen is not null")
    none = F.lit(None).cast(log.schema["value"].dataType)

    def shaped(f: str) -> Column:
        own = F.col("m")[f]
        return F.struct(F.lit(f).alias("field"), F.coalesce(own["value"], none).alias("value"), own["ghost"].alias("ghost"), own["direction"].alias("direction"), F.coalesce(own["changes"], F.lit(0)).alias("changes"))

    empty = "array<struct<field:string,value:%s,ghost:%s,direction:string,changes:bigint>>" % ((log.schema["value"].dataType.simpleString(),) * 2)
    rows = rows.withColumn("cells", F.array(*[shaped(f) for f in fields]) if fields else F.array().cast(empty))
    run = F.struct("segment", "kind", "first", "last")
    spark = L.spark_segments(L.until(log, instant)).groupBy("entity_id").agg(F.array_sort(F.collect_list(run)).alias("spark"))
    changes = F.aggregate("cells", F.lit(0).cast("long"), lambda acc, x: acc + x["changes"])
    return rows.join(spark, "entity_id").select("entity_id", "first_seen", *L.lifecycle(), "flagged", changes.alias("changes"), "cells", "spark")


def capped(rows: DataFrame, order: Sequence[str], most: int = 1000) -> DataFrame:
    """The first ``most`` rows by ``order``, each with ``total_rows`` there are and whether that ``capped`` them.

    The rows are written once, as they are both counted and sorted.
    """
    rows = Scratch(rows.sparkSession, "capped").keep(rows)
    total = rows.agg(F.count(F.lit(1)).alias("total_rows"))
    return rows.orderBy(*order).limit(most).crossJoin(total).withColumn("capped", F.col("total_rows") > most)


def next_sort(state: tuple[str, str] | None, column: str) -> tuple[str, str] | None:
    """What a press on ``column`` makes of a sort: up, then down, then none; another column begins at up."""
    if state is None or state[0] != column:
        return column, "asc"
    return (column, "desc") if state[1] == "asc" else None


def sorted_rows(rows: DataFrame, state: tuple[str, str] | None, natural: Sequence[str]) -> DataFrame:
    """``rows`` by the typed values of a column, nulls last either way, ties and no sort in ``natural`` order."""
    return rows.orderBy(*_order(state, natural))


def _order(state: tuple[str, str] | None, natural: Sequence[str]) -> list[Column]:
    own = [] if state is None else [F.col(f"`{state[0]}`").asc_nulls_last() if state[1] == "asc" else F.col(f"`{state[0]}`").desc_nulls_last()]
    return own + [F.col(f"`{c}`") for c in natural]


class SortedRows:
    """Sorted rows of which slices anywhere are read from the parts that they lie in.

    The rows are written once, dealt to parts by ranges of the order; what a part holds is counted, so the part
    of any place is known.  ``natural`` should tell all rows apart: rows that it does not are one part.
    """

    def __init__(self, rows: DataFrame, state: tuple[str, str] | None, natural: Sequence[str], parts: int = 200):
        scratch = Scratch(rows.sparkSession, "sorted")
        self._order, columns = _order(state, natural), rows.columns
        self._part = "part" if "part" not in {c.lower() for c in columns} else next(f"part_{k}" for k in range(len(columns) + 1) if f"part_{k}" not in {c.lower() for c in columns})
        self._columns, where = columns, scratch.folder("rows")
        dealt = rows.repartitionByRange(parts, *self._order).withColumn(self._part, F.spark_partition_id())
        dealt.write.partitionBy(self._part).parquet(where)
        self._rows = rows.sparkSession.read.schema(T.StructType([*rows.schema.fields, T.StructField(self._part, T.IntegerType())])).parquet(where)
        # At most a number for each of ``parts``.
        self._counts = sorted(tuple(r) for r in self._rows.groupBy(self._part).agg(F.count(F.lit(1))).collect())

    def parts_of(self, first: int, n: int) -> tuple[list[int], int]:
        """The parts that places ``first`` to ``first + n - 1`` lie in, and the place that they begin at."""
        met, at, begins = [], 0, 0
        for part, count in self._counts:
            if at < first + n and at + count > first:
                begins = begins if met else at
                met.append(part)
            at += count
        return met, begins

    def slice(self, first: int, n: int) -> DataFrame:
        """``slice_rows`` of the sorted rows."""
        met, begins = self.parts_of(first, n)
        own = self._rows.where(F.col(self._part).isin(met)).select(*[F.col(f"`{c}`") for c in self._columns])
        return own.orderBy(*self._order).offset(max(first - begins, 0)).limit(n)


def slice_rows(rows: DataFrame, first: int, n: int) -> DataFrame:
    """``n`` rows from place ``first`` (from 0) of sorted ``rows``; deep in many rows see ``SortedRows``."""
    return rows.offset(first).limit(n)


def compare_by_state(log: DataFrame, fields: Sequence[str], before: Column, after: Column) -> DataFrame:
    """``entity_id, change`` of entities active at either of two instants: ``ADD``, ``DROP``, ``CHG`` or ``SAME``.

    One not born yet, or deleted, is not there; cells are compared as they last were.
    """
    cells = F.struct(*[F.col(f"`{f}`") for f in fields]) if fields else F.lit(1)
    old = L.mirror_view(log, fields, before).select("entity_id", cells.alias("old"))
    new = L.mirror_view(log, fields, after).select("entity_id", cells.alias("new"))
    both = old.withColumn("was", F.lit(True)).join(new.withColumn("now", F.lit(True)), "entity_id", "full_outer")
    change = F.when(F.col("was").isNull(), "ADD").when(F.col("now").isNull(), "DROP").when(~F.col("old").eqNullSafe(F.col("new")), "CHG").otherwise("SAME")
    return both.select("entity_id", change.alias("change"))


def as_documents(view: DataFrame, key: str) -> DataFrame:
    """``key`` and ``document``: each row's other columns as a JSON object with its nulls."""
    cells = F.struct(*[F.col(f"`{c}`") for c in view.columns if c != key])
    return view.select(F.col(f"`{key}`").alias(key), F.to_json(cells, {"ignoreNullFields": "false"}).alias("document"))


def as_dict(view: DataFrame, key: str) -> dict:
    """``{key: {column: value}}`` of a view on the driver, a partition at a time; for views that fit there."""
    return {r[key]: {c: r[c] for c in view.columns if c != key} for r in view.toLocalIterator()}
