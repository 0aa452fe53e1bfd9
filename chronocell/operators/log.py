"""Temporal questions over a change log.

A log is a DataFrame ``entity_id, timestamp, field, value`` and, where the source has one,
``seq`` (a capture's place), with one row per changed cell and ``DELETED`` rows where an
entity vanished.  Among equal timestamps ``seq`` decides, then a deletion comes last.  All
functions are lazy plans of built-in operators: aggregates shuffle once by entity, and point
lookups filter before anything else.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronocell.operators.scan import Scan

DELETED = "__deleted__"

#: A summary of all events of each cell, of a log of texts: its last and first place, their number, and bounds of its values.
SUMMARY = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (("entity_id", T.StringType()), ("field", T.StringType()), ("timestamp", T.TimestampType()), ("seq", T.IntegerType()), ("first_timestamp", T.TimestampType()), ("first_seq", T.IntegerType()), ("changes", T.LongType()), ("low", T.StringType()), ("high", T.StringType()), ("nulls", T.LongType()))
    ]
)


def is_deletion() -> Column:
    return F.col("field") == DELETED


def order(log: DataFrame) -> Column:
    """The total order of events."""
    seq = F.col("seq") if "seq" in log.columns else F.lit(0)
    return F.struct("timestamp", seq.alias("seq"), is_deletion().alias("last"))


def until(log: DataFrame, instant: Column | None) -> DataFrame:
    """Events not after ``instant``; all for ``None``."""
    return log if instant is None else log.where(F.col("timestamp") <= instant)


def latest_cells(log: DataFrame, instant: Column | None = None) -> DataFrame:
    """``entity_id, field, timestamp, value`` of the last event of every cell, deletions aside."""
    log = until(log, instant)
    last = F.max_by(F.struct("timestamp", "value"), order(log)).alias("c")
    return log.where(~is_deletion()).groupBy("entity_id", "field").agg(last).select("entity_id", "field", "c.timestamp", "c.value")


#: Columns of a view beyond which cells are folded on their own first: an aggregate of so many
#: ``max_by`` holds them all in every row it merges.  Results are the same either way.
WIDE = 40


def _states(log: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row an entity: its last field, its deletion and set bounds, and its last value by field."""
    o = order(log)
    if len(fields) > WIDE:
        return _wide_states(log, fields)
    cells = [F.max_by("value", F.when(F.col("field") == f, o)).alias(f"cell:{f}") for f in fields]
    return log.groupBy("entity_id").agg(
        F.max_by("field", o).alias("last_field"),
        F.min(F.when(is_deletion(), o)).alias("first_deletion"),
        F.max(F.when(~is_deletion(), o)).alias("last_set"),
        *cells,
    )


def _wide_states(log: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``_states`` by way of one row a cell, then one map of at most ``fields`` entries an entity."""
    o = order(log)
    cells = log.groupBy("entity_id", "field").agg(F.max_by("value", o).alias("value"), F.min(o).alias("first"), F.max(o).alias("last"))
    wanted = F.when(F.col("field").isin(*fields), F.struct("field", "value"))
    packed = cells.groupBy("entity_id").agg(
        F.max_by("field", "last").alias("last_field"),
        F.min(F.when(is_deletion(), F.col("first"))).alias("first_deletion"),
        F.max(F.when(~is_deletion(), F.col("last"))).alias("last_set"),
        F.map_from_entries(F.collect_list(wanted)).alias("m"),
    )
    return packed.select("entity_id", "last_field", "first_deletion", "last_set", *[F.col("m")[f].alias(f"cell:{f}") for f in fields])


def lifecycle(state: str = "state", resurrected: str = "resurrected") -> list[Column]:
    """State and resurrection from ``last_field``, ``last_set`` and ``first_deletion`` of an entity."""
    kind = F.when(F.col("last_field") == DELETED, "deleted").otherwise("active").alias(state)
    back = F.coalesce(F.col("last_set") > F.col("first_deletion"), F.lit(False)).alias(resurrected)
    return [kind, back]


def mirror_view(log: DataFrame, fields: Sequence[str], instant: Column | None = None, deleted: bool = False) -> DataFrame:
    """The table as of ``instant``: one row a live entity, or a ``deleted`` one with its last cells; a column a field."""
    gone = F.col("last_field") == DELETED
    states = _states(until(log, instant), fields).where(gone if deleted else ~gone)
    return states.select("entity_id", *[F.col(f"`cell:{f}`").alias(f) for f in fields])


def temporal_view(log: DataFrame, fields: Sequence[str], instant: Column | None = None) -> DataFrame:
    """``mirror_view`` with deleted entities too, their last cells kept, and ``state, resurrected``.

    Where a field has such a name, the column beside it is ``lifecycle_state`` or ``lifecycle_resurrected``.
    """
    states = _states(until(log, instant), fields)
    return states.select("entity_id", *lifecycle(*lifecycle_names(fields)), *[F.col(f"`cell:{f}`").alias(f) for f in fields])


def lifecycle_names(fields: Sequence[str]) -> list[str]:
    """The names that ``temporal_view`` gives lifecycle columns beside ``fields``, which are told apart without case."""
    taken, out = {f.lower() for f in fields}, []
    for name in ("state", "resurrected"):
        while name in taken:
            name = f"lifecycle_{name}"
        out.append(name)
    return out


def row_states(log: DataFrame, instant: Column | None = None, entities: DataFrame | None = None) -> DataFrame:
    """``entity_id, state, resurrected``; with ``entities``, those without an event by then are ``unborn``."""
    found = _states(until(log, instant), []).select("entity_id", *lifecycle())
    if entities is None:
        return found
    ids = entities.select("entity_id").distinct()
    return ids.join(found, "entity_id", "left").select("entity_id", F.coalesce("state", F.lit("unborn")).alias("state"), F.coalesce("resurrected", F.lit(False)).alias("resurrected"))


def as_of(log: DataFrame, entity_id: str, field: str, instant: Column | None = None) -> DataFrame:
    """``date, value`` of one cell: no row where it had no event yet; deletion of the entity is ignored."""
    cell = until(log, instant).where((F.col("entity_id") == entity_id) & (F.col("field") == field))
    last = cell.agg(F.max_by(F.struct("timestamp", "value"), order(cell)).alias("c")).where("c is not null")
    return last.select(F.col("c.timestamp").alias("date"), "c.value")


def as_of_probes(log: DataFrame, probes: DataFrame) -> DataFrame:
    """``as_of`` for every row of ``probes`` (``probe_id, entity_id, field, instant``); date and value null for none.

    Events and probes of a cell go once through a scan in order of time, so the work is their sum,
    not their product, and a cell of any size is many tasks'; a probe comes after the events of its
    instant.  Repeated probes repeat.
    """
    seq = F.col("seq") if "seq" in log.columns else F.lit(0)
    hit = F.struct("timestamp", "value")
    events = log.select("entity_id", "field", F.col("timestamp").alias("at"), F.lit(0).alias("late"), seq.cast("long").alias("s"), F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"), hit.alias("hit"))
    asked = probes.select("entity_id", "field", F.col("instant").alias("at"), F.lit(1).alias("late"), F.lit(0).cast("long").alias("s"), "probe_id", F.lit(None).cast(events.schema["hit"].dataType).alias("hit"))
    by_time = [F.col("at"), F.col("late"), F.col("s")]
    out = Scan(events.unionByName(asked), ["entity_id", "field"], by_time).add(filled={"found": F.col("hit")}).rows().where("late = 1")
    found = F.when(F.col("at").isNotNull(), F.col("found"))
    return out.select("probe_id", "entity_id", "field", found["timestamp"].alias("date"), found["value"].alias("value"))


def timeline(log: DataFrame, entity_id: str, field: str | None = None) -> DataFrame:
    """``date, value`` of a cell, or ``date, field, value`` of a whole entity, deletions included; in order."""
    own = log.where(F.col("entity_id") == entity_id)
    if field is not None:
        own = own.where(F.col("field") == field)
    columns = ["value"] if field is not None else ["field", "value"]
    return own.orderBy(order(own)).select(F.col("timestamp").alias("date"), *columns)


def change_counts(log: DataFrame) -> DataFrame:
    """``entity_id, changes, set_changes``: all events, and those that are no deletion."""
    return log.groupBy("entity_id").agg(F.count(F.lit(1)).alias("changes"), F.count_if(~is_deletion()).alias("set_changes"))


def change_statistics(log: DataFrame) -> DataFrame:
    """One row: ``cells`` now live, ``events``, ``percent_changed`` of the cells (may pass 100)."""
    live = row_states(log).where("state = 'active'").select("entity_id")
    cells = latest_cells(log).join(live, "entity_id", "left_semi").agg(F.count(F.lit(1)).alias("cells"))
    events = log.agg(F.count_if(~is_deletion()).alias("events"))
    percent = F.when(F.col("cells") > 0, F.round(F.col("events") * 100.0 / F.col("cells"), 6)).otherwise(F.lit(0.0))
    return cells.crossJoin(events).select("cells", "events", percent.alias("percent_changed"))


def snap_points(log: DataFrame) -> DataFrame:
    """The distinct instants at which anything changed, in order."""
    return log.select("timestamp").distinct().orderBy("timestamp")


def nearest_snaps(log: DataFrame, instant: Column) -> DataFrame:
    """One row: ``previous`` and ``next`` snap point strictly around ``instant``, the one ``at`` or before it, and the ``nearest``.

    Of two as near the earlier is the nearest.
    """
    both = log.select("timestamp", instant.alias("wanted"))
    both = both.withColumn("away", F.abs(micros("timestamp") - micros("wanted")))
    t, wanted = F.col("timestamp"), F.col("wanted")
    nearest = F.min(F.struct("away", "timestamp"))["timestamp"].alias("nearest")
    return both.agg(F.max(F.when(t < wanted, t)).alias("previous"), F.min(F.when(t > wanted, t)).alias("next"), F.max(F.when(t <= wanted, t)).alias("at"), nearest)


def with_future(log: DataFrame, instant: Column) -> DataFrame:
    """The log with ``future``: whether an event is after ``instant``."""
    return log.withColumn("future", F.col("timestamp") > instant)


def of_entities(log: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The whole history of some entities."""
    return log.where(F.col("entity_id").isin(*ids))


def micros(t: str) -> Column:
    """Microseconds since 1970 of a timestamp column as written, whatever the session's zone."""
    return F.expr(f"(datediff(to_date({t}), DATE'1970-01-01') * 86400L + hour({t}) * 3600 + minute({t}) * 60) * 1000000 + CAST(extract(SECOND FROM {t}) * 1000000 AS BIGINT)")


def density(log: DataFrame, buckets: int = 60) -> DataFrame:
    """``bucket, changes``: events in ``buckets`` equal parts of the log's time span, empty ones too."""
    us = log.select(micros("timestamp").alias("us"))
    span = us.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    place = F.least(F.lit(buckets - 1), F.expr(f"(us - lo) * {buckets} div greatest(hi - lo, 1)"))
    counts = us.join(F.broadcast(span)).groupBy(place.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    spine = log.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(span.where("lo is not null")))
    return spine.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("changes"))


def file_density(files: DataFrame, buckets: int = 60) -> DataFrame:
    """``bucket, changes`` from files alone (``ts_min, ts_max, row_count``): all rows of a file count where it begins."""
    rows = files.select(micros("ts_min").alias("lo_us"), micros("ts_max").alias("hi_us"), "row_count")
    span = rows.agg(F.min("lo_us").alias("lo"), F.max("hi_us").alias("hi"))
    place = F.least(F.lit(buckets - 1), F.expr(f"(lo_us - lo) * {buckets} div greatest(hi - lo, 1)"))
    counts = rows.join(F.broadcast(span)).groupBy(place.cast("int").alias("bucket")).agg(F.sum("row_count").alias("n"))
    spine = files.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(span.where("lo is not null")))
    return spine.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("changes"))


def density_by_day(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("changes"))


def first_seen(log: DataFrame) -> DataFrame:
    """``entity_id, first_seen`` in order of appearance."""
    return log.groupBy("entity_id").agg(F.min("timestamp").alias("first_seen")).orderBy("first_seen", "entity_id")


#: Changes of a cell from which it is of a heat (fixed values of the views).
HEATS = ((8, "v4"), (5, "v3"), (3, "v2"), (1, "v1"))


def heat(changes: Column) -> Column:
    """``v1`` to ``v4`` from 1, 2... the number of changes of a cell: 1, 3, 5 and 8 are the steps."""
    return F.coalesce(*[F.when(changes >= n, name) for n, name in HEATS], F.lit("v0"))


def cell_frequencies(log: DataFrame) -> DataFrame:
    """``entity_id, field, changes, heat`` of every cell."""
    counts = log.where(~is_deletion()).groupBy("entity_id", "field").agg(F.count(F.lit(1)).alias("changes"))
    return counts.withColumn("heat", heat(F.col("changes")))


def row_frequencies(log: DataFrame, fields: Sequence[str], instant: Column | None = None) -> DataFrame:
    """``entity_id, changes``: events in tracked ``fields`` by ``instant``."""
    return until(log, instant).groupBy("entity_id").agg(F.count_if(F.col("field").isin(*fields)).alias("changes"))


def direction(before: Column, after: Column) -> Column:
    """``up``, ``down``, ``same``, or ``na`` where either is null."""
    return F.when(before.isNull() | after.isNull(), "na").when(after > before, "up").when(after < before, "down").otherwise("same")


def ghosts(log: DataFrame, instant: Column | None = None) -> DataFrame:
    """``entity_id, field, value, ghost, direction, delta``: each cell's last value and the one before it."""
    own = until(log, instant).where(~is_deletion())
    ranked = own.withColumn("rn", F.row_number().over(Window.partitionBy("entity_id", "field").orderBy(order(own).desc()))).where("rn <= 2")
    pair = ranked.groupBy("entity_id", "field").agg(F.max(F.when(F.col("rn") == 1, F.col("value"))).alias("value"), F.max(F.when(F.col("rn") == 2, F.col("value"))).alias("ghost"))
    return pair.select("*", direction(F.col("ghost"), F.col("value")).alias("direction"), (F.col("value") - F.col("ghost")).alias("delta"))


def changes_with_direction(log: DataFrame) -> DataFrame:
    """Every set event with the cell's value before it, ``direction`` and ``delta``."""
    own = log.where(~is_deletion())
    rows = Scan(own, ["entity_id", "field"], [order(own)]).add(previous={"before": (F.col("value"), 1)}).rows()
    return rows.select("entity_id", "field", "timestamp", "value", "before", direction(F.col("before"), F.col("value")).alias("direction"), (F.col("value") - F.col("before")).alias("delta"))


def spark_segments(log: DataFrame, instant: Column | None = None) -> DataFrame:
    """``entity_id, segment, kind, first, last``: runs of an entity's events of one kind, by place from 0.

    A deletion is ``deleted``, the first set after one ``resurrected``, any other ``active``.
    """
    own = until(log, instant)
    rows = Scan(own.select("entity_id", is_deletion().alias("gone"), order(own).alias("o")), ["entity_id"], [F.col("o")])
    rows = rows.add(previous={"gone1": (F.col("gone"), 1), "gone2": (F.col("gone"), 2)}, sums={"pos": F.lit(1)})
    # The kind of a place and of the one before, from deletions up to two places back.
    kinds = [F.when(F.col(now), "deleted").when(F.col(was), "resurrected").otherwise("active") for now, was in (("gone", "gone1"), ("gone1", "gone2"))]
    starts = (F.col("gone1").isNull() | (kinds[0] != kinds[1])).cast("int")
    rows = rows.add(sums={"segment": starts}).rows()
    rows = rows.select("entity_id", F.col("segment").cast("long").alias("segment"), kinds[0].alias("kind"), (F.col("pos") - 1).cast("int").alias("pos"))
    return rows.groupBy("entity_id", "segment").agg(F.first("kind").alias("kind"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def resurrections(log: DataFrame) -> DataFrame:
    """``entity_id, timestamp, field``: the first set after each deletion."""
    rows = Scan(log, ["entity_id"], [order(log)]).add(previous={"gone": (is_deletion(), 1)}).rows()
    return rows.where(F.col("gone") & ~is_deletion()).select("entity_id", "timestamp", "field")


def peek(log: DataFrame, n: int = 3) -> DataFrame:
    """``entity_id, field, timestamp, value, place, earlier``: each cell's last ``n`` events, newest first."""
    own = log.where(~is_deletion())
    rows = own.withColumn("place", F.row_number().over(Window.partitionBy("entity_id", "field").orderBy(order(own).desc()))).where(F.col("place") <= n)
    totals = own.groupBy("entity_id", "field").agg(F.count(F.lit(1)).alias("total"))
    out = rows.join(totals, ["entity_id", "field"])
    return out.select("entity_id", "field", "timestamp", "value", "place", F.greatest(F.col("total") - n, F.lit(0)).alias("earlier"))


def violations(log: DataFrame, write_once: Sequence[str]) -> DataFrame:
    """``entity_id, field, timestamp, before, after``: changes of columns that are written once."""
    own = log.where(F.col("field").isin(*write_once))
    rows = Scan(own, ["entity_id", "field"], [order(own)]).add(previous={"before": (F.struct("value"), 1)}).rows()
    changed = rows.where(F.col("before").isNotNull() & ~F.col("value").eqNullSafe(F.col("before.value")))
    return changed.select("entity_id", "field", "timestamp", F.col("before.value").alias("before"), F.col("value").alias("after"))


def _facts(log: DataFrame, write_once: Sequence[str]) -> DataFrame:
    """One row an entity, from one pass over the log: ``events, changes, seen``, lifecycle and ``flagged``.

    A field has changed if its values differ anywhere, null as a value, so no order is needed.
    """
    differs = F.lit(False)
    for f in write_once:
        own = F.col("field") == f
        low, high = F.min(F.when(own, F.col("value"))), F.max(F.when(own, F.col("value")))
        with_null = F.count_if(own & F.col("value").isNull())
        differs = differs | F.coalesce(low != high, F.lit(False)) | ((with_null > 0) & low.isNotNull())
    o = order(log)
    facts = log.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(~is_deletion()).alias("changes"),
        F.min("timestamp").alias("seen"),
        F.max_by("field", o).alias("last_field"),
        F.min(F.when(is_deletion(), o)).alias("first_deletion"),
        F.max(F.when(~is_deletion(), o)).alias("last_set"),
        differs.alias("flagged"),
    )
    return facts.select("entity_id", "events", "changes", "seen", "flagged", *lifecycle())


def callouts(log: DataFrame, write_once: Sequence[str], top: int = 3) -> DataFrame:
    """``entity_id, kind, changes``: every violator, then the ``top`` most changed others."""
    facts = _facts(log, write_once)
    flagged = facts.where("flagged").select("entity_id", F.lit("violation").alias("kind"), "changes")
    calm = facts.where("NOT flagged AND changes > 0").orderBy(F.desc("changes"), "seen", "entity_id").limit(top)
    return flagged.unionByName(calm.select("entity_id", F.lit("volatile").alias("kind"), "changes"))


def kpis(log: DataFrame, write_once: Sequence[str] = ()) -> DataFrame:
    """One row: ``entities, events, deleted, resurrected, flagged``."""
    return _kpis(_facts(log, write_once))


def _kpis(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(F.col("state") == "deleted").alias("deleted"),
        F.count_if("resurrected").alias("resurrected"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("events"),
        F.count_if("flagged").alias("flagged"),
    )


def scrub_diff(log: DataFrame, fields: Sequence[str], earlier: Column, later: Column) -> DataFrame:
    """``entity_id, field, before, after``: cells whose values differ between two instants, in one aggregate.

    Deleted rows keep their last cells; cells not there yet are null.
    """
    o = order(log)
    old = F.max_by("value", F.when(F.col("timestamp") <= earlier, o))
    own = until(log, later).where(F.col("field").isin(*fields))
    both = own.groupBy("entity_id", "field").agg(old.alias("before"), F.max_by("value", o).alias("after"))
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def folded(log: DataFrame) -> DataFrame:
    """The last event of every cell, and each entity's last deletion, as events.

    Any view of the log at or after its end is the same over these and what came later.  Counts,
    timelines and whether an entity ever came back are not.
    """
    last = F.max_by(F.struct(*log.columns), order(log)).alias("e")
    return log.groupBy("entity_id", "field").agg(last).select("e.*")


def _summaries(log: DataFrame) -> list[Column]:
    o = order(log)
    return [
        F.min(o).alias("first"),
        F.count(F.lit(1)).alias("changes"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.count_if(F.col("value").isNull()).alias("nulls"),
    ]


def summary(log: DataFrame) -> DataFrame:
    """``SUMMARY`` of a log: what ``states_of``, ``counts_of`` and ``kpis_of`` need, and what ``merged`` adds to."""
    cells = log.groupBy("entity_id", "field").agg(F.max(order(log)).alias("at"), *_summaries(log))
    return cells.select("entity_id", "field", "at.timestamp", "at.seq", F.col("first.timestamp").alias("first_timestamp"), F.col("first.seq").alias("first_seq"), "changes", "low", "high", "nulls")


def summarised(log: DataFrame) -> DataFrame:
    """``folded`` with the summary of each cell beside its last event."""
    last = F.max_by(F.struct(*log.columns), order(log)).alias("e")
    cells = log.groupBy("entity_id", "field").agg(last, *_summaries(log))
    return cells.select("e.*", F.col("first.timestamp").alias("first_timestamp"), F.col("first.seq").alias("first_seq"), "changes", "low", "high", "nulls")


def merged(summaries: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """One summary a cell from those of parts of a log, with the last event's ``kept`` columns beside it."""
    last = list(dict.fromkeys([*kept, "timestamp", "seq"]))
    cells = summaries.groupBy("entity_id", "field").agg(
        F.max_by(F.struct(*[c for c in last if c not in ("entity_id", "field")]), F.struct("timestamp", "seq")).alias("e"),
        F.min(F.struct("first_timestamp", "first_seq")).alias("f"),
        F.sum("changes").alias("changes"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("nulls").alias("nulls"),
    )
    return cells.select("entity_id", "field", "e.*", "f.*", "changes", "low", "high", "nulls")


def _facts_of(cells: DataFrame, write_once: Sequence[str] = ()) -> DataFrame:
    """``_facts`` from summaries."""
    o = F.struct("timestamp", "seq", is_deletion().alias("last"))
    first = F.struct(F.col("first_timestamp").alias("timestamp"), F.col("first_seq").alias("seq"), is_deletion().alias("last"))
    differs = F.coalesce(F.col("low") != F.col("high"), F.lit(False)) | ((F.col("nulls") > 0) & F.col("low").isNotNull())
    facts = cells.groupBy("entity_id").agg(
        F.sum("changes").alias("events"),
        F.coalesce(F.sum(F.when(~is_deletion(), F.col("changes"))), F.lit(0)).alias("changes"),
        F.min("first_timestamp").alias("seen"),
        F.max_by("field", o).alias("last_field"),
        F.min(F.when(is_deletion(), first)).alias("first_deletion"),
        F.max(F.when(~is_deletion(), o)).alias("last_set"),
        F.max(F.col("field").isin(*write_once) & differs if write_once else F.lit(False)).alias("flagged"),
    )
    return facts.select("entity_id", "events", "changes", "seen", "flagged", *lifecycle())


def states_of(cells: DataFrame) -> DataFrame:
    """``row_states`` from summaries."""
    return _facts_of(cells).select("entity_id", "state", "resurrected")


def counts_of(cells: DataFrame) -> DataFrame:
    """``change_counts`` from summaries."""
    return _facts_of(cells).select("entity_id", F.col("events").alias("changes"), F.col("changes").alias("set_changes"))


def kpis_of(cells: DataFrame, write_once: Sequence[str] = ()) -> DataFrame:
    """``kpis`` from summaries."""
    return _kpis(_facts_of(cells, write_once))


def page_keys(log: DataFrame) -> list[str]:
    """The columns that order events for paging: no two events of a capture share them."""
    return ["timestamp", "entity_id", "field", "snapshot_id" if "snapshot_id" in log.columns else "seq"]


def key_page(log: DataFrame, after: tuple | None, size: int, entities: Sequence[str] = (), fields: Sequence[str] = (), instant: Column | None = None) -> DataFrame:
    """``size`` events in order of ``page_keys``, strictly past the cursor ``after``, of some entities and fields if named."""
    log, keys = until(log, instant), page_keys(log)
    if entities:
        log = log.where(F.col("entity_id").isin(*entities))
    if fields:
        log = log.where(F.col("field").isin(*fields))
    if after is not None:
        # The first key alone, too: that reaches the files, a comparison of structs does not.
        log = log.where((F.col(keys[0]) >= F.lit(after[0])) & (F.struct(*keys) > F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, after, strict=True)])))
    return log.orderBy(*keys).limit(max(1, size))


def next_cursor(page: DataFrame) -> DataFrame:
    """The keys of a page's last event in one row; no row for an empty page, where the events end."""
    keys = page_keys(page)
    return page.agg(F.max(F.struct(*keys)).alias("k")).where("k is not null").select(*[F.col(f"k.{k}").alias(k) for k in keys])


def latest_by_row_number(log: DataFrame, instant: Column | None = None) -> DataFrame:
    """``latest_cells`` in its window form, with the entity's ``last_field`` beside each cell.

    Spark cuts the window to the first row of each cell before the shuffle.  Prefer ``latest_cells``.
    """
    own = until(log, instant).where(~is_deletion())
    newest = Window.partitionBy("entity_id", "field").orderBy(order(own).desc())
    rows = own.withColumn("rn", F.row_number().over(newest)).where("rn = 1")
    last = F.max_by("field", order(own)).over(Window.partitionBy("entity_id"))
    return rows.withColumn("last_field", last).select("entity_id", "field", "timestamp", "value", "last_field")


#: Estimates up to so many times a limit may be of a field within it: sketches err by a few hundredths at most.
MARGIN = 1.25


def field_sketches(log: DataFrame) -> DataFrame:
    """``field, sketch``: a sketch of the distinct values of each field, which ``merged_sketches`` adds to others."""
    values = log.where(~is_deletion() & F.col("value").isNotNull())
    return values.groupBy("field").agg(F.hll_sketch_agg(F.col("value").cast("string")).alias("sketch"))


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """One sketch a field from those of parts of a log."""
    return sketches.groupBy("field").agg(F.hll_union_agg("sketch").alias("sketch"))


def low_cardinality_values(log: DataFrame, most: int = 40, sketches: DataFrame | None = None) -> DataFrame:
    """``field, choices``: all values ever of fields that have at most ``most``, sorted.

    Sketches, ``log``'s own unless kept ones are given, tell which fields may be such; only their
    values are shuffled, and counted exactly.
    """
    known = field_sketches(log) if sketches is None else merged_sketches(sketches)
    likely = known.where(F.hll_sketch_estimate("sketch") <= most * MARGIN + 1).select("field")
    values = log.where(~is_deletion() & F.col("value").isNotNull()).select("field", "value")
    values = values.join(F.broadcast(likely), "field", "left_semi").distinct()
    few = values.groupBy("field").agg(F.array_sort(F.collect_list("value")).alias("choices"))
    return few.where(F.size("choices") <= most)


def any_null(columns: Sequence[str]) -> Column:
    """Whether any of ``columns`` is null; never for none."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns], F.lit(False))
