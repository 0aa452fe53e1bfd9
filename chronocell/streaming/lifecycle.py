"""Lifecycle state and live cells of every entity of a stream of events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from chronocell.operators.log import DELETED, is_deletion

#: The state store that typed state needs (fixed name).
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What is set where Spark aggregates.  To count its rows a store would look each key up again that it puts; and
#: all stores of an executor share one bound of memory (Spark's default size), else each that is open has a cache.
AGGREGATING = {"spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": False, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": True}
OUTPUT = "entity_id string, state string, resurrected boolean, cells map<string,string>"
#: Places of events in the total order: instant, capture, deletions last.
PLACE = "at long, seq int, last boolean"


def _place(row) -> tuple:
    return row["at"], row["seq"], row["field"] == DELETED


class _Lifecycle(StatefulProcessor):
    """Per entity: the bounds of its deletions and sets, and each cell's last event; events may come in any order.

    Instants are microseconds since 1970, and so is ``keep``.
    """

    def __init__(self, keep: int | None):
        self._keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._first_deletion = handle.getValueState("first_deletion", PLACE)
        self._last_deletion = handle.getValueState("last_deletion", PLACE)
        self._last_set = handle.getValueState("last_set", PLACE)
        self._cells = handle.getMapState("cells", "field string", f"{PLACE}, value string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last: dict[str, tuple[tuple, str | None]] = {}
        deletions, sets = [], []
        for row in rows:
            place = _place(row)
            if row["field"] == DELETED:
                deletions.append(place)
                continue
            sets.append(place)
            if row["field"] not in last or place > last[row["field"]][0]:
                last[row["field"]] = place, row["value"]
        for state, places, better in ((self._first_deletion, deletions, min), (self._last_deletion, deletions, max), (self._last_set, sets, max)):
            if places:
                own = [tuple(state.get())] if state.exists() else []
                state.update(better(own + places))
        for field, (place, value) in last.items():
            if not self._cells.containsKey((field,)) or tuple(self._cells.getValue((field,)))[:3] < place:
                self._cells.updateValue((field,), (*place, value))
        state = self._state()
        if self._keep is not None and state == "deleted":
            self._handle.registerTimer((self._last_deletion.get()[0] + self._keep) // 1000)
        yield self._row(key, state)

    def _state(self) -> str:
        deleted = self._last_deletion.exists() and (not self._last_set.exists() or tuple(self._last_deletion.get()) > tuple(self._last_set.get()))
        return "deleted" if deleted else "active"

    def _row(self, key, state: str) -> Row:
        back = self._first_deletion.exists() and self._last_set.exists() and tuple(self._last_set.get()) > tuple(self._first_deletion.get())
        return Row(entity_id=key[0], state=state, resurrected=back, cells={field[0]: cell[3] for field, cell in self._cells.iterator()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """An entity that has been gone for long lets its cells go; its lifecycle stays."""
        if self._state() == "deleted":
            self._cells.clear()
            yield self._row(key, "deleted")

    def close(self) -> None:
        pass


def _of_fields(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``row_states`` as one aggregate: an entity's state is a row with the last event of each of ``fields`` as a column."""
    # Of one capture's events an entity's deletion comes last, so places without ``last`` are enough here.
    place = F.struct("at", "seq")
    cells = {f: f"cell_{k}" for k, f in enumerate(dict.fromkeys(fields))}
    kept = rows.groupBy("entity_id").agg(
        F.min(F.when(is_deletion(), place)).alias("first_deletion"),
        F.max(F.when(is_deletion(), place)).alias("last_deletion"),
        F.max(F.when(~is_deletion(), place)).alias("last_set"),
        *[F.max(F.when(F.col("field") == f, F.struct("at", "seq", "value"))).alias(c) for f, c in cells.items()],
    )
    deleted = F.coalesce(F.col("last_deletion") >= F.col("last_set"), F.col("last_deletion").isNotNull())
    back = F.coalesce(F.col("last_set") > F.col("first_deletion"), F.lit(False))
    pairs = [F.when(F.col(c).isNotNull(), F.struct(F.lit(f).alias("key"), F.col(f"{c}.value").alias("value"))) for f, c in cells.items()]
    set_cells = F.map_from_entries(F.filter(F.array(*pairs), lambda x: x.isNotNull())) if pairs else F.create_map().cast("map<string,string>")
    return kept.select("entity_id", F.when(deleted, "deleted").otherwise("active").alias("state"), back.alias("resurrected"), set_cells.alias("cells"))


def row_states(events: DataFrame, keep: str | None = None, fields: Sequence[str] | None = None) -> DataFrame:
    """``entity_id, state, resurrected, cells`` of the entities that a batch of ``events`` touches, for output mode ``update``.

    ``events`` are a stream of ``entity_id, timestamp, field, value, seq``.  The last row of each entity
    is what ``log.row_states`` says of all its events, and its last cells, in whatever order they came.
    State survives restarts.  Where the ``fields`` are named (a store's are ``Store.fields``) it is a row an
    entity that Spark aggregates itself, which is what large tables need: ``cells`` has those fields, they
    stay the same from start to start, and ``AGGREGATING`` is set in the session.  Else it is a row a cell, fields may be any, and each entity of a batch
    costs some ten calls between Python and the state store.  With ``keep`` (an interval) the cells of entities
    that are gone for so long are dropped, and events later than that after others are not taken; that goes
    without ``fields`` only.
    """
    if keep is not None and fields is not None:
        raise ValueError("keep goes with fields of any name only")
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.select("entity_id", "timestamp", F.unix_micros("timestamp").alias("at"), "field", "value", "seq")
    if fields is not None:
        for name, value in AGGREGATING.items():
            spark.conf.set(name, value)
        return _of_fields(rows, fields)
    if keep is None:
        return rows.groupBy("entity_id").transformWithState(_Lifecycle(None), OUTPUT, "Update", "None")
    micros = spark.sql(f"SELECT unix_micros(TIMESTAMP_LTZ '1970-01-02 00:00:00 UTC' + INTERVAL '0' SECOND + INTERVAL {keep}) - unix_micros(TIMESTAMP_LTZ '1970-01-02 00:00:00 UTC')").first()[0]
    rows = rows.withWatermark("timestamp", keep)
    return rows.groupBy("entity_id").transformWithState(_Lifecycle(micros), OUTPUT, "Update", "EventTime")
