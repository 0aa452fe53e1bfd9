"""Filters over views and over entities."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronocell.operators import log as L


def equals(view: DataFrame, wanted: dict) -> DataFrame:
    """Rows with the given values.  Unknown columns are ignored; null cells meet nothing.

    A callable that makes a condition of the column stays with Spark.  Any other gets the values,
    one at a time and never null, and tells by its truth which rows stay; one marked by
    ``over_batches`` gets an iterator of Arrow arrays and gives one of booleans, so that what it sets
    up serves many rows.  Where it raises, the query fails with a message that names the column.
    """
    for name, value in wanted.items():
        if name in view.columns:
            column = F.col(f"`{name}`")
            view = view.where(_condition(name, column, value) if isinstance(value, Callable) else column == value)
    return view


def over_batches(predicate: Callable) -> Callable:
    """Marks a predicate of ``equals`` that gets an iterator of Arrow arrays."""
    predicate.over_batches = True
    return predicate


def _condition(name: str, column: Column, predicate: Callable) -> Column:
    """What ``predicate`` says of a column: its own condition, or an Arrow function over values."""
    batches = getattr(predicate, "over_batches", False)
    if not batches:
        try:
            if isinstance(made := predicate(column), Column):
                return made
        except Exception:  # noqa: BLE001  a predicate over values may raise anything for a column
            pass

    def judged(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            if batches:
                yield from (pa.array(x, pa.bool_()) for x in predicate(arrays))
            else:
                for values in arrays:
                    yield pa.array([v is not None and bool(predicate(v)) for v in values.to_pylist()], pa.bool_())
        except Exception as e:
            raise BadFilter(f"the filter of column {name!r} failed: {type(e).__name__}: {e}") from e

    return column.isNotNull() & F.coalesce(F.arrow_udf(judged, "boolean")(column), F.lit(False))


def with_nulls(view: DataFrame, key: str, column: str | None = None) -> DataFrame:
    """Rows where ``column`` is null; where any but the key is, if there is no such column."""
    if column in view.columns:
        return view.where(F.col(f"`{column}`").isNull())
    return view.where(L.any_null([f"`{c}`" for c in view.columns if c != key]))


#: What filters see of every entity; a field of such a name cannot be seen (fixed names of the views).
META = ("id", "changes", "deleted", "resurrected", "flagged")


def filter_rows(log: DataFrame, fields: Sequence[str], write_once: Sequence[str] = ()) -> DataFrame:
    """What filters see of each entity at the log's end: last cells, and the columns of ``META``; ``state`` is a field like any."""
    seen = [f for f in fields if f.lower() not in META]
    view = L.temporal_view(log, seen)
    state, resurrected = L.lifecycle_names(seen)
    counts = L.change_counts(log).select("entity_id", F.col("set_changes").alias("changes"))
    flagged = L.violations(log, write_once).select("entity_id").distinct() if write_once else counts.select("entity_id").limit(0)
    rows = view.alias("v").join(counts.alias("c"), "entity_id").join(flagged.withColumn("bad", F.lit(True)).alias("f"), "entity_id", "left")
    return rows.select(
        F.col("entity_id").alias("id"),
        F.col(f"v.{resurrected}").alias("resurrected"),
        *[F.col(f"v.`{f}`").alias(f) for f in seen],
        F.col("c.changes").alias("changes"),
        (F.col(f"v.{state}") == "deleted").alias("deleted"),
        F.coalesce(F.col("f.bad"), F.lit(False)).alias("flagged"),
    )


class BadFilter(ValueError):
    """The text is no condition over the rows' columns."""


def where(rows: DataFrame, text: str) -> DataFrame:
    """Rows that meet an SQL condition; ``BadFilter`` where it cannot be read or names no column."""
    try:
        return rows.where(F.expr(text)) if text.strip() else rows
    except (ParseException, AnalysisException) as e:
        raise BadFilter(str(e).split("\n")[0]) from e


def simple(column: str | None = None, value=None, least=None, most=None, min_changes: int = 0, id_contains: str = "", deleted: bool | None = None, resurrected: bool | None = None, flagged: bool | None = None) -> Column:
    """The conjunction of what is given."""
    out = F.lit(True)
    if column is not None:
        c = F.col(f"`{column}`")
        out = out & (c == value) if value is not None else out
        out = out & (c >= least) if least is not None else out
        out = out & (c <= most) if most is not None else out
    if min_changes:
        out = out & (F.col("changes") >= min_changes)
    if id_contains:
        out = out & F.col("id").contains(id_contains)
    for name, wanted in (("deleted", deleted), ("resurrected", resurrected), ("flagged", flagged)):
        if wanted is not None:
            out = out & (F.col(name) == wanted)
    return out
