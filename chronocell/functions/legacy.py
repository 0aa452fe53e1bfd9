"""Cells that hold their own history as JSON text, the older form of a mirror table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY = "array<struct<date:string,value:string>>"


#: The form of dates in histories, as a pattern, and what stands for null (fixed values of the form).
DATE, NULL = "yyyy-MM-dd HH:mm:ss", "NULL"
MODES = ("new", "serialized", "compare")


def as_text(value: Column, kind: T.DataType | None = None) -> Column:
    """``NULL`` for null, timestamps (by ``kind``) to the second, else the trimmed text."""
    text = F.date_format(value, DATE) if isinstance(kind, T.TimestampType | T.TimestampNTZType) else value.cast("string")
    return F.coalesce(F.trim(text), F.lit(NULL))


def wrapped(value: Column, date: Column) -> Column:
    """A history of one entry."""
    return F.array(F.struct(date.cast("string").alias("date"), as_text(value).alias("value")))


def is_history(text: Column) -> Column:
    """Whether a text is a JSON list of entries that all have a date and a value."""
    entries = F.from_json(text, "array<map<string,string>>")
    whole = F.forall(entries, lambda e: F.map_contains_key(e, "date") & F.map_contains_key(e, "value"))
    return F.coalesce(entries.isNotNull() & whole, F.lit(False))


def history(text: Column, date: Column) -> Column:
    """The history in a cell: parsed if it is one, one level of nesting flattened, else the cell wrapped."""
    nested = F.flatten(F.from_json(text, f"array<{HISTORY}>"))
    deep = text.startswith("[[") & nested.isNotNull()
    return F.when(is_history(text), F.from_json(text, HISTORY)).when(deep, nested).otherwise(wrapped(text, date))


def is_valid(cell: Column) -> Column:
    """Whether every entry of a parsed history has a date of the form ``yyyy-MM-dd HH:mm:ss`` and a value."""
    shape = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
    return F.coalesce(F.forall(cell, lambda e: e["date"].rlike(shape) & e["value"].isNotNull()), F.lit(False))


def as_of(cell: Column, date: Column) -> Column:
    """The value of the last entry not after ``date``, whatever the entries' order; the later of equal dates."""
    pairs = F.transform(cell, lambda e, i: F.struct(e["date"].alias("date"), i.alias("place"), e["value"].alias("value")))
    return F.array_max(F.filter(pairs, lambda e: e["date"] <= date))["value"]


def initial(cell: Column, kind: T.DataType, date: Column, mode: str = "new") -> Column:
    """The history that a table's cell begins with; ``ValueError`` for an unknown ``mode``.

    A text that is a history already, as it stands or nested once, is taken.  Else the value is
    wrapped: in ``new`` as ``as_text`` has it, in ``serialized`` as its text untouched, in
    ``compare`` texts that are JSON scalars as what they hold (strings without their quotes).
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}: one of {', '.join(MODES)}")
    text = cell.cast("string")
    value = as_text(cell, kind)
    if mode == "serialized":
        value = F.coalesce(text, F.lit(NULL))
    elif mode == "compare" and isinstance(kind, T.StringType):
        value = F.coalesce(F.trim(F.when(text.rlike(r'^\s*".*"\s*$'), F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v"))), F.when(F.trim(text) == "null", NULL), value)
    found = history(text, date)
    is_one = is_history(text) | (text.startswith("[[") & F.from_json(text, f"array<{HISTORY}>").isNotNull())
    return F.when(F.coalesce(is_one, F.lit(False)), found).otherwise(F.array(F.struct(date.cast("string").alias("date"), value.alias("value"))))


def normalised(cell: Column) -> Column:
    """A history with its dates in one form and ``NULL`` for nulls; a date that is none fails the query.

    Null and empty histories are empty.
    """
    def entry(e: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(F.trim(e["date"]), r"^(\d{4}-\d{2}-\d{2})T", "$1 "), r"(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$", "")
        plain = F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(plain, F.lit(" 00:00:00"))).when(plain.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"), F.concat(plain, F.lit(":00"))).otherwise(plain)
        good = plain.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$") & F.try_to_timestamp(plain, F.lit(DATE)).isNotNull()
        bad = F.raise_error(F.concat(F.lit("not a date of a history: "), F.coalesce(e["date"], F.lit("null")))).cast("string")
        return F.struct(F.when(F.coalesce(good, F.lit(False)), plain).otherwise(bad).alias("date"), F.coalesce(e["value"], F.lit(NULL)).alias("value"))

    return F.coalesce(F.transform(cell, entry), F.array().cast(HISTORY))


def validated(text: Column, date: Column) -> Column:
    """A column's cells as normalised histories: items that are no entry are wrapped, lists within the list fail the query."""
    items = F.from_json(text, "array<string>")

    def entry(item: Column) -> Column:
        nested = F.raise_error(F.lit("a history within a history")).cast("struct<date:string,value:string>")
        own = F.from_json(item, "struct<date:string,value:string>")
        wrap = F.struct(date.cast("string").alias("date"), item.alias("value"))
        return F.when(item.startswith("["), nested).when(item.startswith("{"), own).otherwise(wrap)

    return normalised(F.transform(F.coalesce(items, F.array().cast("array<string>")), entry))
