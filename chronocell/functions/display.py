"""Texts and positions of values as views show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands for null, and the faintest and the added opacity of a bucket (fixed values of the views).
NULL_MARK = "ø"
FAINTEST, ADDED = 0.16, 0.72


def shown(value: Column, kind: T.DataType) -> Column:
    """Null as its mark, times as their day, everything else as its text."""
    text = F.date_format(value, "yyyy-MM-dd") if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType) else value.cast("string")
    return F.coalesce(text, F.lit(NULL_MARK))


def shown_delta(delta: Column) -> Column:
    """A signed number of at most four decimals without closing zeros; null for null."""
    value = F.round(delta.cast("double"), 4)
    whole = F.format_string("%.4f", F.abs(value))
    trimmed = F.regexp_replace(F.regexp_replace(whole, "0+$", ""), r"\.$", "")
    return F.when(delta.isNotNull(), F.concat(F.when(value < 0, "-").otherwise("+"), trimmed))


def stamp_ms(t: Column) -> Column:
    """A time as written, to the millisecond, with ``Z``."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def opacity(count: Column, most: Column) -> Column:
    """0 for nothing, else from the faintest up to that and the added for the fullest bucket."""
    return F.when((count > 0) & (most > 0), F.lit(FAINTEST) + F.lit(ADDED) * (count / most)).otherwise(F.lit(0.0))


def percent_along(at: Column, first: Column, last: Column) -> Column:
    """How far ``at`` is from ``first`` to ``last``, kept from 0 to 100; all numbers."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (at - first) / F.greatest(last - first, F.lit(1)) * 100))


def runtime(seconds: Column) -> Column:
    """``1h 2m 3s``, without parts ahead of the first that is not 0."""
    s = F.floor(seconds)
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    tail = F.concat((s % 60).cast("string"), F.lit("s"))
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m "), tail)).when(m > 0, F.concat(m.cast("string"), F.lit("m "), tail)).otherwise(tail)
