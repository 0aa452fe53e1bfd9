"""Cell values as canonical text with a type tag, and back."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tags of primitive types, as written in stores (fixed values of the format).
TAGS = {T.LongType: "int64", T.IntegerType: "int32", T.ShortType: "int16", T.ByteType: "int8", T.DoubleType: "float64", T.FloatType: "float32", T.BooleanType: "bool", T.StringType: "utf8", T.TimestampType: "datetime[us, UTC]", T.TimestampNTZType: "datetime[us, UTC]", T.NullType: "null"}


def utc(t: dt.datetime) -> dt.datetime:
    """In UTC; a time without a zone is taken to be in it."""
    return t.replace(tzinfo=dt.UTC) if t.tzinfo is None else t.astimezone(dt.UTC)


def tag(kind: T.DataType) -> str:
    return TAGS.get(type(kind), kind.simpleString())


def _time_text(us: Column) -> Column:
    """ISO text in UTC of microseconds since 1970, by arithmetic alone, so no session zone plays a part."""
    day, rest = F.floor(us / 86_400_000_000), F.pmod(us, F.lit(86_400_000_000))
    seconds, part = F.floor(rest / 1_000_000), rest % 1_000_000

    def two(n: Column) -> Column:
        return F.lpad(n.cast("string"), 2, "0")

    clock = F.concat_ws(":", two(F.floor(seconds / 3600)), two(F.floor(seconds / 60) % 60), two(seconds % 60))
    fraction = F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0")))
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string"), F.lit("T"), clock, fraction, F.lit("+00:00"))


def _float_text(value: Column) -> Column:
    """Plain digits from 0.0001 up to 16 places ahead of the point, else with an exponent of two digits at least: ``1e-07``.

    Digits are the JVM's: before version 19 it has at times one more than the shortest that reads back.
    Each branch has the value's text once: a text that is used over and over makes code too long to compile.
    """
    text, size = value.cast("string"), F.abs(value)
    as_is = (size == 0) | size.between(F.lit(1e-3), F.lit(9999999.999999998))
    # The text has an exponent here that the form does not: all its digits fit a decimal.
    near = size.between(F.lit(1e7), F.lit(9999999999999998.0)) | ((size >= 1e-4) & (size < 1e-3))
    digits = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    science = F.regexp_replace(F.regexp_replace(text, r"(\.0)?E(\d)", r"e+$2"), r"(\.0)?E-", "e-")
    science = F.regexp_replace(science, r"e-(\d)$", r"e-0$1")
    special = F.when(F.isnan(value), "nan").when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
    return F.when(value.isNull() | as_is, text).when(near, digits).otherwise(F.coalesce(special, science))


def encoded(value: Column, kind: T.DataType) -> Column:
    """The canonical text of a value: equal values have equal texts, whatever the session's zone.

    A timestamp without a zone is taken to be in UTC.
    """
    if isinstance(kind, T.TimestampType):
        return _time_text(F.unix_micros(value))
    if isinstance(kind, T.TimestampNTZType):
        return _time_text(F.datediff(F.to_date(value), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000 + (F.hour(value) * 3600 + F.minute(value) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("long"))
    if isinstance(kind, T.StructType | T.ArrayType | T.MapType | T.VariantType):
        return F.to_json(value)
    if isinstance(kind, T.DoubleType | T.FloatType):
        return _float_text(value.cast("double"))
    return value.cast("string")


def decoded(text: Column, kind: str) -> Column:
    """A value from its text by tag; whole numbers widen to long, other types stay text."""
    if kind.startswith("int"):
        return text.try_cast("long")
    if kind.startswith("float"):
        return text.try_cast("double")
    if kind == "bool":
        return F.when(text.isNotNull(), F.lower(F.trim(text)) == "true")
    if kind.startswith("datetime"):
        return text.try_cast("timestamp")
    return text


def snapshot_digest(text: DataFrame, key: str) -> str:
    """16 hex digits of a snapshot's content, whatever the order of its rows and columns and its partitions.

    Each row's cells, with lengths and nulls told apart, are hashed; count and sums of the
    hashes are the content, so no sort is needed.
    """
    columns = [key, *sorted(c for c in text.columns if c != key)]
    cells = [F.coalesce(F.concat(F.length(F.col(f"`{c}`")).cast("string"), F.lit(":"), F.col(f"`{c}`")), F.lit("-")) for c in columns]
    row = text.select(F.sha2(F.concat_ws("|", *cells), 256).alias("h"))
    half = [F.sum(F.conv(F.substring("h", k, 15), 16, 10).cast("decimal(38,0)")) for k in (1, 16)]
    found = row.agg(F.count(F.lit(1)), *half).first()
    return hashlib.sha256("|".join(str(x) for x in found).encode()).hexdigest()[:16]
