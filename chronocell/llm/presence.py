"""A bounded, broadcast filter that tells rows apart from a set of keys before they are shuffled.

One bit a hash value: a key that is in the set always passes, others pass as seldom as the
filter is empty.  It is never larger than ``BITS`` bits, however many keys there are; a full one
filters nothing, and what follows it must not rely on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 MiB of bits, as at most 2**18 rows of two longs.
BITS = 1 << 24


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def presence(keys: DataFrame) -> DataFrame:
    """``presence_word, presence_bits`` of the only column of ``keys``."""
    place = keys.toDF("key").select(_place(F.col("key")).alias("place"))
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    return place.groupBy(F.expr("place div 64").alias("presence_word")).agg(F.bit_or(bit).alias("presence_bits"))


def may_be_in(rows: DataFrame, key: str, seen: DataFrame) -> tuple[DataFrame, Column]:
    """``rows`` beside the filter's word of their ``key``, and whether the key may be in the set.

    Every row stays; the condition is never null.
    """
    place = _place(F.col(key))
    out = rows.join(F.broadcast(seen), F.floor(place / 64) == F.col("presence_word"), "left")
    bit = F.call_function("shiftright", F.col("presence_bits"), F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1))
    return out, F.coalesce(bit == 1, F.lit(False))
