"""Bounded samples of texts that every run draws alike, and the names that helpers may use."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocell.sources.scratch import Scratch


def text_key(text: Column, seed: int) -> Column:
    """A text's place in the order that samples are drawn in."""
    return F.xxhash64(text, F.lit(seed))


def lowest_texts(docs: DataFrame, n: int, seed: int, by: str | None = None) -> DataFrame:
    """``key``, ``text`` and ``by`` of the ``n`` distinct texts with the lowest keys, of each ``by``.

    ``docs`` has columns ``text`` and ``by``, neither null.  Ids play no part, so rows that share
    an id are drawn as any others, and copies of a text are one row however many they are: the
    result never has more than ``n`` rows (a ``by``).  Only the keys of all rows are shuffled;
    texts move once they are known to be among the lowest.
    """
    group = [by] if by else []
    keyed = docs.select(*group, text_key(F.col("text"), seed).alias("key"), "text")
    keys = keyed.select(*group, "key").distinct()
    if by:
        place = F.row_number().over(Window.partitionBy(by).orderBy("key"))
        upto = keys.withColumn("place", place).where(F.col("place") <= n).groupBy(by).agg(F.max("key").alias("upto"))
        # Written, a row a group has its true size, by which Spark broadcasts it; texts must not move by group.
        upto = Scratch(docs.sparkSession, "sample").keep(upto, "upto")
        low = keyed.join(upto, by).where("key <= upto")
    else:
        upto = keys.orderBy("key").limit(n).agg(F.max("key")).first()[0]
        low = keyed.where(F.col("key") <= F.lit(upto).cast("long"))
    return low.groupBy(*group, "key").agg(F.min("text").alias("text"))


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or the first of ``name_1``, ``name_2``... that no column of ``taken`` has, compared without case."""
    used = {t.lower() for t in taken}
    out, k = name, 0
    while out.lower() in used:
        k += 1
        out = f"{name}_{k}"
    return out
