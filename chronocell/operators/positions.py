"""Texts joined to the patterns that occur in them, by an inverted index and without pairing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of the grams of the index; shorter patterns have indexes of their own.
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """The distinct substrings of length ``n``; none for a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))))


def position_join(texts: DataFrame, text_col: str, patterns: DataFrame, pattern_col: str, gram: int | None = None) -> DataFrame:
    """The rows of ``texts`` beside the rows of ``patterns`` whose pattern occurs in their text, and its first ``position`` from 1.

    Each distinct text is indexed by its grams.  A pattern of at least ``gram`` letters is looked up by the one of
    its grams that the fewest texts have; only those texts are searched.  One that is shorter is a gram of its own
    length and meets just the texts that have it.  Null and empty patterns and null texts meet nothing; rows that
    repeat are each joined; letters are compared as they are.  Columns of both sides stay; those that both have,
    or that are called ``position``, are ambiguous in the result as after any join.
    """
    n = GRAM if gram is None else gram
    left, right = texts.withColumn("__text", F.col(f"`{text_col}`").cast("string")), patterns.withColumn("__pattern", F.col(f"`{pattern_col}`").cast("string"))
    # Texts and patterns move once each, under digests; grams go with those alone.
    whole = left.select("__text").where("__text is not null").distinct().withColumn("t", F.md5(F.col("__text").cast("binary")))
    wanted = right.select("__pattern").where("__pattern <> ''").distinct()
    long, short = wanted.where(F.length("__pattern") >= n), wanted.where(F.length("__pattern") < n)

    index = whole.select("t", F.explode(_grams(F.col("__text"), n)).alias("gram"))
    frequent = index.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    asked = long.select("__pattern", F.explode(_grams(F.col("__pattern"), n)).alias("gram"))
    rated = asked.join(frequent, "gram", "left").groupBy("__pattern").agg(
        F.min_by("gram", F.struct("texts", "gram")).alias("gram"),
        F.bool_or(F.col("texts").isNull()).alias("unknown"),
    )
    found = rated.where("not unknown").select("__pattern", "gram").join(index, "gram").select("__pattern", "t")

    # Texts are indexed by shorter grams only for the lengths, fewer than ``n``, that patterns have.
    for (k,) in short.select(F.length("__pattern")).distinct().collect():
        pieces = whole.select("t", F.explode(_grams(F.col("__text"), k)).alias("__pattern"))
        found = found.unionByName(pieces.join(short, "__pattern").select("__pattern", "t"))
    met = found.join(whole, "t").withColumn("position", F.expr("locate(__pattern, __text)")).where("position > 0").select("__pattern", "__text", "position")
    return left.join(met, "__text").join(right, "__pattern").drop("__text", "__pattern")
