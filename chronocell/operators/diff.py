"""Keyed differences between snapshots, as change events and as counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronocell.operators.log import DELETED


def composite_key(keys: Sequence[str]) -> Column:
    """``a|b|c`` of the keys' texts, nulls empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys])


#: Types whose values differ just where their texts do.
PLAIN = (T.IntegralType, T.StringType, T.BooleanType, T.DateType)


def _sides(before: DataFrame, after: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    """Both snapshots in one row a key: ``key, old.*, new.*``; and the columns compared.

    Columns of one plain type on both sides stay as they are, for only changed cells need a text.
    """
    columns = sorted({*before.columns, *after.columns} - {key})
    kinds = [{f.name: f.dataType for f in df.schema.fields} for df in (before, after)]
    plain = {c for c in columns if kinds[0].get(c) == kinds[1].get(c) and isinstance(kinds[0].get(c), PLAIN)}

    def cell(df: DataFrame, c: str) -> Column:
        if c not in df.columns:
            return F.lit(None).cast("string")
        return F.col(f"`{c}`") if c in plain else F.col(f"`{c}`").cast("string")

    def packed(df: DataFrame, side: str) -> DataFrame:
        cells = [cell(df, c).alias(c) for c in columns]
        return df.select(F.col(f"`{key}`").alias("key"), (F.struct(*cells) if cells else F.struct(F.lit(0))).alias(side))

    return packed(before, "old").join(packed(after, "new"), "key", "full_outer"), columns


def classed_events(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``entity_id, field, value, kind``: ``diff_events`` with ``insert``, ``update`` or ``delete``, from one full outer join."""
    both, columns = _sides(before, after, key)
    cell = "struct<field:string,value:string>"

    def kept(c: str) -> Column:
        old, new = F.col(f"old.`{c}`"), F.col(f"new.`{c}`")
        return F.when(~old.eqNullSafe(new), F.struct(F.lit(c).alias("field"), new.cast("string").alias("value")))

    changed = F.filter(F.array(*[kept(c) for c in columns]) if columns else F.array().cast(f"array<{cell}>"), lambda x: x.isNotNull())
    gone = F.array(F.struct(F.lit(DELETED).alias("field"), F.lit(None).cast("string").alias("value")))
    events = F.when(F.col("new").isNull(), gone).otherwise(changed)
    rows = both.where(F.col("old").isNull() | F.col("new").isNull() | ~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "insert").otherwise("update")
    return rows.select(F.col("key").cast("string").alias("entity_id"), kind.alias("kind"), F.inline(events).alias("field", "value")).select("entity_id", "field", "value", "kind")


def diff_events(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``entity_id, field, value``: what turns ``before`` into ``after``.

    A new key gives its non-null cells, a common one its changed cells (nulls compared as
    values), a missing one a deletion.  A column that only one side has counts as null on the other.
    """
    return classed_events(before, after, key).drop("kind")


def changed_keys(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Common keys whose rows differ in any column."""
    both, _ = _sides(before, after, key)
    rows = both.where(F.col("old").isNotNull() & F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new")))
    return rows.select(F.col("key").alias(key))


def classify(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key`` and ``change``: ``ADD``, ``DROP``, ``CHG`` or ``SAME``, by the columns both have."""
    shared = [c for c in before.columns if c in after.columns]
    both, _ = _sides(before.select(*shared), after.select(*shared), key)
    change = F.when(F.col("old").isNull(), "ADD").when(F.col("new").isNull(), "DROP").when(~F.col("old").eqNullSafe(F.col("new")), "CHG").otherwise("SAME")
    return both.select(F.col("key").alias(key), change.alias("change"))


def compare_counts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: ``n_before, n_after, added, dropped, changed, unchanged``."""
    kinds = classify(before, after, key)
    count = {k: F.count_if(F.col("change") == k) for k in ("ADD", "DROP", "CHG", "SAME")}
    both = count["CHG"] + count["SAME"]
    return kinds.agg((both + count["DROP"]).alias("n_before"), (both + count["ADD"]).alias("n_after"), count["ADD"].alias("added"), count["DROP"].alias("dropped"), count["CHG"].alias("changed"), count["SAME"].alias("unchanged"))


def tombstones(live: DataFrame, key: str, dropped: Sequence[str]) -> DataFrame:
    """``entity_id, field, value``: a null for every live, non-null cell of columns that went."""
    cells = F.filter(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in dropped]), lambda x: x.isNotNull())
    rows = live.select(F.col(f"`{key}`").cast("string").alias("entity_id"), F.explode(cells).alias("field"))
    return rows.withColumn("value", F.lit(None).cast("string"))


def returned_nulls(gone: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``entity_id, field, value``: a null for every cell that is null in ``after`` and was not where its row went."""
    shared = [c for c in gone.columns if c in after.columns and c != key]
    lost = [F.when(F.col(f"old.`{c}`").isNotNull() & F.col(f"new.`{c}`").isNull(), F.lit(c)) for c in shared]
    cells = F.filter(F.array(*lost).cast("array<string>"), lambda x: x.isNotNull())
    both = gone.alias("old").join(after.alias("new"), F.col(f"old.`{key}`") == F.col(f"new.`{key}`"))
    rows = both.select(F.col(f"new.`{key}`").cast("string").alias("entity_id"), F.explode(cells).alias("field"))
    return rows.withColumn("value", F.lit(None).cast("string"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def keep_first(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row a key: the first in the order of ``by``, as a partial aggregate rather than a sort."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*by)).alias("r")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"r.`{c}`").alias(c) for c in rest])
