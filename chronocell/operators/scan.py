"""Running results over the rows of each key in order, without one task a key.

A window over a key is one task's work, however many rows the key has.  Here keys with more rows
than a range may have are found by a count; their rows alone are sorted by ranges and cut into
stretches; each stretch has its own window, a row a stretch tells what it hands on, and those rows
are what a window over the key reads.  Results are those of plain windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocell.sources.scratch import Scratch

#: Rows of a stretch at most, and of a key that one window takes.
ROWS = 1_000_000
#: Bytes, as Spark estimates them from the files below, of rows that no key can make too many for one task.
SMALL = 64 << 20


def estimated_bytes(rows: DataFrame) -> int:
    """Spark's estimate of the size of ``rows``, which takes no job."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class Scan:
    """Rows whose keys' windows are bounded: ``cold`` ones by key, ``hot`` ones, if any, by key and stretch."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int | None = None, small: int | None = None):
        """``order`` is total within a key but for rows that are alike; ``size`` and ``small`` stand for ``ROWS`` and ``SMALL``.

        Where ``rows`` are not small, one job counts the rows of each key, and those of hot keys are written
        in order to scratch.
        """
        self.keys, self.order = list(keys), list(order)
        self.cold, self.hot = rows, None
        size = ROWS if size is None else size
        if estimated_bytes(rows) <= (SMALL if small is None else small):
            return
        scratch = Scratch(rows.sparkSession, "scan")
        many = scratch.keep(rows.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size).drop("n"), "keys")
        if many.isEmpty():
            return
        same = self._same(many)
        # At most a key for each ``size`` rows: Spark broadcasts them by their written size.
        self.cold = rows.join(many, same(rows), "left_anti")
        hot = rows.join(many, same(rows), "left_semi").orderBy(*self.keys, *self.order)
        hot = scratch.keep(hot.withColumn("__place", F.monotonically_increasing_id()), "rows")
        self.hot = hot.withColumn("__range", F.expr(f"__place div {size}"))

    def _same(self, other: DataFrame, more: Sequence[str] = ()):
        def condition(rows: DataFrame) -> Column:
            out = F.lit(True)
            for k in [*self.keys, *more]:
                out = out & rows[k].eqNullSafe(other[k])
            return out

        return condition

    def add(self, previous: dict[str, tuple[Column, int]] | None = None, filled: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> Scan:
        """The rows with more columns, each as a window in order gives it.

        ``previous`` has values of so many rows before (null where there is none), ``filled`` the last value that
        is not null up to the row, ``sums`` the running sums, the row included.
        """
        previous, filled, sums = previous or {}, filled or {}, sums or {}
        out = object.__new__(Scan)
        out.keys, out.order = self.keys, self.order
        out.cold = self._local(self.cold, self.keys, self.order, previous, filled, sums)
        out.hot = None if self.hot is None else self._carried(previous, filled, sums)
        return out

    @staticmethod
    def _local(rows: DataFrame, group: Sequence[str], order: Sequence[Column], previous: dict, filled: dict, sums: dict) -> DataFrame:
        w = Window.partitionBy(*group).orderBy(*order)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        columns = {name: F.lag(value, n).over(w) for name, (value, n) in previous.items()}
        columns |= {name: F.last(value, ignorenulls=True).over(upto) for name, value in filled.items()}
        columns |= {name: F.sum(value).over(upto) for name, value in sums.items()}
        return rows.withColumns(columns)

    def _carried(self, previous: dict, filled: dict, sums: dict) -> DataFrame:
        stretch, place = [*self.keys, "__range"], F.col("__place")
        w = Window.partitionBy(*stretch)
        rows = self._local(self.hot, stretch, [place], previous, filled, sums).withColumn("__at", F.row_number().over(w.orderBy(place)))
        furthest = max([n for _, n in previous.values()], default=1)
        # What a stretch hands on: its last rows' values, newest first, its last values that are not null, its sums.
        counted = self.hot.withColumn("__left", F.row_number().over(w.orderBy(place.desc())))
        ends = {f"p:{name}": F.reverse(F.array_sort(F.collect_list(F.when(F.col("__left") <= furthest, F.struct("__place", value.alias("v")))))) for name, (value, _) in previous.items()}
        ends |= {f"f:{name}": F.max_by(value, F.when(value.isNotNull(), place)) for name, value in filled.items()}
        ends |= {f"s:{name}": F.sum(value) for name, value in sums.items()}
        totals = counted.groupBy(*stretch).agg(*[c.alias(name) for name, c in ends.items()])
        before = Window.partitionBy(*self.keys).orderBy("__range")
        earlier = before.rowsBetween(Window.unboundedPreceding, -1)
        # A stretch but the first of its key has all the rows that a stretch may have, so one before is enough.
        carry = {f"p:{name}": F.lag(F.col(f"`p:{name}`")).over(before) for name in previous}
        carry |= {f"f:{name}": F.last(F.col(f"`f:{name}`"), ignorenulls=True).over(earlier) for name in filled}
        carry |= {f"s:{name}": F.sum(F.col(f"`s:{name}`")).over(earlier) for name in sums}
        carries = totals.select(*stretch, *[c.alias(name) for name, c in carry.items()])
        both = rows.join(carries, self._same(carries, ["__range"])(rows), "left").drop(*[carries[c] for c in stretch])
        columns = {name: F.when(F.col("__at") > n, F.col(name)).otherwise(F.get(F.col(f"`p:{name}`"), (F.lit(n) - F.col("__at")).cast("int"))["v"]) for name, (_, n) in previous.items()}
        columns |= {name: F.coalesce(F.col(name), F.col(f"`f:{name}`")) for name in filled}
        columns |= {name: F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"`s:{name}`"), F.lit(0)) for name in sums}
        return both.withColumns(columns).drop("__at", *carry)

    def rows(self) -> DataFrame:
        """All rows, hot and cold."""
        return self.cold if self.hot is None else self.cold.unionByName(self.hot.drop("__place", "__range"))
