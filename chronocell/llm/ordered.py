"""Long groups in order without one task a group.

Rows are sorted once, by ranges, and numbered as they lie; runs of a group's rows become chunks of
bounded length.  What a chunk does to a running result is a small row; such rows, a chunk each, are
what a group's one task reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk at most; it begins at a place that this number divides or with its group.
CHUNK = 1024


def beginning(text: Column) -> Column:
    """What of a text takes part in sorting: long texts need not move to where ranges are drawn from samples."""
    return F.left(text, F.lit(64))


def placed(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """``rows`` in order of ``keys`` with ``place``, a number that grows along the order."""
    return rows.orderBy(*keys).withColumn("place", F.monotonically_increasing_id())


def chunk() -> Column:
    """The chunk of a row of ``placed``, in order: the chunks of a group are those with its key."""
    return F.expr(f"place div {CHUNK}")


def streamed(rows: DataFrame, by: list[str], then: list[str], run: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """What ``run`` makes of the rows of each partition, whole groups of ``by`` in order of ``then``; a row at a time."""
    return per_row(rows.repartition(*by).sortWithinPartitions(*by, *then), run, schema)


def per_row(rows: DataFrame, run: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, most: int = 2000) -> DataFrame:
    """What ``run`` makes of the rows of each partition as they lie, written out ``most`` rows or about 16 MB at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in run(one_by_one(batches)):
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, (str, bytes))) + sum(len(x) for v in row if isinstance(v, list) for x in v if isinstance(x, str))
            if len(held) >= most or size > 1 << 24:
                yield _batch(held, arrow)
                held, size = [], 0
        if held:
            yield _batch(held, arrow)

    return rows.mapInArrow(mapped, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)
