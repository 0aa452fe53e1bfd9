"""The change log as a stream, and captures as snapshots arrive.

Every function that keeps state bounds it by a watermark.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocell.operators.log import is_deletion
from chronocell.sources.store import EVENTS, Store
from chronocell.streaming import source


def tail(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """New event files of the store at ``path`` as they appear.

    A capture's folder becomes visible before its commit, and stays if that fails; ``captures`` has
    committed ones only.
    """
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{path.rstrip('/')}/events")


def captures(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """The events of committed captures of the store at ``path`` with ``seq``, from capture ``first`` on."""
    source.register(spark)
    return spark.readStream.format(source.NAME).option("path", path).option("from", first).load()


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each cell's event of a snapshot once, repeats within ``late`` dropped."""
    return events.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["entity_id", "field", "snapshot_id"])


def density(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """``start, changes, deletions`` by tumbling windows; windows close ``late`` after their end."""
    return (
        events.withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("changes"), F.count_if(is_deletion()).alias("deletions"))
        .select(F.col("w.start").alias("start"), "changes", "deletions")
    )


def latest_cells(events: DataFrame) -> DataFrame:
    """``entity_id, field, timestamp, value``: each cell's last set, for output mode ``complete`` or ``update``.

    The state is one row a cell, as large as the table itself; it has no watermark, since a
    cell's last value never expires.
    """
    last = F.max(F.struct("timestamp", "value")).alias("last")
    return events.where(~is_deletion()).groupBy("entity_id", "field").agg(last).select("entity_id", "field", "last.timestamp", "last.value")


def capture_batches(store: Store, key: str, at: Callable[[int], dt.datetime] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that captures each batch as a full snapshot.

    ``at`` gives a batch's instant, else it is now.  A batch that Spark repeats after a failure
    has the content that the store already holds, so it adds nothing.
    """

    def capture(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            store.capture(batch, key, at(batch_id) if at else None)

    return capture
