"""The committed captures of a store as a streaming source.

An offset is a number of captures in the order of their commits, so what no commit names is never
read, and a query that starts again goes on where its checkpoint ends.  A partition is a part file
of a capture.  Manifest, commits and files are opened by Arrow's file systems, in the process that
Spark gives a Python source on the driver and on executors: the store's path must be one that those
open (a folder that all machines share, or an object store or HDFS that Arrow is set up for).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "chronocell_captures"
SCHEMA = "entity_id string, timestamp timestamp, field string, value string, dtype string, snapshot_id string, seq int"
COLUMNS = ["entity_id", "timestamp", "field", "value", "dtype", "snapshot_id"]
#: Rows that a partition gives Spark at once.
BATCH = 10_000


@dataclass
class PartFile(InputPartition):
    """A file of the capture at a place."""

    path: str
    seq: int


class Captures(DataSource):
    """``spark.readStream.format(NAME).option("path", store)``; ``from`` is the capture to begin at.

    A batch has all captures that are committed when it is planned: Spark tells a Python source no offset to count from.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self._uri = options["path"].rstrip("/")
        self._first = int(options.get("from", 0))

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self._uri if "://" in self._uri or self._uri.startswith("file:") else f"file://{self._uri}")

    def _json(self, files: fs.FileSystem, path: str) -> dict | None:
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(path) as stream:
            return json.loads(stream.read())

    def _captures(self) -> list[dict]:
        """The entries of all captures that are committed, in order."""
        files, root = self._open()
        manifest = self._json(files, f"{root}/manifest.json") or {"events": [], "checkpoints": []}
        events, done = list(manifest["events"]), len(manifest["events"]) + len(manifest["checkpoints"])
        while (commit := self._json(files, f"{root}/commits/{done:08d}.json")) is not None:
            events += [commit["event"]] if "event" in commit else []
            done += 1
        return events

    def initialOffset(self) -> dict:
        return {"captures": self._first}

    def latestOffset(self) -> dict:
        return {"captures": len(self._captures())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files, root = self._open()
        out = []
        for seq, entry in list(enumerate(self._captures()))[start["captures"] : end["captures"]]:
            found = files.get_file_info(fs.FileSelector(f"{root}/{entry['file']}"))
            out += [PartFile(f.path, seq) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".parquet")]
        return out

    def read(self, partition: PartFile) -> Iterator[pa.RecordBatch]:
        files, _ = self._open()
        with files.open_input_file(partition.path) as stream:
            for batch in pq.ParquetFile(stream).iter_batches(BATCH, columns=COLUMNS):
                times = batch.column("timestamp").cast(pa.timestamp("us", "UTC"))
                columns = [batch.column(c) if c != "timestamp" else times for c in COLUMNS]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([partition.seq] * len(batch), pa.int32())], names=[*COLUMNS, "seq"])

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Captures)
