"""Intermediate tables in the shared folder that the cluster names.

Iterative operators cut their lineage here.  The files lie under
``spark.checkpoint.dir``, which the driver and every executor share, so a lost
executor costs a re-read and never a recomputation of the whole chain.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset a local one, if all of Spark is local too."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="spark-chronocell-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def _path(spark: SparkSession, text: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(spark: SparkSession, location: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    path, fs = _path(spark, location)
    fs.delete(path, True)


class Scratch:
    """A group of scratch tables of one query, each written once and read any number of times."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/chronocell-{label}-{uuid.uuid4().hex[:12]}"
        self._written, self._tables, self._registered = 0, [], False

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return a reader of it.  Its location is in ``.scratch_location``."""
        self._written += 1
        self._go_at_the_end()
        where = f"{self.root}/{self._written:03d}-{name}"
        df.write.parquet(where)
        self._tables.append(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out.scratch_location = where
        return out

    def _go_at_the_end(self) -> None:
        """What is left of the group is deleted when the application ends."""
        if not self._registered:
            path, fs = _path(self.spark, self.root)
            fs.deleteOnExit(path)
            self._registered = True

    def folder(self, name: str) -> str:
        """A place for files of the caller's own."""
        self._go_at_the_end()
        return f"{self.root}/{name}"

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            drop(self.spark, table.scratch_location)

    def clear(self, *but: DataFrame) -> None:
        """Delete all tables of this group but some."""
        stay = {t.scratch_location for t in but}
        for where in self._tables:
            if where not in stay:
                drop(self.spark, where)
        self._tables = [w for w in self._tables if w in stay]
