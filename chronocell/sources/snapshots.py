"""Snapshots of tables from files and from the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet or CSV snapshot by its extension; CSV has a header and inferred types."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("parquet", "pq"):
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    raise ValueError(f"unsupported snapshot file: {path!r} (.parquet or .csv)")


def parts_of_name(name: str) -> tuple[str, str, str]:
    """``database.schema.table`` in its parts; anything else is an error."""
    parts = name.split(".")
    if len(parts) != 3 or not all(parts):
        raise ValueError(f"not a name of three parts: {name!r}")
    return parts[0], parts[1], parts[2]


def from_catalog(spark: SparkSession, name: str) -> DataFrame:
    """A table of the session's catalogue."""
    if not spark.catalog.tableExists(name):
        raise ValueError(f"no table {name!r}")
    return spark.table(name)
