"""Where views go: files, Arrow, catalogue tables, JSON lines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("dataframe", "arrow", "parquet", "csv")


def export(view: DataFrame, form: str | None = None, parquet: str | None = None, csv: str | None = None):
    """The view in the form asked for: a DataFrame, an Arrow table, or the path it was written to.

    Without ``form`` the paths decide: Parquet, and CSV too if both are given, then CSV, then
    the DataFrame.  An unknown form, or a file form without its path, is a ``ValueError``.
    ``arrow`` brings all rows to the driver.  Files are folders of part files, as Spark writes them.
    """
    wanted = None if form is None else form.lower()
    if wanted is not None and wanted not in FORMATS:
        raise ValueError(f"unknown form {form!r}: one of {', '.join(FORMATS)}")
    if wanted in ("parquet", "csv") and not (paths := {"parquet": parquet, "csv": csv})[wanted]:
        raise ValueError(f"form {wanted!r} needs its path")
    if wanted == "arrow":
        return view.toArrow()
    if wanted == "dataframe":
        return view
    to_parquet = parquet if wanted in (None, "parquet") else None
    to_csv = csv if wanted in (None, "csv") else None
    if to_parquet:
        view.write.mode("overwrite").parquet(to_parquet)
    if to_csv:
        view.write.mode("overwrite").option("header", True).csv(to_csv)
    return to_parquet or to_csv or view


def save_table(view: DataFrame, name: str, append: bool = False, path: str | None = None) -> None:
    """Replaces or extends a table of the catalogue, whose files lie at ``path`` or in the warehouse."""
    writer = view.write.mode("append" if append else "overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def json_records(view: DataFrame) -> DataFrame:
    """``record``: each row as a JSON object with its nulls, times in ISO form in UTC."""
    # A top-level to_json omits null fields unless told not to.
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]xxx", "timeZone": "UTC"}
    return view.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in view.columns]), options).alias("record"))


def json_lines(view: DataFrame) -> Iterator[str]:
    """``json_records`` on the driver, a partition at a time."""
    return (r[0] for r in json_records(view).toLocalIterator())
