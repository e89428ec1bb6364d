"""Measurement tables as partitioned Parquet: scan, subtables and column sink.

A measurement is a folder with a table ``main`` (partitioned by field and spectral
window), a folder for each subtable, and a folder for each column that was
written afterwards.  A column that was written replaces or adds to those of
``main``; ``main`` itself is never rewritten.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

SUBTABLES = ("ANTENNA", "FIELD", "SPECTRAL_WINDOW", "POLARIZATION", "DATA_DESCRIPTION", "FEED")
GROUP = ("field_id", "data_desc_id")


def write(path: str, main: DataFrame, subtables: Mapping[str, DataFrame]) -> None:
    """Write a measurement; ``main`` needs row_id and the columns of ``GROUP``."""
    unknown = set(subtables) - set(SUBTABLES)
    if unknown:
        raise ValueError(f"not a subtable: {sorted(unknown)}")
    main.write.mode("overwrite").partitionBy(*GROUP).parquet(f"{path}/main")
    for name, table in subtables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, field_id: int | None = None, data_desc_id: int | None = None, written: Sequence[str] = ()) -> DataFrame:
    """Rows of ``main`` with the wanted columns; the group filters prune partitions.

    ``written`` names columns of :func:`write_column` to join in by row_id.
    """
    rows = spark.read.parquet(f"{path}/main")
    for name, value in (("field_id", field_id), ("data_desc_id", data_desc_id)):
        if value is not None:
            rows = rows.filter(rows[name] == value)
    if columns is not None:
        rows = rows.select(*dict.fromkeys(["row_id", *GROUP, *(c for c in columns if c not in written)]))
    for name in written:
        rows = rows.drop(name).join(spark.read.parquet(f"{path}/columns/{name}"), "row_id")
    return rows


def subtable(spark: SparkSession, path: str, name: str) -> DataFrame:
    if name not in SUBTABLES:
        raise ValueError(f"not a subtable: {name!r}")
    return spark.read.parquet(f"{path}/{name}")


def groups(spark: SparkSession, path: str) -> DataFrame:
    """(field_id, data_desc_id) of the row groups, from the folders' names alone."""
    return spark.read.parquet(f"{path}/main").select(*GROUP).distinct()


def spectral_windows(spark: SparkSession, path: str) -> DataFrame:
    """Row groups joined with the channels of their spectral window."""
    described = subtable(spark, path, "DATA_DESCRIPTION")
    return groups(spark, path).join(described, "data_desc_id").join(subtable(spark, path, "SPECTRAL_WINDOW"), "spectral_window_id")


def write_column(path: str, column: DataFrame, name: str) -> None:
    """Write one column (row_id, ``name``) beside ``main``."""
    column.select("row_id", name).write.mode("overwrite").parquet(f"{path}/columns/{name}")
