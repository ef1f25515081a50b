"""File sinks: Parquet, and CSV with formula-safe text cells and the byte-order mark spreadsheets look for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from ..functions.text import guard_formula


def safe_cells(df: DataFrame) -> DataFrame:
    """Text columns with spreadsheet formulas neutralised."""
    return df.select(*[guard_formula(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    """Distributed CSV with a header per part file; the first header cell carries the byte-order mark."""
    first = df.columns[0]
    safe_cells(df).withColumnRenamed(first, "﻿" + first).write.csv(path, header=True, escape='"')


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
