"""Parquet tables of a data folder, read lazily and once per table."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

from .staging import spread


class Tables:
    """``Tables(spark, folder).lineitem`` and so on; attribute access builds the scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def facts(self, name: str) -> DataFrame:
        """A fact table with at least one split per core. Filters and column pruning still reach the scan;
        a table of many files passes through untouched."""
        df = self.read(name)
        return df if df.isStreaming else spread(df)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)
