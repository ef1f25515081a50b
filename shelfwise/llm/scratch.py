"""Frames written for the time of one operator, and emptied when its result stands on its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


#: Bytes of a Parquet row group that a writing task holds. Spark's default of 128 MB would be most of a small executor's heap.
ROW_GROUP = 16 << 20


class Scratch:
    """``keep`` writes a frame to the shared folder and reads it back; ``free`` gives the space of all of them back.

    What is freed must not be read again: the operator's result is written (``result``) before.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/shelfwise/{name}-{uuid.uuid4().hex}"
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written for good, everything kept before it freed."""
        before, self.paths = self.paths, []
        written = self.keep(df, name)
        self.paths = before
        self.free()
        return written

    def free(self) -> None:
        for path in self.paths:
            self.spark.range(0).coalesce(1).write.mode("overwrite").parquet(path)
        self.paths = []
