"""Materialise a frame that several branches of a report read.

The frame is written once as Parquet under the cluster's checkpoint folder and
read back, so the branches share one scan with real size statistics, and a lost
executor costs a re-read instead of the whole lineage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir

#: While it is on, what a statement shuffled goes from the disks when the statement ends, and is made again should anything ask for it.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str = "frame") -> DataFrame:
    """Write ``df`` to the shared folder (runs a job) and return a scan of it. What the job shuffled is freed when it ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shelfwise/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)  # digests, as text, take half the space of the default
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give per-row heavy work at least one task per core.

    Large inputs already have more splits than cores and pass through unchanged;
    only a few-split input (one small file) is redistributed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_width(df: DataFrame) -> int:
    """The session's shuffle width, for exchanges that feed Python and must keep their parallelism."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
