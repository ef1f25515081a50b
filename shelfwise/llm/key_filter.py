"""A filter of fixed size in front of a shuffle: rows whose key is surely not wanted stay where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 22


def _placed(df: DataFrame, key: str, bits: int) -> DataFrame:
    spot = F.pmod(F.xxhash64(key), F.lit(bits))
    return df.withColumn("at", F.floor(spot / 64)).withColumn("bit", (spot % 64).cast("int"))


def _masked(rows: DataFrame, key: str, wanted: DataFrame, bits: int, how: str) -> DataFrame:
    masks = _placed(wanted.select(key), key, bits).groupBy("at").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
    return _placed(rows, key, bits).join(F.broadcast(masks), "at", how)  # bits / 64 rows at most, whatever the table


def likely(rows: DataFrame, key: str, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose key may be among those of ``wanted``; none of those is lost."""
    return _masked(rows, key, wanted, bits, "inner").filter(F.expr("getbit(mask, bit) = 1")).select(*rows.columns)


def unlikely(rows: DataFrame, key: str, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The other rows: their key is not among those of ``wanted``."""
    return _masked(rows, key, wanted, bits, "left").filter(F.expr("mask IS NULL OR getbit(mask, bit) = 0")).select(*rows.columns)
