"""Sharding by a Feistel permutation of global row numbers.

Rows get numbers 0 .. n-1 in the order of a hash of their content: the hash's leading
bits are a bin, the bins' counts, added up, say where a bin starts, and a row's place
in its bin is added to that. The bins are filled evenly by any ids, and only their
counts, a fixed number, are brought together.

A Feistel network over pairs (high, low) with high * width + low = number permutes
0 .. height * width - 1. Where the result is n or more it is permuted again (cycle
walking), so the numbers 0 .. n-1 are permuted among themselves. A row's permuted
number, taken by the number of shards, gives its shard (the rest) and its slot there
(the quotient): shards differ by one row at most, slots have no gaps, and the place
of a row can be computed from its number alone.

Everything is DataFrame functions; nothing but counts is brought together.

Defined results: a null text has no bytes, size 8 and the checksum of the empty text.
Rows that are equal in id and text are numbered among themselves in any order, which
does not show. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096
ROUNDS = 6
WALKS = 16
SHARDS, SEED = 24, 20_240_229
LAW = "rows"


def numbered(rows: DataFrame, key: Column, bins: int = BINS) -> DataFrame:
    """``rows`` with ``row_number``, 0 .. n-1 over the whole table, in the order of the hash ``key``."""
    hashed = rows.withColumn("own_hash", key).withColumn("bin", F.pmod("own_hash", F.lit(bins)).cast("int"))
    counts = hashed.groupBy("bin").count()
    starts = counts.select("bin", (F.sum("count").over(Window.orderBy("bin")) - F.col("count")).alias("start"))
    in_bin = F.row_number().over(Window.partitionBy("bin").orderBy("own_hash"))
    return (hashed.withColumn("in_bin", in_bin).join(F.broadcast(starts), "bin")  # one row per bin
            .withColumn("row_number", F.col("start") + F.col("in_bin") - 1).drop("own_hash", "bin", "in_bin", "start"))


def _once(number: Column, height: int, width: int, rounds: int, seed: int) -> Column:
    high, low = F.floor(number / width).cast("bigint"), F.pmod(number, F.lit(width))
    for i in range(rounds):
        if i % 2:
            high = F.pmod(high + F.pmod(F.xxhash64(low, F.lit(seed + i)), F.lit(height)), F.lit(height))
        else:
            low = F.pmod(low + F.pmod(F.xxhash64(high, F.lit(seed + i)), F.lit(width)), F.lit(width))
    return high * F.lit(width).cast("bigint") + low


def permuted(number: Column, n: int, rounds: int = ROUNDS, seed: int = SEED, walks: int = WALKS) -> Column:
    """The place of row ``number`` in a reproducible shuffle of n rows.

    Fewer than ``height`` numbers lie beyond n, one in ``width`` or less; more than ``walks`` steps among them in a row do not
    happen in practice, and the query fails rather than give a wrong place if they do.
    """
    width = max(1, math.isqrt(max(n - 1, 0)) + 1)
    height = max(1, -(-n // width))
    return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), _once(number, height, width, rounds, seed),
                       lambda x, _: F.when(x < n, x).otherwise(_once(x, height, width, rounds, seed)),
                       lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("the walk has not come back")).cast("bigint")))


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    own = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(own).cast("bigint") + 8).alias("size"), F.crc32(own.cast("binary")).alias("text_crc32"))
    n = docs.count()
    place = F.col("place")
    return (numbered(rows, F.xxhash64("doc_id", "text_crc32", "size", F.lit(seed))).withColumn("place", permuted(F.col("row_number"), n, seed=seed))
            .select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), (place % shards).cast("int").alias("shard"),
                    F.floor(place / shards).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
