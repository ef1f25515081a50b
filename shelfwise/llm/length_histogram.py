"""Token counts by an exact histogram of encoded lengths.

Documents are encoded and counted by their length; the histogram has a row for each
length that occurs. Sums over all longer lengths (suffix sums) then answer, for every
context limit at once: how many documents and tokens there are beyond it, how many
tokens are left when each document is cut at it, and which share of documents fits.

Suffix sums are taken in blocks of lengths: within a block, and over the blocks' sums,
so no task holds the whole histogram.

Defined results: null and empty texts have length 0. Every row counts, repeated ones
too. An empty table has no lengths. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .batches import map_rows
from .bpe import VOCABULARY, encoder

BLOCK = 256


def lengths(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(length) of each row of ``docs`` in tokens."""
    def count(part: Iterator[tuple]) -> Iterator[tuple]:
        encode = encoder(vocabulary, pattern).encode_ordinary
        for (value,) in part:
            yield (len(encode(value)) if value else 0,)

    return map_rows(docs.select(F.col(text).alias("text")), count, "length bigint")


def histogram(lengths_: DataFrame) -> DataFrame:
    """Per length: n_docs, and of all documents: n_longer, tokens_longer, n_total, tokens_total, tokens_kept and share_fitting
    when the length is the context limit."""
    # Written once: both kinds of sums read the counts, and the encoding behind them is not run again.
    counts = stage(lengths_.groupBy("length").agg(F.count("*").alias("n_docs")), "lengths").withColumn("block", F.floor(F.col("length") / BLOCK))
    tokens = F.col("length") * F.col("n_docs")
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum(tokens).alias("block_tokens"))
    behind = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    blocks = blocks.select("block", F.coalesce(F.sum("block_docs").over(behind), zero).alias("docs_behind"), F.coalesce(F.sum("block_tokens").over(behind), zero).alias("tokens_behind"),
                           F.sum("block_docs").over(everything).alias("n_total"), F.sum("block_tokens").over(everything).alias("tokens_total"))
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    longer = counts.join(F.broadcast(blocks), "block").select(  # a row per 256 lengths
        "length", "n_docs", (F.coalesce(F.sum("n_docs").over(within), zero) + F.col("docs_behind")).alias("n_longer"),
        (F.coalesce(F.sum(tokens).over(within), zero) + F.col("tokens_behind")).alias("tokens_longer"), "n_total", "tokens_total")
    return (longer.withColumn("tokens_kept", F.col("tokens_total") - F.col("tokens_longer") + F.col("n_longer") * F.col("length"))
            .withColumn("share_fitting", 1 - F.col("n_longer") / F.col("n_total")))


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, n_longer, tokens_kept) for limits of any size, between the lengths of ``histogram`` too."""
    asked = F.explode(F.array(*(F.lit(x).cast("bigint") for x in limits))).alias("context_limit")
    per = table.select(asked, "*")
    over = F.col("length") > F.col("context_limit")
    return per.groupBy("context_limit").agg(F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("n_longer"),
                                            F.sum(F.least("length", "context_limit") * F.col("n_docs")).alias("tokens_kept"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least this share of the documents does not exceed."""
    asked = F.explode(F.array(*(F.lit(float(x)) for x in shares))).alias("share")
    per = table.select(asked, "length", "n_longer", "n_total").filter(F.col("n_total") - F.col("n_longer") >= F.col("share") * F.col("n_total"))
    return per.groupBy("share").agg(F.min("length").alias("length"))
