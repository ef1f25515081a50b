"""Audit of how five filters act on each other, over all orders in which they can be applied.

Each document falls to a mask: one bit for each filter that it fails. Documents are
counted by (part, mask), so what is left of any corpus are 32 cells a part.

A recursive CTE then walks over the orders. It starts with the masks that occur and
an empty prefix, and extends each prefix by every letter not yet used, carrying the
bits applied so far. At each level it says of each mask cell what that step does with
it: still kept, removed here, failing but removed before, failing nothing else. Orders
with a common beginning share their steps, so five levels give 325 steps and not 600,
and the walk has the same size (32 cells at most) for any number of parts. A step's
figures are the counts of a part's cells times what the step does with them.

A filter's share in all removals (Shapley) sums what it removes at any step over all
orders; a prefix of n letters stands for (5 - n)! orders.

Everything is DataFrame functions and SQL. Copies are told by the SHA-256 of their text; the
first of them is joined by text and id together, so large groups of copies spread.

Defined results: a null text is the empty text (A fails, E compares it with other empty
texts). A null source is the part ''. A row without an id fails E never and has no
labels. Rows equal in id and text are no copies of each other; each is counted. A
document is good or toxic if any of its label rows says so. A part with a document has
all 600 rows; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
#: The limits of the filters.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, "[#$%&*|]"
SALTS = 1024


def own_failures(text: Column) -> Column:
    """The bits of A to D, which depend on the text alone. Words are what stands between white space."""
    own = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    tests = (F.size(own) < LEAST_WORDS,
             F.size(F.array_distinct(own)).cast("bigint") * 100 < F.size(own).cast("bigint") * DISTINCT_PERCENT,
             F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint") * 100 > F.length(text).cast("bigint") * CAPITAL_PERCENT,
             text.rlike(SYMBOLS))
    return sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail just the filters of ``mask``."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"))
    narrow = read.select("doc_id", "part", own_failures(F.col("text")).alias("own"), F.unhex(F.sha2("text", 256)).alias("key"))
    said = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    # Rows without an id match no label; the second key spreads them.
    spread = narrow.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(F.lit(0)))
    known = said.withColumn("zero", F.lit(0).cast("bigint"))
    labelled = spread.join(known, (spread["doc_id"] == known["labelled"]) & (spread["salt"] == known["zero"]), "left")
    rows = scratch.keep(labelled.select("doc_id", "part", "own", "key", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")), "masked")
    firsts = rows.filter(F.col("doc_id").isNotNull()).groupBy(F.col("key").alias("first_key")).agg(F.min("doc_id").alias("first_id"))
    copies = rows.join(firsts, (rows["key"] == firsts["first_key"]) & (rows["doc_id"] == firsts["first_id"]), "left")
    mask = F.col("own") + F.when(F.col("doc_id").isNotNull() & F.col("first_id").isNull(), COPY).otherwise(0)
    return copies.groupBy("part", mask.alias("mask")).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def walk(masks: DataFrame) -> DataFrame:
    """(prefix, letter, step, mask, kept, removed, redundant, unique_fails): what the last filter of each prefix does with each mask, as 0 or 1."""
    letters = ", ".join(f"('{letter}', {1 << i})" for i, letter in enumerate(LETTERS))
    return masks.sparkSession.sql(f"""
        WITH RECURSIVE walk(prefix, letter, step, applied, mask, kept, removed, redundant, unique_fails) AS (
            SELECT '', '', 0, 0, mask, 1, 0, 0, 0 FROM {{masks}}
            UNION ALL
            SELECT prefix || l.letter, l.letter, step + 1, applied | l.bit, mask,
                   CAST(mask & (applied | l.bit) = 0 AS INT),
                   CAST(mask & l.bit <> 0 AND mask & applied = 0 AS INT),
                   CAST(mask & l.bit <> 0 AND mask & applied <> 0 AS INT),
                   CAST(mask = l.bit AS INT)
            FROM walk JOIN (VALUES {letters}) AS l(letter, bit) ON applied & l.bit = 0)
        SELECT prefix, letter, step, mask, kept, removed, redundant, unique_fails FROM walk WHERE step > 0""", masks=masks)


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """Per part, filter_order and step: filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    scratch = Scratch(docs.sparkSession)
    cells = scratch.keep(mask_cells(docs, labels, scratch, **columns), "cells")
    steps = scratch.keep(walk(cells.select("mask").distinct()), "steps")  # 32 * 325 rows at most
    times = lambda count, fate: F.sum(F.col(count) * F.col(fate)).alias
    figures = scratch.keep(cells.join(F.broadcast(steps), "mask").groupBy("part", "prefix", "letter", "step").agg(
        times("n", "kept")("kept"), times("n", "removed")("removed"), times("n", "redundant")("redundant"), times("n", "unique_fails")("unique_fails"),
        times("good", "removed")("good_lost"), times("toxic", "removed")("toxic_lost")), "figures")
    endings = F.element_at(F.array(*(F.lit(n) for n in (24, 6, 2, 1, 1))), F.col("step"))  # (5 - step)!
    shares = figures.groupBy("part", "letter").agg(F.sum(F.col("removed") * endings).alias("shapley"))
    orders = steps.filter(F.col("step") == len(LETTERS)).select(F.col("prefix").alias("filter_order")).distinct()
    begun = orders.select("filter_order", F.explode(F.expr(f"transform(sequence(1, {len(LETTERS)}), i -> substring(filter_order, 1, i))")).alias("prefix"))
    found = figures.join(F.broadcast(begun), "prefix").join(shares, ["part", "letter"])  # 600 rows
    return scratch.result(found.select("part", "filter_order", F.col("step").cast("int").alias("step"), F.col("letter").alias("filter"),
                                       "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "audit")
