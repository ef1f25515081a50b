"""Newest stored period that overlaps a given one, per key, without meeting all pairs of periods.

Days are the leaves of a binary tree. A period is covered by a few nodes of it; two
periods overlap just where a node of one lies at or above a node of the other. So a
stored period leaves its moment at the nodes of its cover (``over``) and at all nodes above
them (``under``), and a period that asks reads ``under`` at its own nodes and ``over`` above
them. All of these are maxima, which combine before the shuffle, so the work is the
number of periods times the logarithm of the days they span, however many share a key.

A period without a start is always; one that ends before it starts overlaps only such periods.
Keys of few periods carry them as a list that each row looks through, which is less work; results do not depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.dates import periods_compatible
from ..sources.staging import stage

#: Keys of up to so many stored rows look through their periods one by one.
FEW_PERIODS = 32
#: Places of the tree that are no nodes: all stored periods, and those without a start.
_ALL, _ALWAYS = -1, 0


def _cover(first: Column, last: Column, levels: int) -> Column:
    """Nodes (root 1, children 2n and 2n + 1) that make up the leaves ``first`` to ``last``; none if there are no such leaves."""
    found = []
    for level in range(levels + 1):
        low = F.shiftright(first + F.lit((1 << level) - 1), level)
        high = F.shiftright(last + 1, level)
        base = 1 << (levels - level)
        found += [F.when((low < high) & (low % 2 == 1), low + base), F.when((low < high) & (high % 2 == 1), high - 1 + base)]
    return F.array_compact(F.array(*found))


def _above(nodes: Column, levels: int) -> Column:
    """The nodes and all above them, each once."""
    one = lambda n: F.array(*[F.shiftright(n, k) for k in range(levels + 1)])
    return F.array_distinct(F.filter(F.flatten(F.transform(nodes, one)), lambda n: n > 0))


def _over(node: Column) -> Column:
    return node * 2


def _under(node: Column) -> Column:
    return node * 2 + 1


def _best_two(rows: DataFrame, by: list[str], other: str | None, newest: str) -> DataFrame:
    """The greatest ``newest`` of each place, and, where ``other`` counts, the greatest of another ``other``."""
    if other is None:
        return rows.groupBy(*by).agg(F.max(newest).alias(newest))
    each = rows.groupBy(*by, other).agg(F.max(newest).alias(newest))
    return each.withColumn("_place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(newest), other))).filter(F.col("_place") <= 2).drop("_place")


def with_newest(rows: DataFrame, stored: DataFrame, key: list[str], *, newest: str, other: str | None = None, few: int = FEW_PERIODS, how: str = "inner") -> DataFrame:
    """Each of ``rows`` with ``newest``, the greatest among stored periods of the key that overlap; ``how`` "left" keeps those without any.

    Both sides have ``key``, [``other``,] ``first`` and ``last`` (dates); ``newest`` is never null. With
    ``other``, only stored periods of another value of it count. A row is shuffled once, by its key.
    ``stored`` is read twice. Which keys are crowded is a job that runs here.
    """
    same = [other] if other else []
    pool = stored.select(*key, *same, "first", "last", newest)
    crowded = stage(pool.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > few).select(*key), "crowded")
    none = crowded.isEmpty()
    if not none:
        rows = stage(rows, "asks")  # both kinds of keys read them
    small = pool if none else pool.join(crowded, key, "left_anti")
    lists = small.groupBy(*key).agg(F.collect_list(F.struct("first", "last", *same, newest)).alias("_pool"))

    def meets(p: Column) -> Column:
        overlaps = periods_compatible("first", "last", p["first"], p["last"])
        return overlaps & (F.col(other) != p[other]) if other else overlaps

    best = F.array_max(F.transform(F.filter("_pool", meets), lambda p: p[newest]))
    direct = (rows if none else rows.join(crowded, key, "left_anti")).join(lists, key, how).withColumn(newest, best).drop("_pool")
    if how == "inner":
        direct = direct.filter(F.col(newest).isNotNull())
    if none:
        return direct
    many = rows.join(crowded, key, "left_semi")
    asks = stage(many.select(*key, *same, "first", "last").distinct(), "asked")
    periods = stage(pool.join(crowded, key, "left_semi").groupBy(*key, *same, "first", "last").agg(F.max(newest).alias(newest)), "periods")
    found = _by_tree(asks, periods, key, same, newest, other)
    renamed = found.withColumnsRenamed({c: f"_found_{c}" for c in [*key, *same, "first", "last"]})
    on = [many[c] == renamed[f"_found_{c}"] for c in [*key, *same]] + [many[c].eqNullSafe(renamed[f"_found_{c}"]) for c in ("first", "last")]
    return direct.unionByName(many.join(renamed, on, how).drop(*[f"_found_{c}" for c in [*key, *same, "first", "last"]]))


def newest_overlapping(asked: DataFrame, stored: DataFrame, key: list[str], *, newest: str, other: str | None = None, few: int = FEW_PERIODS) -> DataFrame:
    """``key``, [``other``,] first, last and the greatest ``newest`` as ``with_newest`` finds it, one row for each period that has one."""
    asks = asked.select(*key, *([other] if other else []), "first", "last").distinct()
    return with_newest(asks, stored, key, newest=newest, other=other, few=few)


def _by_tree(asks: DataFrame, pool: DataFrame, key: list[str], same: list[str], newest: str, other: str | None) -> DataFrame:
    """Periods of a key with the same days count as one on both sides, so the tree holds pairs of days, however many periods have them."""
    end = F.coalesce("last", "first")
    span = pool.agg(F.min("first").alias("low"), F.max(end).alias("high")).first()
    low, high = span["low"], span["high"]
    levels = max(1, ((high - low).days + 1 if low is not None and high is not None and high >= low else 1).bit_length())
    day = lambda c: F.datediff(c, F.lit(low).cast("date")).cast("bigint")
    dated = F.col("first").isNotNull()
    kept = _best_two(pool.filter(F.col(other).isNotNull()) if other else pool, [*key, "first", "last"], other, newest)
    own = kept.withColumn("_nodes", F.when(dated, _cover(day(F.col("first")), day(end), levels)).otherwise(F.array().cast("array<bigint>")))
    places = F.concat(F.array(F.lit(_ALL).cast("bigint")), F.when(~dated, F.array(F.lit(_ALWAYS).cast("bigint"))).otherwise(F.array().cast("array<bigint>")),
                      F.transform("_nodes", _over), F.transform(_above(F.col("_nodes"), levels), _under))
    held = _best_two(own.select(*key, *same, newest, F.explode(places).alias("_at")), [*key, "_at"], other, newest)
    # A stored period lies inside the span, so what is asked beyond it cannot matter.
    nodes = _cover(F.greatest(day(F.col("first")), F.lit(0).cast("bigint")), F.least(day(end), F.lit((1 << levels) - 1).cast("bigint")), levels)
    reads = F.when(dated, F.concat(F.array(F.lit(_ALWAYS).cast("bigint")), F.transform(nodes, _under), F.transform(_above(nodes, levels), _over))).otherwise(F.array(F.lit(_ALL).cast("bigint")))
    read = asks.select(*key, "first", "last").distinct().select("*", F.explode(reads).alias("_at"))
    best = _best_two(read.join(held, [*key, "_at"]), [*key, "first", "last"], other, newest)
    found = best.withColumnsRenamed({"first": "_first", "last": "_last", **{k: f"_{i}_key" for i, k in enumerate(key)}, **({other: "_other"} if other else {})})
    on = F.col("first").eqNullSafe(F.col("_first")) & F.col("last").eqNullSafe(F.col("_last"))
    for i, k in enumerate(key):
        on = on & (F.col(k) == F.col(f"_{i}_key"))
    if other:
        on = on & (F.col(other) != F.col("_other"))
    return asks.join(found, on).groupBy(*key, *same, "first", "last").agg(F.max(newest).alias(newest))
