"""Version histories of prices: numbered, with the time each version was known, equal ones in a row merged.

A key may hold a large share of the log, so only keys of few rows are ordered whole. Rows of others are
ordered within a key's span (a day by default); what crosses the border of spans comes from one
row a span: how many rows stand before it, the last value before it and the first after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.staging import stage

#: Keys of up to so many rows are ordered whole.
FEW_ROWS = 10_000


def crowded_keys(df: DataFrame, keys: list[str], *, few: int = FEW_ROWS) -> DataFrame | None:
    """The keys of more than ``few`` rows as ``_crowded`` (a struct, so that nulls are equal), or None; counting is a job that runs here."""
    counted = df.groupBy(F.struct(*keys).alias("_crowded")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > few).select("_crowded")
    found = stage(counted, "crowded")
    return None if found.isEmpty() else found


def in_sequence(df: DataFrame, keys: list[str], order: list[str], value: Column, span: Column, *, crowded: DataFrame | None = None) -> DataFrame:
    """``df`` with ``place`` (from 1), ``places`` (rows of the key), ``before`` and ``after``: the value beside the row in its key's order, null at the ends.

    ``span`` must not fall as ``order`` rises. Rows with null keys are one key; ties of ``order`` keep any order.
    Keys in ``crowded`` (``crowded_keys``) are ordered by spans, all others whole.
    """
    if crowded is None:
        return _whole(df, keys, order, value)
    mine = F.struct(*keys) == F.col("_crowded")
    return _whole(df.join(crowded, mine, "left_anti"), keys, order, value).unionByName(_by_spans(df.join(crowded, mine, "left_semi"), keys, order, value, span))


def _whole(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    inside = W.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_value", value)
    return rows.select(*df.columns, F.row_number().over(inside).cast("bigint").alias("place"), F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("places"),
                       F.lag("_value").over(inside).alias("before"), F.lead("_value").over(inside).alias("after"))


def _by_spans(df: DataFrame, keys: list[str], order: list[str], value: Column, span: Column) -> DataFrame:
    rows = df.withColumns({"_value": F.struct(value.alias("v")), "_span": span})
    inside = W.partitionBy(*keys, "_span").orderBy(*order)
    placed = rows.withColumns({"_n": F.row_number().over(inside), "_before": F.lag("_value").over(inside), "_after": F.lead("_value").over(inside)})
    # The same order as in the windows decides the ends, so ties fall alike.
    first, last = F.min_by("_value", "_n"), F.max_by("_value", "_n")
    spans = placed.groupBy(*keys, "_span").agg(F.count(F.lit(1)).alias("_rows"), first.alias("_first"), last.alias("_last"))
    across = W.partitionBy(*keys).orderBy("_span")
    borders = spans.select(*[F.col(k).alias(f"_{i}_key") for i, k in enumerate(keys)], F.col("_span").alias("_of"),
                           F.coalesce(F.sum("_rows").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_skipped"),
                           F.sum("_rows").over(W.partitionBy(*keys)).alias("places"), F.lag("_last").over(across).alias("_last"), F.lead("_first").over(across).alias("_first"))
    on = F.col("_span").eqNullSafe(F.col("_of"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_{i}_key"))
    return placed.join(borders, on).select(*df.columns, (F.col("_skipped") + F.col("_n")).alias("place"), "places",
                                           F.coalesce("_before", "_last")["v"].alias("before"), F.coalesce("_after", "_first")["v"].alias("after"))


def versions(log: DataFrame, keys: list[str], fields: list[str], *, at: str = "recorded_at", tie: str = "id", span: Column | None = None) -> DataFrame:
    """The versions that a log of saved rows makes: ``revision`` per key, known from ``at`` until ``known_until`` (null: still).

    A save that changes none of ``fields`` is no version. A field that says that a row is deleted belongs to ``fields``.
    """
    span = F.to_date(at) if span is None else span
    state = F.struct(*fields)
    crowded = crowded_keys(log, keys)
    saved = in_sequence(log, keys, [at, tie], state, span, crowded=crowded)
    changed = saved.filter((F.col("place") == 1) | ~state.eqNullSafe(F.col("before"))).select(*log.columns)
    numbered = in_sequence(changed, keys, [at, tie], F.col(at), span, crowded=crowded)
    return numbered.select(*log.columns, F.col("place").alias("revision"), F.col("after").alias("known_until"))


def own_price_log(products: DataFrame, saves: DataFrame, deleted: DataFrame, *, baseline_at: str, deleted_at: str) -> DataFrame:
    """Baseline rows of all products, saves in their order and rows of deleted products, as one log with ``operation``."""
    stamp = lambda text: F.lit(text).cast("timestamp_ntz")
    fixed = lambda df, operation, at: df.select("own_id", stamp(at).alias("recorded_at"), F.lit(0).cast(saves.schema["id"].dataType).alias("id"), F.lit(operation).alias("operation"),
                                                F.col("regular_price").cast("double"), F.col("promo_price").cast("double"))
    updates = saves.select("own_id", F.col("recorded_at").cast("timestamp_ntz"), "id", F.lit("UPDATE").alias("operation"), F.col("regular_price").cast("double"), F.col("promo_price").cast("double"))
    return fixed(products, "BASELINE", baseline_at).unionByName(updates).unionByName(fixed(deleted, "DELETE", deleted_at))


def own_price_history(log: DataFrame) -> DataFrame:
    """Versions of own prices: what was known when, with the operation that made it."""
    gone = log.withColumn("gone", F.col("operation") == "DELETE")
    return versions(gone, ["own_id"], ["gone", "regular_price", "promo_price"]).select(
        "own_id", "revision", "operation", "regular_price", "promo_price", F.col("recorded_at").alias("known_from"), "known_until")


def scoped_price_history(prices: DataFrame, retailers: DataFrame, *, page: int = 100) -> DataFrame:
    """All recorded scoped prices with both times: ``starts``/``ends`` of the price, ``known_from``/``known_until`` of the record in its scope.

    ``newest`` counts a product's records from the newest on; ``on_first_page`` marks what a page of that size shows.
    """
    named = prices.join(retailers.select("retailer_id", F.col("name").alias("retailer")), "retailer_id")
    scope = ["product_id", "retailer_id", "region"]
    many = crowded_keys(prices, ["product_id"])  # only their scopes can be crowded
    by_scope = None if many is None else crowded_keys(prices, scope)
    known = in_sequence(named, scope, ["recorded_at", "id"], F.col("recorded_at"), F.to_date("recorded_at"), crowded=by_scope)
    known = known.select(*named.columns, F.col("place").alias("revision"), F.col("after").alias("known_until"))
    listed = in_sequence(known, ["product_id"], ["recorded_at", "id"], F.lit(0), F.to_date("recorded_at"), crowded=many).withColumn("newest", F.col("places") - F.col("place") + 1)
    return listed.select("product_id", "id", "retailer", "region", "revision", "starts", "ends", F.col("regular_price").cast("double").alias("regular_price"),
                         F.col("promo_price").cast("double").alias("promo_price"), F.col("recorded_at").alias("known_from"), "known_until", "newest", (F.col("newest") <= page).alias("on_first_page"))
