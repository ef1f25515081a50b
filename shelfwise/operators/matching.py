"""Own products against competitor offers: same category, pack sizes within a ratio band.

Nothing here lists own-product x offer pairs. Offers are first reduced to
*cells* - one row per (scope, category, grams) with totals, and one row per
(scope, category, grams, unit price) with a count. Own products are reduced to
their distinct (scope, category, grams). The band join runs on those distinct
pack sizes only, so its size depends on how many pack sizes exist, not on how
many offers or products do. Counts below a price are then running sums inside a
cell, split into price blocks so that one crowded cell is not one task.

``scope`` carries allow-lists: an unrestricted product looks at scope ``*``; a
product restricted to brands or SKUs looks at those brands' or SKUs' scopes.

Analyst rejections are handled exactly and by their keys. What a product's
rejections take away is a join of the rejections with the offers of their keys.
What stays cheapest for a product with r rejections is among the first r + 1 keys
of its band, so it looks at a shortlist of that length, in classes of r by powers
of two. Nobody meets offers that somebody else rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import MATCHES_KEPT, PACK_RATIO_HIGH, PACK_RATIO_LOW
from ..functions.core import AsOf
from ..functions.price import (comparable_offer, effective_pack_price, gap_pct, own_promo_active, per_100g,
                               regular_pack_price, stated_or_derived_discount)
from ..functions.text import offer_key, pack_grams
from ..sources.staging import stage
from .gates import strictly_valid, validity_filter
from .ranking import newest_per_key

CELL = ["scope", "category", "grams"]
#: Offers of a price block that one join key holds at most, about.
BLOCK_ROWS = 4096


def priced_offers(live: DataFrame, *, as_of: AsOf, validity: str | None = None) -> DataFrame:
    """Live offers that are strictly valid, unconditional and have a price per 100 g."""
    df = live.filter(strictly_valid(as_of) & comparable_offer() & validity_filter(validity, as_of))
    df = df.withColumn("category", F.upper(F.trim("category"))).withColumn("grams", pack_grams("pack_size")).withColumn("pack_price", effective_pack_price())
    df = df.withColumn("unit", per_100g("pack_price", "grams")).filter(F.col("unit").isNotNull())
    df = df.withColumn("regular_pack", regular_pack_price())
    return df.withColumns({
        "regular_unit": per_100g("regular_pack", "grams"), "offer_key": offer_key(),
        "discount": stated_or_derived_discount("discount_percentage", "regular_pack", "pack_price"),
    })


def own_catalogue(own: DataFrame, *, as_of: AsOf) -> DataFrame:
    """Own products with grams, regular unit price and, while a promotion runs, promo unit price."""
    df = own.withColumn("category", F.upper(F.trim("category")))
    df = df.withColumn("grams", F.coalesce(F.when(F.col("pack_grams") > 0, F.col("pack_grams")), pack_grams("pack_size")))
    df = df.withColumn("has_promo", own_promo_active(as_of))
    df = df.withColumn("promo_pack", F.when(F.col("has_promo"), effective_pack_price(
        discount=F.lit(None).cast("double"), mechanic="promo_type")))
    return df.withColumns({"own_unit": per_100g("regular_price", "grams"), "own_promo_unit": per_100g("promo_pack", "grams")})


def latest_decisions(log: DataFrame) -> DataFrame:
    """Keyed upsert: the last verdict per (own product, offer key)."""
    return newest_per_key(log, ["own_id", "offer_key"], F.col("reviewed_at").desc(), F.col("log_id").desc()).select(
        "own_id", "offer_key", "accepted")


def reset_decisions(decisions: DataFrame, products: DataFrame) -> DataFrame:
    return decisions.join(products.select("own_id").distinct(), "own_id", "left_anti")


# --- scopes (allow-lists) -------------------------------------------------------------------------------------------

def scope_offers(offers: DataFrame, *, by_brand: bool = False, by_sku: bool = False) -> DataFrame:
    """Every offer in scope ``*`` and, when allow-lists are in play, in its brand's and SKU's scopes."""
    brand = F.upper(F.trim(F.coalesce(F.col("brand"), F.col("competitor")))) if by_brand else None
    sku = F.trim(F.col("sku")) if by_sku else None
    scopes = [F.lit("*")]
    if by_brand:
        scopes.append(F.when(brand.isNotNull(), F.concat(F.lit("B:"), brand)))
    if by_sku:
        scopes.append(F.when(sku.isNotNull(), F.concat(F.lit("S:"), sku)))
    if by_brand and by_sku:
        scopes.append(F.when(sku.isNotNull() & brand.isNotNull(), F.concat(F.lit("S:"), sku, F.lit("|B:"), brand)))
    if len(scopes) == 1:
        return offers.withColumn("scope", scopes[0])
    return offers.withColumn("scope", F.explode(F.array_compact(F.array(*scopes))))


def scope_own(own: DataFrame, *, brand_map: DataFrame | None = None, sku_map: DataFrame | None = None) -> DataFrame:
    """Own products with the scopes they may be compared with.

    ``brand_map``: (brand, allowed_brand); ``sku_map``: (sku, allowed_sku). A
    product without an entry is unrestricted.
    """
    df = own
    if brand_map is not None:
        allowed = brand_map.select(F.trim("brand").alias("_brand"), F.upper(F.trim(F.col("allowed_brand"))).alias("_b")).distinct()
        df = df.join(allowed, F.trim(df["brand"]) == F.col("_brand"), "left").drop("_brand")
    if sku_map is not None:
        allowed = sku_map.select(F.trim("sku").alias("_sku"), F.trim(F.col("allowed_sku")).alias("_s")).distinct()
        df = df.join(allowed, F.trim(df["sku"]) == F.col("_sku"), "left").drop("_sku")
    b = F.concat(F.lit("B:"), F.col("_b")) if brand_map is not None else F.lit(None).cast("string")
    s = F.concat(F.lit("S:"), F.col("_s")) if sku_map is not None else F.lit(None).cast("string")
    return df.withColumn("scope", F.coalesce(F.concat(s, F.lit("|"), b), s, b, F.lit("*"))).drop("_b", "_s")


# --- band join on distinct pack sizes -------------------------------------------------------------------------------

def _bucket(grams: Column) -> Column:
    return F.floor(F.log2(grams) + F.lit(1e-9)).cast("int")


def band(own_cells: DataFrame, offer_cells: DataFrame, *, low: float = PACK_RATIO_LOW, high: float = PACK_RATIO_HIGH) -> DataFrame:
    """Which offer pack sizes lie in the band of which own pack size.

    Equi-join on a power-of-two bucket; bounds within a factor 2**k differ by at
    most k buckets, so each own size looks at 2k+1 buckets and the exact ratio
    decides. Both inputs are distinct (scope, category, grams).
    """
    reach = max(1, math.ceil(abs(math.log2(low))), math.ceil(abs(math.log2(high)))) if low > 0 else 40
    own = own_cells.select("scope", "category", F.col("grams").alias("own_grams")).filter(F.col("own_grams") > 0).distinct()
    own = own.withColumn("_b", F.explode(F.sequence(_bucket(F.col("own_grams")) - reach, _bucket(F.col("own_grams")) + reach)))
    offers = offer_cells.select(*CELL).filter(F.col("grams") > 0).distinct().withColumn("_b", _bucket(F.col("grams")))
    ratio = F.col("grams") / F.col("own_grams")
    return own.join(offers, ["scope", "category", "_b"]).filter((ratio >= low) & (ratio <= high)).drop("_b")


# --- counting below a price -----------------------------------------------------------------------------------------

def _block(unit: Column) -> Column:
    """Price block: sixteen blocks per doubling keep a crowded cell spread over many tasks."""
    return F.floor(F.log2(F.greatest(unit, F.lit(0.01))) * 16).cast("int")


def count_below(prices: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (cell, value): offers with unit < value and unit <= value in that cell.

    ``prices``: CELL + unit + n, one row per distinct unit. ``probes``: CELL +
    value, distinct. A running sum inside (cell, block) plus the total of the
    lower blocks; no task ever holds a whole cell.
    """
    offers = prices.select(*CELL, _block(F.col("unit")).alias("block"), F.col("unit").alias("value"), F.col("n"), F.lit(1).alias("kind"))
    points = probes.select(*CELL, _block(F.col("value")).alias("block"), "value", F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("kind"))
    both = offers.unionByName(points)
    blocks = both.groupBy(*CELL, "block").agg(F.sum("n").alias("block_n"))
    lower = W.partitionBy(*CELL).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.withColumn("before", F.coalesce(F.sum("block_n").over(lower), F.lit(0))).drop("block_n")
    # at one value: probes sort before offers, so the running sum at a probe is the strict count
    ranked = both.select(*CELL, "block", "value", "kind", "n").withColumns({
        "run": F.sum("n").over(W.partitionBy(*CELL, "block").orderBy("value", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)),
        "same": F.sum("n").over(W.partitionBy(*CELL, "block", "value")),
    })
    hits = ranked.filter(F.col("kind") == 0)
    return hits.join(starts, CELL + ["block"]).select(
        *CELL, "value", (F.col("before") + F.col("run")).alias("n_lt"), (F.col("before") + F.col("run") + F.col("same")).alias("n_le"))


def offer_prices(offers: DataFrame) -> DataFrame:
    """Offers per (cell, unit price): combines map-side."""
    return offers.groupBy(*CELL, "unit").agg(F.count(F.lit(1)).alias("n"))


def offer_totals(prices: DataFrame) -> DataFrame:
    return prices.groupBy(*CELL).agg(F.sum("n").alias("cell_n"), F.sum(_cents("unit") * F.col("n")).alias("cell_cents"), F.min("unit").alias("cell_min"))


def _cents(unit: str) -> Column:
    return F.floor(F.col(unit) * 100 + F.lit(0.5000001)).cast("bigint")


def below_in_band(bands: DataFrame, prices: DataFrame, values: DataFrame) -> DataFrame:
    """For each own cell and value: offers in its band below the value. ``values``: scope, category, own_grams, value."""
    asked = values.filter(F.col("value").isNotNull()).distinct().join(bands, ["scope", "category", "own_grams"])
    counted = count_below(prices, asked.select(*CELL, "value").distinct())
    return asked.join(counted, CELL + ["value"]).groupBy("scope", "category", "own_grams", "value").agg(
        F.sum("n_lt").alias("n_lt"), F.sum("n_le").alias("n_le"))


def best_of_cell(offers: DataFrame, n: int, *extra_key: str) -> DataFrame:
    """The ``n`` cheapest offers of each cell (rank limit runs before the shuffle)."""
    order = W.partitionBy(*CELL, *extra_key).orderBy("unit", "promotion_id")
    return offers.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn")


# --- per own product ------------------------------------------------------------------------------------------------

def undercut_ceiling(own_unit: Column | str) -> Column:
    """Highest unit price (whole cents) whose rounded gap to ``own_unit`` is still negative."""
    own = F.col(own_unit) if isinstance(own_unit, str) else own_unit
    cents = F.floor(own * F.lit(99.95))
    at = lambda k: (cents + k).cast("double") / F.lit(100.0)
    return (F.when(gap_pct(at(1), own) < 0, at(1)).when(gap_pct(at(0), own) < 0, at(0)).when(own.isNotNull(), at(-1)))


def price_position(own: DataFrame, offers: DataFrame, decisions: DataFrame, probes: list[str], *, low: float = PACK_RATIO_LOW,
                   high: float = PACK_RATIO_HIGH) -> DataFrame:
    """Per ``own_id``: how many offers match, their price total, the cheapest, and counts below each probe price.

    ``own`` carries own_id, scope, category, grams and the probe columns. Adds
    ``matches``, ``cents``, ``cheapest_unit`` and ``<probe>_lt`` / ``<probe>_le``.
    """
    no = rejections(decisions)
    # staged, so that the plan of each job stays small: the driver holds every version of a plan as text
    prices = stage(offer_prices(offers), "prices")
    totals = stage(offer_totals(prices), "totals")
    key = ["scope", "category", "own_grams"]
    products = stage(own.select("own_id", "scope", "category", F.col("grams").alias("own_grams"), *probes), "products")
    bands = stage(band(products.withColumnRenamed("own_grams", "grams"), totals, low=low, high=high), "bands")
    per_cell = bands.join(totals, CELL).groupBy(*key).agg(
        F.sum("cell_n").alias("n"), F.sum("cell_cents").alias("cents"), F.min("cell_min").alias("cheapest"))
    below = stage(below_in_band(bands, prices, products.select(*key, F.explode(F.array(*probes)).alias("value"))), "below")
    joined = products.join(per_cell, key, "left")
    for p in probes:
        joined = joined.join(below.select(*key, F.col("value").alias(p), F.col("n_lt").alias(f"{p}_lt"), F.col("n_le").alias(f"{p}_le")),
                             key + [p], "left")
    counts = [f"{p}_{side}" for p in probes for side in ("lt", "le")]
    reviewed = stage(_taken_away(products, offers, no, probes, low, high), "reviewed")
    left = cheapest_left(products.withColumnRenamed("own_grams", "grams"), offers, no, 1, low=low, high=high).groupBy("own_id").agg(F.min("unit").alias("left_min"))
    reviewers = no.select("own_id").distinct().withColumn("is_reviewer", F.lit(True))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    # a product with several scopes (several allowed brands) adds them up
    summed = joined.join(reviewed, ["own_id", "scope"], "left").groupBy("own_id").agg(
        F.sum(zero("n") - zero("r_n")).alias("matches"), F.sum(zero("cents") - zero("r_cents")).alias("cents"),
        *[F.sum(zero(c) - zero(f"r_{c}")).alias(c) for c in counts], F.min("cheapest").alias("cheapest"))
    return summed.join(reviewers, "own_id", "left").join(left, "own_id", "left").withColumn(
        "cheapest_unit", F.when(F.col("is_reviewer"), F.col("left_min")).otherwise(F.col("cheapest"))).drop("cheapest", "is_reviewer", "left_min")


def rejections(decisions: DataFrame) -> DataFrame:
    return decisions.filter(~F.col("accepted")).select("own_id", "offer_key").distinct()


def _taken_away(products: DataFrame, offers: DataFrame, no: DataFrame, probes: list[str], low: float, high: float) -> DataFrame:
    """What the rejections of a product take away in its band: one row per rejection and price of the rejected key."""
    keyed = offers.groupBy(*CELL, "unit", "offer_key").agg(F.count(F.lit(1)).alias("c_n"))
    ratio = F.col("grams") / F.col("own_grams")
    lost = products.join(no, "own_id").join(keyed, ["offer_key", "scope", "category"]).filter((ratio >= low) & (ratio <= high))
    return lost.groupBy("own_id", "scope").agg(
        F.sum("c_n").alias("r_n"), F.sum(_cents("unit") * F.col("c_n")).alias("r_cents"),
        *[F.sum(F.when(F.col("unit") < F.col(p), F.col("c_n"))).alias(f"r_{p}_lt") for p in probes],
        *[F.sum(F.when(F.col("unit") <= F.col(p), F.col("c_n"))).alias(f"r_{p}_le") for p in probes])


def _by_rejections(rows: DataFrame, no: DataFrame, key: str) -> tuple[DataFrame, list[int]]:
    """Rows that have rejections, with ``_most``, their number's class: the next power of two. And the classes that occur, at most as many as a count has bits."""
    most = F.pow(F.lit(2.0), F.ceil(F.log2("_r"))).cast("bigint")
    counted = stage(rows.join(no.groupBy(key).agg(F.count(F.lit(1)).alias("_r")), key).withColumn("_most", most).drop("_r"), "rejecting")
    return counted, sorted(r["_most"] for r in counted.select("_most").distinct().collect())


def _up_to(ranked: DataFrame, classes: list[int], more: int) -> DataFrame:
    """Rows of rank ``_rn``, once for each class ``_most`` whose shortlist of ``_most`` + ``more`` they are in."""
    lists = F.filter(F.array(*[F.lit(c).cast("bigint") for c in classes]), lambda c: F.col("_rn") <= c + more)
    return ranked.filter(F.col("_rn") <= max(classes) + more).withColumn("_most", F.explode(lists)).drop("_rn")


def cheapest_left(own: DataFrame, offers: DataFrame, no: DataFrame, keep: int, *, low: float = PACK_RATIO_LOW, high: float = PACK_RATIO_HIGH) -> DataFrame:
    """For products that rejected something: the ``keep`` cheapest offers of their band that they did not reject.

    Of the first r + keep offer keys of a band at least ``keep`` are left to a product with r rejections.
    All classes of r share one plan; what several of its steps read is staged.
    """
    key = ["scope", "category", "own_grams"]
    cols = ["own_id", "promotion_id", "unit", "offer_key"]
    products = own.select("own_id", "scope", "category", F.col("grams").alias("own_grams")).distinct()
    people, classes = _by_rejections(products, no, "own_id")
    slim = offers.select(*CELL, "unit", "promotion_id", "offer_key")
    if not classes:
        return people.join(slim.limit(0), ["scope", "category"]).select(*cols)
    first = slim.groupBy(*CELL, "offer_key").agg(F.min(F.struct("unit", "promotion_id")).alias("first"))
    in_cell = stage(_up_to(first.withColumn("_rn", F.row_number().over(W.partitionBy(*CELL).orderBy("first"))), classes, keep), "in_cell")
    sizes = stage(band(people.withColumnRenamed("own_grams", "grams"), in_cell, low=low, high=high), "sizes")
    asked = people.select(*key, "_most").distinct().join(sizes, key)
    in_band = asked.join(in_cell, [*CELL, "_most"]).groupBy(*key, "_most", "offer_key").agg(F.min("first").alias("first"))
    by_first = F.row_number().over(W.partitionBy(*key, "_most").orderBy("first"))
    short = stage(in_band.withColumn("_rn", by_first).filter(F.col("_rn") <= max(classes) + keep).filter(F.col("_rn") <= F.col("_most") + keep).drop("_rn"), "shortlists")
    free = people.join(short, [*key, "_most"]).join(no, ["own_id", "offer_key"], "left_anti")
    per_own = W.partitionBy("own_id", "scope").orderBy("first")
    kept = free.withColumn("_rn", F.row_number().over(per_own)).filter(F.col("_rn") <= keep).select("own_id", *key, "offer_key")
    listed = slim.join(in_cell.select(*CELL, "offer_key").distinct(), [*CELL, "offer_key"], "left_semi")
    return stage(kept.join(sizes, key).join(best_of_cell(listed, keep, "offer_key"), [*CELL, "offer_key"]).select(*cols), "left")


def match_summary(own: DataFrame, offers: DataFrame, decisions: DataFrame, *, low: float = PACK_RATIO_LOW,
                  high: float = PACK_RATIO_HIGH) -> DataFrame:
    """Per comparable own product: matches, undercuts of the regular and of the promo price, mean and lowest competitor unit price."""
    comparable = own.filter(F.col("own_unit").isNotNull()).withColumns({
        "cap": undercut_ceiling("own_unit"), "promo_cap": undercut_ceiling("own_promo_unit")})
    position = price_position(comparable, offers, decisions, ["cap", "promo_cap"], low=low, high=high)
    prices = comparable.select("own_id", "own_unit", "own_promo_unit").distinct()
    mean = F.try_divide(F.col("cents").cast("double") / F.lit(100.0), F.col("matches").cast("double"))
    return position.join(prices, "own_id").select(
        "own_id", "own_unit", "own_promo_unit", "matches", F.col("cap_le").alias("undercuts"),
        F.when(F.col("own_promo_unit").isNotNull(), F.col("promo_cap_le")).alias("promo_undercuts"),
        "cheapest_unit", mean.alias("mean_unit"))


def top_matches(own: DataFrame, offers: DataFrame, decisions: DataFrame, *, keep: int = MATCHES_KEPT,
                low: float = PACK_RATIO_LOW, high: float = PACK_RATIO_HIGH) -> DataFrame:
    """The ``keep`` cheapest matches of every own product, rejected offers excluded, confirmed ones marked.

    Without rejections, the shortlist of a band is the best of its cells' shortlists,
    computed once per own pack size. With rejections, see ``cheapest_left``.
    """
    key = ["scope", "category", "own_grams"]
    no = rejections(decisions)
    slim = offers.select(*CELL, "unit", "promotion_id", "offer_key")
    best = best_of_cell(slim, keep)
    bands = band(own, best.select(*CELL).distinct(), low=low, high=high)
    by_size = W.partitionBy(*key).orderBy("unit", "promotion_id")
    short = bands.join(best, CELL).withColumn("_rn", F.row_number().over(by_size)).filter(F.col("_rn") <= keep).drop("_rn")
    products = own.select("own_id", "scope", "category", F.col("grams").alias("own_grams"))
    untouched = products.join(no.select("own_id").distinct(), "own_id", "left_anti")
    cols = ["own_id", "promotion_id", "unit", "offer_key"]
    both = untouched.join(short, key).select(*cols).unionByName(cheapest_left(own, offers, no, keep, low=low, high=high))
    per_own = W.partitionBy("own_id").orderBy("unit", "promotion_id")
    top = both.withColumn("position", F.row_number().over(per_own)).filter(F.col("position") <= keep)
    yes = decisions.filter("accepted").select("own_id", "offer_key", F.lit(True).alias("confirmed"))
    return top.join(yes, ["own_id", "offer_key"], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))


def match_details(top: DataFrame, own: DataFrame, offers: DataFrame, *, as_of: AsOf) -> DataFrame:
    """Adds the gaps, flags and offer columns to a shortlist."""
    from ..functions.dates import days_left
    from .gates import validity_status
    keep = [c for c in ("product_name", "competitor", "brand", "retailer", "retailer_channel_type", "pack_size", "promotion_type",
                        "start_date", "end_date", "pack_price", "regular_pack", "regular_unit", "discount", "last_verified_at")
            if c in offers.columns]
    top = stage(top, "top")  # read twice below; the plans behind it are large
    shown = offers.filter(F.col("scope") == "*") if "scope" in offers.columns else offers
    needed = shown.join(top.select("promotion_id").distinct(), "promotion_id", "left_semi").select(
        "promotion_id", F.col("grams").alias("offer_grams"), *keep)
    products = own.select("own_id", "own_unit", "own_promo_unit").distinct()
    df = top.join(needed, "promotion_id").join(products, "own_id")
    return df.withColumns({
        "gap_pct": gap_pct("unit", "own_unit"), "promo_gap_pct": gap_pct("unit", "own_promo_unit"),
        "regular_gap_pct": gap_pct("regular_unit", "own_unit"), "validity_status": validity_status(as_of),
        "days_remaining": F.when(F.col("end_date").isNotNull(), days_left("end_date", as_of)),
    }).withColumns({
        "undercuts_us": F.coalesce(F.col("gap_pct") < 0, F.lit(False)), "undercuts_our_promo": F.col("promo_gap_pct") < 0,
        "match_basis": F.when(F.col("confirmed"), "Analyst confirmed").otherwise("Category and pack size"),
    })


def undercut_offers(own: DataFrame, offers: DataFrame, decisions: DataFrame, *, gap: float, low: float = PACK_RATIO_LOW, high: float = PACK_RATIO_HIGH,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every (own product, offer) in the band whose gap is ``gap`` per cent or lower, rejected offers excluded.

    A range join whose work follows its result. Offers lie in price blocks of their cell, and crowded
    blocks in parts of about ``block_rows``. Which blocks reach below a ceiling is settled once for each
    distinct (pack size, block of the ceiling), on blocks that hold offers. A product then meets
    whole blocks below its ceiling, all of which are results, and the block at the ceiling, where the exact gap decides.
    Products and offers that stand there several times are found beforehand; only their pairs are shuffled to be told apart.
    """
    key = ["scope", "category", "own_grams"]
    spot = [*CELL, "block", "part"]
    ceiling = F.col("own_unit") * F.lit(1.0 + (gap + 0.06) / 100.0) + F.lit(1e-6)  # the gap is rounded to one decimal
    again = lambda *names: F.count(F.lit(1)).over(W.partitionBy(*names)) > 1
    products = stage(own.filter(F.col("own_unit") > 0).select("own_id", "scope", "category", F.col("grams").alias("own_grams"), "own_unit", _block(ceiling).alias("border")).distinct()
                     .withColumn("own_again", again("own_id")), "products")
    slim = stage(offers.select(*CELL, "unit", "promotion_id", "offer_key", _block(F.col("unit")).alias("block")).withColumn("offer_again", again("promotion_id", "scope")), "slim")
    blocks = stage(slim.groupBy(*CELL, "block").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("parts")), "blocks")
    dealt = slim.join(blocks, [*CELL, "block"]).withColumn("part", F.pmod(F.xxhash64("promotion_id"), F.col("parts")).cast("int")).drop("parts")
    sizes = band(products.withColumnRenamed("own_grams", "grams"), blocks, low=low, high=high)
    asked = products.select(*key, "border").distinct().join(sizes, key).join(blocks, CELL).filter(F.col("block") <= F.col("border"))
    below = stage(asked.select(*key, "border", "grams", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "below")
    no = rejections(decisions)

    def found(products: DataFrame, dealt: DataFrame) -> DataFrame:
        met = products.join(below, [*key, "border"]).join(dealt, spot).withColumn("gap_pct", gap_pct("unit", "own_unit")).filter(F.col("gap_pct") <= gap)
        return met.select("own_id", "promotion_id", "unit", "offer_key", "own_unit", "gap_pct")

    # a product of one row looks at one scope, so only what stands there several times can meet twice; all other pairs need no shuffle to be told apart
    once, more = products.filter(~F.col("own_again")), products.filter("own_again")
    pairs = found(once, dealt.filter(~F.col("offer_again")))
    twice = [part for part, there in ((lambda: found(once, dealt.filter("offer_again")), slim.filter("offer_again")), (lambda: found(more, dealt), more)) if not there.isEmpty()]
    for part in twice:
        pairs = pairs.unionByName(part().dropDuplicates(["own_id", "promotion_id"]))
    return pairs.join(no, ["own_id", "offer_key"], "left_anti")


def undercut_flags(offers: DataFrame, own: DataFrame, decisions: DataFrame, target: Column, *, low: float = PACK_RATIO_LOW,
                   high: float = PACK_RATIO_HIGH) -> DataFrame:
    """Adds ``undercuts``: some own product in the band, not rejecting this offer, has ``target`` above the offer's unit price.

    "Some product is dearer" is "the dearest product is dearer", so one maximum per
    own pack size answers it for every offer that nobody rejected. An offer key with
    k rejections has a willing product, if any, among the k + 1 dearest of its band.
    """
    products = own.filter(F.col("own_unit").isNotNull()).select(
        "own_id", F.lit("*").alias("scope"), "category", "grams", target.alias("target")).filter(F.col("target").isNotNull()).distinct()
    no = rejections(decisions).join(products.select("own_id").distinct(), "own_id", "left_semi")
    cells = offers.select(F.lit("*").alias("scope"), "category", "grams").distinct()
    bands = band(products, cells, low=low, high=high)
    key = ["category", "own_grams"]
    sized = products.withColumnRenamed("grams", "own_grams")
    peak = sized.groupBy(*key).agg(F.max("target").alias("peak"))
    everyone = bands.join(peak, key).groupBy("category", "grams").agg(F.max("peak").alias("peak_all"))
    asked = offers.select("offer_key", "category", "grams").distinct()
    keys, classes = _by_rejections(asked, no, "offer_key")
    willing = keys.select("offer_key", "category", "grams", F.lit(None).cast("double").alias("peak_willing"), F.lit(True).alias("is_contested"))
    if classes:
        dearest = _up_to(sized.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("target"), "own_id"))), classes, 1)
        in_band = F.row_number().over(W.partitionBy("category", "grams", "_most").orderBy(F.desc("target"), "own_id"))
        ranked = bands.join(dearest, key).select("category", "grams", "_most", "own_id", "target").withColumn("_rn", in_band)
        short = stage(ranked.filter(F.col("_rn") <= max(classes) + 1).filter(F.col("_rn") <= F.col("_most") + 1).drop("_rn"), "willing")
        free = keys.join(short, ["category", "grams", "_most"]).join(no, ["own_id", "offer_key"], "left_anti").groupBy("offer_key", "category", "grams").agg(F.max("target").alias("peak_willing"))
        willing = keys.withColumn("is_contested", F.lit(True)).join(free, ["offer_key", "category", "grams"], "left").select(*willing.columns)
    df = offers.join(everyone, ["category", "grams"], "left").join(willing, ["offer_key", "category", "grams"], "left")
    peak = F.when(F.col("is_contested"), F.col("peak_willing")).otherwise(F.col("peak_all"))
    return df.withColumn("undercuts", F.coalesce(F.col("unit") < peak, F.lit(False))).drop("peak_all", "peak_willing", "is_contested")


def apply_scoped_prices(own: DataFrame, scoped: DataFrame, retailers: DataFrame, *, retailer: str | None, region: str | None,
                        local_day: str) -> DataFrame:
    """Catalogue with the latest recorded price for that retailer, region and day; other products stay as they are."""
    if not retailer or not region:
        return own
    shops = retailers.filter(F.lower("name") == retailer.lower()).select("retailer_id")
    day = F.lit(local_day).cast("date")
    current = scoped.filter((F.col("region") == region.upper()) & (F.col("starts") <= day) & (F.col("ends") >= day)).join(
        shops, "retailer_id", "left_semi")
    latest = newest_per_key(current, "product_id", F.col("recorded_at").desc(), F.col("id")).select(
        F.col("product_id").alias("own_id"), F.col("regular_price").cast("double").alias("_regular"),
        F.col("promo_price").cast("double").alias("_promo"), F.lit(True).alias("_scoped"))
    df = own.join(latest, "own_id", "left")
    hit = F.coalesce(F.col("_scoped"), F.lit(False))
    has_promo = F.coalesce(F.col("_promo") > 0, F.lit(False))
    return df.withColumns({
        "regular_price": F.when(hit, F.col("_regular")).otherwise(F.col("regular_price")),
        "promo_price": F.when(hit, F.when(has_promo, F.col("_promo"))).otherwise(F.col("promo_price")),
        "promo_type": F.when(hit, F.when(has_promo, "DISCOUNT").otherwise("REGULAR")).otherwise(F.col("promo_type")),
        "buy_quantity": F.when(~hit, F.col("buy_quantity")), "free_quantity": F.when(~hit, F.col("free_quantity")),
        "promo_start_date": F.when(~hit, F.col("promo_start_date")), "promo_end_date": F.when(~hit, F.col("promo_end_date")),
        "scoped": hit,
    }).drop("_regular", "_promo", "_scoped")


def brand_or_all(own: DataFrame, brand: str | None) -> DataFrame:
    """The brand's products, or the whole catalogue when the brand has none."""
    if not brand:
        return own
    known = own.filter(F.col("brand") == brand).limit(1).agg(F.count(F.lit(1))).scalar()
    return own.filter((known == 0) | (F.col("brand") == brand))

