"""Price comparison, breakdowns and what-if simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import MATCHES_KEPT, PACK_RATIO_HIGH, PACK_RATIO_LOW, SIMULATION_MATCHES_KEPT
from ..functions.core import AsOf, count_if, days, exact_avg, instant, round_half_up
from ..functions.price import effective_pack_price, gap_pct, per_100g
from ..operators import matching as M
from ..operators.search import contains

NO_PACK_NOTE = "No pack size in grams, so there is no price per 100 g."
NO_OFFER_NOTE = "No live offer of this category has a pack near this size."


def filter_offers(live: DataFrame, *, category: str | None = None, brand: str | None = None, competitor: str | None = None,
                  retailer: str | None = None, channel: str | None = None, region: str | None = None) -> DataFrame:
    """The comparison's own filters (exact category, channel and region; contains elsewhere)."""
    df = live
    for column, value in (("geography_region", region), ("category", category), ("retailer_channel_type", channel)):
        if value:
            df = df.filter(F.col(column) == value.upper())
    if competitor:
        df = df.filter(contains("competitor", competitor))
    if brand:
        df = df.filter(contains("brand", brand) | contains("competitor", brand))
    if retailer:
        df = df.filter(contains("retailer", retailer))
    return df


def compare_products(own: DataFrame, offers: DataFrame, decisions: DataFrame, *, pressure: str | None = None, search: str | None = None,
                     low: float = PACK_RATIO_LOW, high: float = PACK_RATIO_HIGH) -> DataFrame:
    """One row per own product, including the ones that cannot be compared.

    ``search`` keeps products whose name or SKU contains the term; other products
    stay only with the offers whose product or competitor contains it.
    """
    offers, own = M.scope_offers(offers), M.scope_own(own)
    term = (search or "").strip().lower()
    if not term:
        summary = M.match_summary(own, offers, decisions, low=low, high=high)
        named = F.lit(True)
    else:
        named = contains("name", term) | contains("sku", term)
        hit = contains("product_name", term) | contains("competitor", term)
        summary = M.match_summary(own.filter(named), offers, decisions, low=low, high=high).unionByName(
            M.match_summary(own.filter(~named), offers.filter(hit), decisions, low=low, high=high))
    rows = own.select("own_id", "sku", "name", "brand", "category", "pack_size", "grams", "regular_price", "own_unit", "has_promo",
                      "promo_pack", "own_promo_unit", F.when(F.col("has_promo"), F.col("promo_type")).alias("promo_type"), named.alias("_named"))
    df = rows.join(summary.drop("own_unit", "own_promo_unit"), "own_id", "left")
    matches = F.coalesce(F.col("matches"), F.lit(0).cast("bigint"))
    under = F.coalesce(F.col("undercuts"), F.lit(0).cast("bigint"))
    df = df.withColumns({
        "matches": matches, "undercuts": under,
        "promo_undercuts": F.when(F.col("has_promo"), F.coalesce(F.col("promo_undercuts"), F.lit(0).cast("bigint"))),
        "largest_gap_pct": gap_pct("cheapest_unit", "own_unit"),
        "largest_promo_gap_pct": F.when(F.col("has_promo"), gap_pct("cheapest_unit", "own_promo_unit")),
        "price_index": F.when(F.col("mean_unit") > 0, F.coalesce(F.col("own_promo_unit"), F.col("own_unit")) / F.col("mean_unit") * 100.0),
        "note": F.when(F.col("own_unit").isNull(), NO_PACK_NOTE).when(matches == 0, NO_OFFER_NOTE),
    })
    if pressure:
        df = df.filter(F.col("own_unit").isNotNull() & (F.col("matches") > 0))
        df = df.filter(F.col("undercuts") > 0 if pressure == "UNDER_PRESSURE" else F.col("undercuts") == 0)
    if term:
        df = df.filter(F.col("_named") | (F.col("matches") > 0))
    return df.drop("_named").orderBy(F.col("largest_gap_pct").asc_nulls_last(), "own_id")


def comparison_matches(own: DataFrame, offers: DataFrame, decisions: DataFrame, *, as_of: AsOf, keep: int = MATCHES_KEPT,
                       low: float = PACK_RATIO_LOW, high: float = PACK_RATIO_HIGH, brand_map: DataFrame | None = None,
                       sku_map: DataFrame | None = None) -> DataFrame:
    """The shortlist of every own product with gaps and flags."""
    offers = M.scope_offers(offers, by_brand=brand_map is not None, by_sku=sku_map is not None)
    own = M.scope_own(own.filter(F.col("own_unit").isNotNull()), brand_map=brand_map, sku_map=sku_map)
    return M.match_details(M.top_matches(own, offers, decisions, keep=keep, low=low, high=high), own, offers, as_of=as_of)


def price_index(products: DataFrame) -> DataFrame:
    """Unweighted mean of the product indices, one decimal, and its distance from 100."""
    index = round_half_up(F.avg("price_index"), 1)
    return products.agg(index.alias("price_index_vs_market")).withColumn(
        "price_index_gap_pct", round_half_up(F.col("price_index_vs_market") - 100.0, 1))


def summary(products: DataFrame, offers: DataFrame, *, as_of: AsOf) -> DataFrame:
    """One row of executive figures."""
    has = F.col("matches") > 0
    left = products.agg(
        F.count(F.lit(1)).alias("own_products"), count_if(has).alias("comparable_products"),
        count_if(has & (F.col("undercuts") > 0)).alias("under_pressure"), round_half_up(F.avg("price_index"), 1).alias("price_index_vs_market"))
    label = F.coalesce(F.col("brand"), F.col("competitor"), F.lit("Unknown"))
    right = offers.agg(F.count(F.lit(1)).alias("active_competitor_promotions"), F.countDistinct(label).alias("brands_tracked"),
                       count_if(F.col("end_date") <= instant(as_of) + days(7)).alias("expiring_soon"))
    names = ["active_competitor_promotions", "brands_tracked", "expiring_soon"]
    packed = right.select(F.struct(*names)).scalar()
    df = left.withColumn("_o", packed).select("*", *[F.col(f"_o.{n}").alias(n) for n in names]).drop("_o")
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return df.withColumns({
        "not_comparable": F.col("own_products") - F.col("comparable_products"),
        "pct_under_pressure": round_half_up(share("under_pressure", "comparable_products") * 100.0, 1),
        "avg_promos_per_brand": F.coalesce(round_half_up(share("active_competitor_promotions", "brands_tracked"), 1), F.lit(0.0)),
        "price_index_gap_pct": round_half_up(F.col("price_index_vs_market") - 100.0, 1),
    })


def deepest_discounts(offers: DataFrame) -> DataFrame:
    """Deepest discount per category; ``is_overall`` marks the deepest of all. Ties: lowest promotion id."""
    category = F.upper(F.coalesce(F.col("category"), F.lit("OTHER")))
    stake = F.struct(F.col("discount"), "product_name", F.coalesce("competitor", "brand").alias("competitor"), "retailer", "promotion_id")
    # max_by keeps one row per task before the shuffle; the second key breaks ties downwards
    best = offers.filter(F.col("discount") > 0).groupBy(category.alias("category"), "discount").agg(
        F.min_by(stake, "promotion_id").alias("s")).groupBy("category").agg(F.max_by("s", "discount").alias("s"))
    flat = best.select("category", "s.discount", "s.product_name", "s.competitor", "s.retailer", "s.promotion_id")
    first = W.orderBy(F.col("discount").desc(), "promotion_id")
    return flat.withColumn("is_overall", F.row_number().over(first) == 1)


# --- breakdowns -----------------------------------------------------------------------------------------------------

def labelled(flagged: DataFrame) -> DataFrame:
    """Offers with the breakdown labels; ``flagged`` comes from ``matching.undercut_flags``."""
    return flagged.select(
        F.upper(F.coalesce("category", F.lit("OTHER"))).alias("category"),
        F.coalesce("brand", "competitor", F.lit("Unknown")).alias("brand"),
        F.coalesce("competitor", "brand", F.lit("Unknown")).alias("competitor"), F.col("competitor").alias("owner"),
        F.col("brand").alias("known_brand"), F.coalesce("retailer", F.lit("Unknown")).alias("retailer"),
        F.col("retailer_channel_type").alias("channel_type"), F.coalesce("promotion_type", F.lit("DISCOUNT")).alias("mechanic"),
        "unit", F.col("discount_percentage").alias("stated"), "undercuts")


def _measures() -> dict[str, Column]:
    return {
        "offers": F.count(F.lit(1)), "undercut_offers": count_if(F.col("undercuts")),
        "avg_unit": round_half_up(exact_avg(F.col("unit"), 2), 2), "min_unit": F.min("unit"), "max_unit": F.max("unit"),
        "avg_discount": round_half_up(exact_avg(F.col("stated"), 4), 1),
    }


def _agg(df: DataFrame, keys: list[str], names: list[str], *more: Column) -> DataFrame:
    m = _measures()
    return df.groupBy(*keys).agg(*[m[n].alias(n) for n in names], *more)


def by_brand(df: DataFrame) -> DataFrame:
    return _agg(df, ["brand"], ["offers", "undercut_offers", "avg_unit", "min_unit", "max_unit", "avg_discount"],
                F.concat_ws(",", F.array_sort(F.collect_set("mechanic"))).alias("mechanics"))


def by_category(df: DataFrame) -> DataFrame:
    return _agg(df, ["category"], ["offers", "undercut_offers", "avg_unit", "min_unit", "max_unit"],
                F.countDistinct("brand").alias("brands"), F.countDistinct("retailer").alias("retailers"))


def by_retailer(df: DataFrame) -> DataFrame:
    main = _agg(df, ["retailer", "channel_type"], ["offers", "undercut_offers", "avg_unit", "min_unit", "avg_discount"])
    return main.join(top_value(df, "retailer", "mechanic", "top_mechanic"), "retailer")


def top_value(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Most frequent value per key (ties: smallest value); counts are combined map-side first."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.groupBy(key, "n").agg(F.min(value).alias("v"))
    return ranked.groupBy(key).agg(F.max_by("v", "n").alias(name))


def by_mechanic(df: DataFrame) -> DataFrame:
    return _agg(df, ["mechanic"], ["offers", "undercut_offers", "avg_unit", "avg_discount"])


def by_competitor(df: DataFrame) -> DataFrame:
    return df.groupBy("competitor").agg(F.count(F.lit(1)).alias("offers"), F.countDistinct("known_brand").alias("brands"))


def all_breakdowns(df: DataFrame) -> DataFrame:
    """The five breakdowns in one pass: (dimension, label) with the shared measures."""
    dims = ["brand", "category", "retailer", "mechanic", "competitor"]
    m = _measures()
    sets = [[F.col(d)] for d in dims]
    grouped = df.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        *[F.grouping(d).alias(f"g_{d}") for d in dims], *[m[n].alias(n) for n in m])
    dimension = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.lit(d)) for d in dims])
    return grouped.select(dimension.alias("dimension"), F.coalesce(*dims).alias("label"), *m)


# --- what-if --------------------------------------------------------------------------------------------------------

def prepare_scenarios(scenarios: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable scenarios with candidate and baseline unit prices, rejected scenarios with a reason).

    ``scenarios``: scenario_id, own_id (nullable), category, grams, regular_price,
    candidate_price, candidate_discount, mechanic, buy_quantity, free_quantity;
    nulls fall back to the stored product.
    """
    stored = own.select("own_id", F.col("category").alias("_category"), F.col("grams").alias("_grams"),
                        F.col("regular_price").alias("_regular"), "has_promo", "own_promo_unit")
    df = scenarios.join(stored, "own_id", "left")
    df = df.withColumns({"category": F.upper(F.coalesce("category", "_category", F.lit("BISCUIT"))),
                         "grams": F.coalesce("grams", "_grams"), "base": F.coalesce("regular_price", "_regular")})
    by_discount = F.when(F.col("candidate_discount").isNotNull() & (F.col("base") > 0),
                         F.col("base") * (F.lit(1.0) - F.col("candidate_discount") / 100.0))
    df = df.withColumn("promo", F.coalesce("candidate_price", by_discount, "base"))
    df = df.withColumn("candidate_pack", effective_pack_price(regular="base", promo="promo", discount="candidate_discount", mechanic="mechanic"))
    reason = F.when(~F.coalesce(F.col("grams") > 0, F.lit(False)), "Pack size in grams is required for comparison.").when(
        ~F.coalesce(F.col("promo") > 0, F.lit(False)), "A valid candidate price or regular price is required.")
    df = df.withColumn("reason", reason).withColumn("candidate_unit", per_100g("candidate_pack", "grams"))
    promo_runs = F.coalesce(F.col("has_promo"), F.lit(False)) & F.col("own_promo_unit").isNotNull()
    df = df.withColumn("baseline_unit", F.when(promo_runs, F.col("own_promo_unit")).otherwise(per_100g("base", "grams")))
    cols = ["scenario_id", "own_id", "category", "grams", "candidate_pack", "candidate_unit", "baseline_unit"]
    return df.filter(F.col("reason").isNull()).select(*cols), df.filter(F.col("reason").isNotNull()).select("scenario_id", "reason")


def _as_products(ready: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    products = ready.select(F.col("scenario_id").alias("own_id"), F.lit("*").alias("scope"), "category", "grams", "candidate_unit", "baseline_unit")
    verdicts = ready.select("scenario_id", "own_id").join(decisions, "own_id").select(
        F.col("scenario_id").alias("own_id"), "offer_key", "accepted")
    return products, verdicts


def simulate(ready: DataFrame, offers: DataFrame, decisions: DataFrame, *, low: float = PACK_RATIO_LOW,
             high: float = PACK_RATIO_HIGH) -> DataFrame:
    """Market position of every scenario, from counts below two prices (no scenario x offer pairs)."""
    products, verdicts = _as_products(ready, decisions)
    pos = M.price_position(products, M.scope_offers(offers), verdicts, ["candidate_unit", "baseline_unit"], low=low, high=high)
    df = ready.join(pos.withColumnRenamed("own_id", "scenario_id"), "scenario_id")
    total, rank = F.col("matches"), F.col("candidate_unit_lt") + 1
    known = F.col("baseline_unit").isNotNull()
    current = F.when(known, F.col("baseline_unit_lt") + 1)
    cap = lambda q: F.greatest(F.lit(1.0), total * F.lit(q))
    position = (F.when(total == 0, "NO_COMPETITORS").when(rank == 1, "CHEAPEST_IN_MARKET").when(rank <= cap(0.25), "TOP_QUARTILE_COMPETITIVE")
                .when(rank <= cap(0.5), "MID_MARKET").otherwise("PREMIUM_TIER"))
    before = F.when(known, F.col("baseline_unit_lt")).otherwise(0)
    return df.select(
        "scenario_id", "candidate_unit", "baseline_unit", total.alias("comparable"), rank.alias("projected_rank"), current.alias("current_rank"),
        (current - rank).alias("rank_change"), (F.col("candidate_unit_lt") - before).alias("undercut_change"),
        (total - F.col("candidate_unit_le")).alias("cheaper_than"), position.alias("market_position"),
        F.greatest(F.lit(0), before - F.col("candidate_unit_lt")).alias("eliminated"), F.col("candidate_unit_lt").alias("remaining"),
        F.col("cheapest_unit").alias("target_unit"),
        round_half_up(F.col("cheapest_unit") * F.col("grams") / 100.0, 2).alias("target_pack_price"))


def simulation_matches(ready: DataFrame, offers: DataFrame, decisions: DataFrame, *, keep: int = SIMULATION_MATCHES_KEPT,
                       low: float = PACK_RATIO_LOW, high: float = PACK_RATIO_HIGH) -> DataFrame:
    """The cheapest offers a scenario meets, marked as eliminated or remaining undercuts."""
    products, verdicts = _as_products(ready, decisions)
    top = M.top_matches(products, M.scope_offers(offers), verdicts, keep=keep, low=low, high=high)
    df = top.withColumnRenamed("own_id", "scenario_id").join(ready.select("scenario_id", "candidate_unit", "baseline_unit"), "scenario_id")
    below = F.col("unit") < F.col("candidate_unit")
    base = F.coalesce(F.col("unit") < F.col("baseline_unit"), F.lit(False))
    return df.select("scenario_id", "position", "promotion_id", "unit", gap_pct("unit", "candidate_unit").alias("gap_vs_candidate"),
                     gap_pct("unit", "baseline_unit").alias("gap_vs_baseline"), below.alias("remains"), (base & ~below).alias("eliminated"))


def export_rows(products: DataFrame, matches: DataFrame) -> DataFrame:
    """Comparison matrix: one row per product and shortlisted offer, a placeholder row without offers."""
    gap = F.col("gap_pct")
    shown = F.concat(F.format_string("%.1f", gap), F.lit("%"))
    status = (F.when(F.col("promotion_id").isNull(), "No Competitor Moves").when(gap < 0, F.concat(F.lit("Undercut ("), shown, F.lit(")")))
              .when(gap > 0, F.concat(F.lit("Competitive (+"), shown, F.lit(")"))).otherwise("Parity"))
    m = matches.select("own_id", "position", "promotion_id", F.col("product_name").alias("offer"), "competitor",
                       F.col("brand").alias("offer_brand"), F.col("unit"), "pack_price", "gap_pct", "validity_status",
                       F.to_date("end_date").alias("valid_until"), "retailer", "retailer_channel_type")
    df = products.select("own_id", "category", "name", "sku", "pack_size", "regular_price", "promo_pack", "promo_type", "own_unit", "has_promo").join(m, "own_id", "left")
    none = F.col("promotion_id").isNull()
    return df.select(
        "own_id", F.coalesce("position", F.lit(0)).alias("position"), "category", "name", F.coalesce("sku", F.lit("")).alias("sku"),
        F.coalesce("pack_size", F.lit("")).alias("pack_size"), "regular_price", F.when(F.col("has_promo"), F.col("promo_type")).otherwise("REGULAR").alias("promo_type"),
        F.when(none, "None").otherwise(F.coalesce("competitor", F.lit(""))).alias("competitor"),
        F.when(none, "No active competitor promotions").otherwise(F.coalesce("offer", F.lit(""))).alias("offer"),
        "pack_price", "unit", F.when(none, "").otherwise(F.coalesce(shown, F.lit(""))).alias("gap"), status.alias("status"),
        F.when(none, "").otherwise(F.coalesce(F.col("valid_until").cast("string"), F.lit("Ongoing"))).alias("valid_until"))
