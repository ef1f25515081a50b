"""Counters, trends, overviews and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import DIGEST_LIMIT
from ..functions.core import AsOf, count_if, days, exact_avg, instant, round_half_up
from ..sources.staging import stage
from .gates import source_health


def source_readiness(sources: DataFrame, *, as_of: AsOf, names_shown: int = 5) -> DataFrame:
    ready = (F.col("approval_status") == "APPROVED") & F.col("is_active")
    df = sources.select("name", "approval_status", ready.alias("ready"), source_health(as_of).alias("health"))
    bad = F.col("ready") & F.col("health").isin("FAILING", "STALE")
    counts = df.agg(count_if(F.col("ready")).alias("approved_active"), count_if(F.col("approval_status") == "CANDIDATE").alias("candidates"),
                    count_if(bad).alias("unhealthy"))
    first = df.filter(bad).orderBy("name").limit(names_shown).agg(
        F.concat_ws(", ", F.sort_array(F.collect_list("name"))))
    return counts.withColumn("first_unhealthy", first.scalar())


# --- counters and distributions -------------------------------------------------------------------------------------

def ending_between(as_of: AsOf, n: int = 7) -> Column:
    return F.col("end_date").isNotNull() & (F.col("end_date") >= instant(as_of)) & (F.col("end_date") <= instant(as_of) + days(n))


def stats_counters(promotions: DataFrame, live: DataFrame, competitors: DataFrame, brands: DataFrame, retailers: DataFrame, *, as_of: AsOf) -> DataFrame:
    """One row. "Expiring" looks at every ACTIVE promotion, live or not."""
    size = lambda df: df.agg(F.count(F.lit(1))).scalar()
    base = promotions.agg(count_if((F.col("status") == "ACTIVE") & ending_between(as_of)).alias("expiring_soon_7days"))
    return base.select(size(live).alias("active_promotions"), size(competitors.filter("is_active")).alias("competitors_tracked"),
                       size(brands).alias("brands_tracked"), size(retailers).alias("retailers_tracked"), "expiring_soon_7days")


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("promotions"))


def weekly_trend(promotions: DataFrame, *, as_of: AsOf, weeks: int = 8) -> DataFrame:
    """New promotions and average discount per competitor and week, zero-filled over the last ``weeks`` weeks."""
    now = instant(as_of)
    monday = F.date_trunc("week", now.cast("timestamp_ntz")).cast("date")
    recent = promotions.filter(F.col("first_seen_at") >= now - days(7 * weeks)).filter(F.col("competitor").isNotNull())
    cells = recent.groupBy("competitor", F.date_trunc("week", "first_seen_at").cast("date").alias("week")).agg(
        F.count(F.lit(1)).alias("promotions"), round_half_up(exact_avg(F.col("discount_percentage"), 4), 1).alias("avg_discount"))
    cells = cells.filter((F.col("week") >= F.date_sub(monday, 7 * (weeks - 1))) & (F.col("week") <= monday))
    totals = cells.groupBy("competitor").agg(F.sum("promotions").alias("total"))
    calendar = F.sequence(F.date_sub(monday, 7 * (weeks - 1)), monday, F.expr("INTERVAL 7 DAYS"))
    dense = totals.select("competitor", "total", F.explode(calendar).alias("week"))
    return dense.join(cells, ["competitor", "week"], "left").select(
        "competitor", "week", F.coalesce("promotions", F.lit(0)).alias("promotions"), "avg_discount", "total")


def competitor_overview(live: DataFrame, competitors: DataFrame, promotions: DataFrame, change_events: DataFrame, *, as_of: AsOf) -> DataFrame:
    """One row per active competitor; competitors without live promotions stay with zeros."""
    from ..plans.comparison import top_value
    now = instant(as_of)
    known = live.filter(F.col("competitor_id").isNotNull())
    base = known.groupBy("competitor_id").agg(
        F.count(F.lit(1)).alias("live_promotions"),
        round_half_up(exact_avg(F.when(F.col("discount_percentage") != 0, F.col("discount_percentage")), 4), 1).alias("avg_discount"),
        F.countDistinct("retailer_id").alias("outlets"), count_if(F.col("first_seen_at") >= now - days(7)).alias("new_this_week"),
        count_if(ending_between(as_of)).alias("ending_soon"))
    mechanic = top_value(known, "competitor_id", "promotion_type", "top_mechanic")
    recent = change_events.filter((F.col("observed_at") >= now - days(7)) & (F.col("event_type") != "CREATED")).groupBy("promotion_id").agg(
        F.count(F.lit(1)).alias("n"))
    changes = recent.join(promotions.select("promotion_id", "competitor_id"), "promotion_id").groupBy("competitor_id").agg(
        F.sum("n").alias("changes_this_week"))
    df = competitors.filter("is_active").select("competitor_id", "name")
    for part in (base, mechanic, changes):
        df = df.join(part, "competitor_id", "left")
    zeros = ["live_promotions", "outlets", "new_this_week", "changes_this_week", "ending_soon"]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in zeros}).orderBy(F.col("live_promotions").desc(), "name")


# --- digest ---------------------------------------------------------------------------------------------------------

def new_promotions(live: DataFrame, *, as_of: AsOf, window_days: int = 7) -> DataFrame:
    return live.filter(F.col("first_seen_at") >= instant(as_of) - days(window_days))


def digest_new(live: DataFrame, *, as_of: AsOf, window_days: int = 7, limit: int = DIGEST_LIMIT) -> DataFrame:
    new = new_promotions(live, as_of=as_of, window_days=window_days)
    return new.orderBy(F.col("rank_score").desc(), "promotion_id").limit(limit)


def digest_ending(promotions: DataFrame, *, as_of: AsOf, limit: int = DIGEST_LIMIT) -> DataFrame:
    """Ending within seven days, live or not."""
    ending = promotions.filter((F.col("status") == "ACTIVE") & ending_between(as_of))
    return ending.orderBy("end_date", F.col("rank_score").desc(), "promotion_id").limit(limit)


def recent_changes(change_events: DataFrame, *, as_of: AsOf, window_days: int = 7) -> DataFrame:
    return change_events.filter((F.col("observed_at") >= instant(as_of) - days(window_days)) & (F.col("event_type") != "CREATED"))


def digest_changes(change_events: DataFrame, promotions: DataFrame, *, as_of: AsOf, window_days: int = 7, limit: int = DIGEST_LIMIT) -> DataFrame:
    """Largest recent changes; the names are joined to the survivors only."""
    top = recent_changes(change_events, as_of=as_of, window_days=window_days).orderBy(
        F.col("change_impact").desc(), F.col("observed_at").desc(), "promotion_id").limit(limit)
    return top.join(promotions.select("promotion_id", "product_name", "competitor"), "promotion_id")


def digest_by_competitor(live: DataFrame, *, as_of: AsOf, window_days: int = 7, limit: int = 10) -> DataFrame:
    new = new_promotions(live, as_of=as_of, window_days=window_days).filter(F.col("competitor").isNotNull())
    return distribution(new, "competitor").orderBy(F.col("promotions").desc(), "competitor").limit(limit)


def _lines(rows: DataFrame, title: str, total: Column, line: Column, *order: Column) -> DataFrame:
    """One section of the digest text from at most ``limit`` rows."""
    numbered = rows.select(F.row_number().over(W.orderBy(*order)).alias("i"), line.alias("line"))
    body = numbered.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda r: F.concat(F.lit("  * "), r["line"])).alias("lines"))
    more = total - F.size("lines")
    return body.select(F.concat_ws("\n", F.concat(F.lit(title.upper() + " ("), total, F.lit(")")),
                                   F.when(F.size("lines") == 0, "  * Nothing to report.").otherwise(F.concat_ws("\n", "lines")),
                                   F.when(more > 0, F.concat(F.lit("  ... and "), more, F.lit(" more (see the dashboard)")))).alias("text"))


def promotion_line() -> Column:
    offer = (F.when(F.col("discount_percentage") > 0, F.concat(F.lit("("), F.regexp_replace(F.col("discount_percentage").cast("string"), r"\.0$", ""), F.lit("% off)")))
             .when(F.col("promo_price") > 0, F.concat(F.lit("(Rp"), F.format_number("promo_price", 0), F.lit(")"))))
    return F.concat_ws(" ", F.coalesce("competitor", "brand", F.lit("?")), F.lit("-"), "product_name",
                       F.concat(F.lit("@ "), F.coalesce("retailer", F.lit("n/a"))), offer,
                       F.concat(F.lit("until "), F.to_date("end_date").cast("string")))


def render_digest(live: DataFrame, promotions: DataFrame, change_events: DataFrame, *, as_of: AsOf, window_days: int = 7) -> DataFrame:
    """The digest as one row: subject and text."""
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    new, changes = new_promotions(live, as_of=as_of, window_days=window_days), recent_changes(change_events, as_of=as_of, window_days=window_days)
    ending = promotions.filter((F.col("status") == "ACTIVE") & ending_between(as_of))
    changed_line = F.concat(F.coalesce("competitor", F.lit("?")), F.lit(" - "), "product_name", F.lit(": "), F.coalesce("field_name", "event_type"),
                            F.lit(" "), "previous_value", F.lit(" -> "), "new_value")
    score, key = F.col("rank_score").desc(), F.col("promotion_id")
    parts = [
        _lines(digest_new(live, as_of=as_of, window_days=window_days), "New promotions", count(new), promotion_line(), score, key),
        _lines(digest_changes(change_events, promotions, as_of=as_of, window_days=window_days), "Changes to existing promotions", count(changes),
               changed_line, F.col("change_impact").desc(), F.col("observed_at").desc(), key),
        _lines(digest_ending(promotions, as_of=as_of), "Ending within 7 days", count(ending), promotion_line(), F.col("end_date"), score, key),
    ]
    subject = F.concat(F.lit("Competitor promotions: "), count(new), F.lit(" new, "), count(changes), F.lit(" changed, "), count(ending), F.lit(" ending soon"))
    return parts[0].select(subject.alias("subject"), F.concat_ws("\n\n", subject, F.col("text"), parts[1].scalar(), parts[2].scalar()).alias("text"))


# --- executive ------------------------------------------------------------------------------------------------------

def recent_by_category(live: DataFrame, *, as_of: AsOf) -> DataFrame:
    return distribution(new_promotions(live, as_of=as_of), "category")


def executive_exposures(products: DataFrame, matches: DataFrame, *, limit: int = 10) -> DataFrame:
    """First products under pressure, each with its cheapest offer."""
    ranked = products.filter(F.col("undercuts") > 0).orderBy(F.col("largest_gap_pct").asc_nulls_last(), "own_id").limit(limit)
    worst = stage(ranked.select("own_id", "name", "category", "undercuts", "largest_gap_pct"), "worst")  # so that no plan holds both sides whole
    first = matches.filter(F.col("position") == 1).select("own_id", "promotion_id", "unit", "gap_pct")
    return worst.join(first, "own_id")


def newest_actions(actions: DataFrame, promotions: DataFrame, *, limit: int = 30) -> DataFrame:
    top = actions.join(promotions.select("promotion_id", "product_name"), "promotion_id")
    return top.orderBy(F.col("recorded_at").desc(), "action_id").limit(limit)


# --- regional and shrinkage -----------------------------------------------------------------------------------------

def regional_cells(live: DataFrame) -> DataFrame:
    """Product x region: price range, unit price of the lowest price, outlets and wordings."""
    from ..functions.price import effective_pack_price, per_100g
    from ..functions.text import pack_grams, regional_key
    df = live.withColumn("price", effective_pack_price()).filter(F.col("price").isNotNull())
    df = df.withColumns({"product_key": regional_key("product_name", "pack_size"), "region": F.coalesce("geography_region", F.lit("UNKNOWN"))})
    out = df.groupBy("product_key", "region").agg(
        F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.count(F.lit(1)).alias("offers"),
        F.array_sort(F.collect_set("retailer")).alias("outlets"), F.array_sort(F.collect_set("geography")).alias("wordings"),
        F.min("pack_size").alias("pack_size"), F.min("product_name").alias("product_name"))
    return out.withColumn("unit", per_100g("min_price", pack_grams("pack_size")))


def regional_products(cells: DataFrame) -> DataFrame:
    """Spread over stated regions only; unstated geography is counted apart."""
    stated = F.when(F.col("region") != "UNKNOWN", F.col("min_price"))
    df = cells.groupBy("product_key").agg(
        F.min("product_name").alias("product_name"), F.count(stated).alias("regions_compared"), F.min(stated).alias("lo"), F.max(stated).alias("hi"),
        F.max(F.col("region") == "UNKNOWN").alias("has_unstated"))
    spread = F.when((F.col("regions_compared") >= 2) & (F.col("lo") > 0), round_half_up((F.col("hi") - F.col("lo")) / F.col("lo") * 100.0, 1))
    df = df.withColumn("spread_pct", spread).withColumn("differs_by_region", F.coalesce(F.col("spread_pct") > 0, F.lit(False)))
    return df.drop("lo", "hi").orderBy(F.coalesce("spread_pct", F.lit(0.0)).desc(), F.col("regions_compared").desc(), F.lower("product_name"), "product_key")


def regional_columns(cells: DataFrame) -> DataFrame:
    """Stated regions present, in display order; regions outside the fixed order follow alphabetically."""
    from ..functions.geo import REGION_LABELS, REGION_ORDER
    order = F.array_position(F.array(*[F.lit(x) for x in REGION_ORDER]), F.col("region"))
    labels = F.create_map(*[F.lit(x) for pair in REGION_LABELS.items() for x in pair])
    present = cells.select("region").distinct().filter(F.col("region") != "UNKNOWN")
    place = F.row_number().over(W.orderBy(F.when(order == 0, F.lit(999)).otherwise(order), "region"))
    return present.select("region", F.coalesce(F.try_element_at(labels, F.col("region")), F.col("region")).alias("label"), place.alias("place"))


def shrinkflation(promotions: DataFrame, *, as_of: AsOf, window_days: int, min_downsize_pct: float, unit_floor: float) -> DataFrame:
    """Product families whose newest pack is smaller than the earliest while the unit price held or rose.

    Earliest and latest come from ``min_by`` / ``max_by``: partial aggregation,
    one row per family and task through the shuffle, however large a family is.
    """
    from ..functions.price import per_100g
    from ..functions.text import family_name, pack_grams
    df = promotions.filter(F.col("first_seen_at") >= instant(as_of) - days(window_days))
    df = df.withColumns({"grams": pack_grams("pack_size"), "family": family_name("product_name")}).filter(
        (F.col("grams") > 0) & (F.length("family") >= 3))
    pack = F.struct("promotion_id", "product_name", "pack_size", "grams", "first_seen_at", "category", "retailer",
                    F.coalesce(F.when(F.col("regular_price") != 0, F.col("regular_price")), "promo_price").alias("price"))
    moment = F.struct("first_seen_at", "promotion_id")
    g = df.groupBy("competitor", "brand", "family").agg(F.min_by(pack, moment).alias("a"), F.max_by(pack, moment).alias("b"), F.count(F.lit(1)).alias("n"))
    g = g.filter((F.col("n") >= 2) & (F.col("a.grams") > F.col("b.grams")))
    g = g.withColumn("downsize_grams", round_half_up(F.col("a.grams") - F.col("b.grams"), 1))
    g = g.withColumns({"downsize_pct": round_half_up(F.col("downsize_grams") / F.col("a.grams") * 100.0, 1),
                       "old_unit": per_100g("a.price", "a.grams"), "new_unit": per_100g("b.price", "b.grams")})
    change = F.floor((F.col("new_unit") - F.col("old_unit")) / F.col("old_unit") * 1000.0 + F.lit(0.5000001)) / F.lit(10.0)
    g = g.withColumn("unit_inflation_pct", change).filter(
        (F.col("downsize_pct") >= min_downsize_pct) & (F.col("old_unit") > 0) & (F.col("unit_inflation_pct") >= unit_floor))
    return g.select(
        F.coalesce("competitor", F.lit("Competitor")).alias("competitor"), F.coalesce("brand", F.lit("Brand")).alias("brand"),
        F.initcap("family").alias("product_family"), F.col("a.pack_size").alias("old_pack_size"), F.col("b.pack_size").alias("new_pack_size"),
        F.col("a.first_seen_at").alias("baseline_at"), F.col("b.first_seen_at").alias("latest_at"),
        "downsize_grams", "downsize_pct", F.col("a.price").alias("old_price"), F.col("b.price").alias("new_price"), "old_unit", "new_unit",
        "unit_inflation_pct", F.coalesce("b.category", "a.category", F.lit("OTHER")).alias("category"),
        F.coalesce("b.retailer", F.lit("Modern Trade")).alias("outlet")).orderBy(F.col("unit_inflation_pct").desc(), "competitor", "brand", "product_family")


# --- the flat feed --------------------------------------------------------------------------------------------------

def bi_feed(promotions: DataFrame, evidence: DataFrame, *, as_of: AsOf, campaign: str | None = None) -> DataFrame:
    """The flat analytical feed. ``promotions`` carries ``undercuts`` and the prices from ``matching``.

    Keywords are looked up per evidence row and only the codes (at most nine per
    promotion) are gathered, so a promotion with endless evidence stays one small row.
    """
    from ..functions.campaigns import CAMPAIGNS, campaign_codes, campaign_labels
    needed = evidence.join(promotions.select("promotion_id"), "promotion_id", "left_semi").withColumn(
        "_codes", campaign_codes("evidence_text", F.lit(None).cast("string")))
    moment = F.struct("captured_at", "created_at", "evidence_id")
    quotes = needed.groupBy("promotion_id").agg(
        F.max_by(F.struct("evidence_text", "source_url", "evidence_type"), moment).alias("e"),
        *[F.max(F.when(F.array_contains("_codes", code), F.lit(code))).alias(f"_{code}") for code in CAMPAIGNS])
    df = promotions.join(quotes, "promotion_id", "left")
    own_codes = campaign_codes(F.concat_ws(" ", "product_name", "category"), "promotion_type", buy="buy_quantity")
    df = df.withColumn("_own", own_codes)
    df = df.withColumn("codes", F.array_compact(F.array(*[
        F.coalesce(F.col(f"_{code}"), F.when(F.array_contains("_own", code), F.lit(code))) for code in CAMPAIGNS])))
    if campaign:
        df = df.filter(F.array_contains("codes", campaign.upper()))
    stated = F.col("start_date").isNotNull() | F.col("end_date").isNotNull()
    day = lambda c: F.to_date(c).cast("string")
    return df.select(
        "promotion_id", "product_name", F.coalesce("brand", F.lit("Unbranded")).alias("brand"), F.coalesce("competitor", F.lit("Unknown")).alias("competitor"),
        F.coalesce("category", F.lit("OTHER")).alias("category"), F.coalesce("pack_size", F.lit("Unknown")).alias("pack_size"), F.col("grams").alias("pack_grams"),
        "regular_price", "promo_price", F.col("pack_price").alias("effective_pack_price"), F.col("unit").alias("price_per_100g"),
        round_half_up(F.col("discount_percentage"), 1).alias("discount_percentage"), "promotion_type", F.concat_ws(",", "codes").alias("campaign_codes"),
        F.concat_ws(", ", campaign_labels(F.col("codes"))).alias("campaign_labels"), F.coalesce("retailer", F.lit("Modern Trade")).alias("retailer"),
        F.coalesce("channel", F.lit("Offline")).alias("channel"), F.coalesce("geography_region", F.lit("UNKNOWN")).alias("geography_region"),
        F.coalesce("geography", F.lit("")).alias("geography_raw"), day("start_date").alias("start_date"), day("end_date").alias("end_date"),
        stated.alias("dates_stated"), "status",
        ((F.col("status") == "ACTIVE") & (F.col("end_date").isNull() | (F.col("end_date") >= instant(as_of)))).alias("is_active"),
        F.coalesce(round_half_up(F.col("rank_score"), 1), F.lit(0.0)).alias("rank_score"), round_half_up(F.col("ai_confidence"), 2).alias("ai_confidence"),
        F.coalesce(round_half_up(F.col("source_reliability"), 2), F.lit(0.0)).alias("source_reliability"), F.col("has_open_conflict").alias("has_conflict"),
        F.col("undercuts").alias("undercuts_our_product"), "first_seen_at", "last_seen_at", "last_verified_at",
        F.when(F.col("e.evidence_type") == "APPROVED_FIELD", "FIELD").when(F.col("e").isNotNull(), "WEB").alias("evidence_origin"),
        F.coalesce("e.source_url", F.lit("")).alias("source_url"), F.coalesce("e.evidence_text", F.lit("")).alias("evidence_quote"))
