"""Counters, trends, digests, regional, shrinkage, feed and alert-input queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config
from ..functions.geo import shown_channel
from ..operators import matching as M, ranking as R, reports as P
from ..plans import comparison as C
from ..sources import views as V
from ..sources.tables import Tables
from .oracle import AS_OF, EFFECTIVE, r, xavg
from .q_compare import LABEL_COLUMNS, OFFER_COLUMNS, decisions, offers, own
from .q_live import live
from .registry import query

_ENDING = f"end_date IS NOT NULL AND end_date>={AS_OF} AND end_date<={AS_OF}+INTERVAL 7 DAY"


@query("stats_counters", f"""SELECT (SELECT count(*) FROM live) AS active_promotions, (SELECT count(*) FROM competitors WHERE is_active) AS competitors_tracked, (SELECT count(*) FROM brands) AS brands_tracked,
 (SELECT count(*) FROM retailers) AS retailers_tracked, (SELECT count(*) FROM promotions WHERE status='ACTIVE' AND {_ENDING}) AS expiring_soon_7days""", "live competitors brands retailers promotions")
def stats_counters(t: Tables) -> DataFrame:
    return P.stats_counters(V.promotions(t, "status", "end_date"), live(t), V.competitors(t), V.brands(t), V.retailers(t), as_of=V.AS_OF)


@query("type_distribution", "SELECT promotion_type, count(*) AS promotions FROM live GROUP BY 1", "live")
def type_distribution(t: Tables) -> DataFrame:
    return P.distribution(live(t, "promotion_type"), "promotion_type")


@query("retailer_distribution", "SELECT retailer, count(*) AS promotions FROM live GROUP BY 1", "live")
def retailer_distribution(t: Tables) -> DataFrame:
    return P.distribution(live(t, "retailer"), "retailer")


@query("weekly_trend", f"""+ p AS (SELECT competitor, CAST(date_trunc('week', first_seen_at) AS DATE) AS week, discount_percentage FROM promotions WHERE competitor IS NOT NULL AND first_seen_at>={AS_OF}-INTERVAL 56 DAY),
cells AS (SELECT competitor, week, count(*) AS promotions, {r(xavg('discount_percentage', 4), 1)} AS avg_discount FROM p WHERE week BETWEEN DATE '2000-11-13' AND DATE '2001-01-01' GROUP BY 1,2),
tot AS (SELECT competitor, CAST(sum(promotions) AS BIGINT) AS total FROM cells GROUP BY 1), wk AS (SELECT DATE '2000-11-13' + CAST(i*7 AS INTEGER) AS week FROM range(8) x(i))
SELECT t.competitor, CAST(w.week AS VARCHAR) AS week, coalesce(c.promotions,0) AS promotions, avg_discount, total FROM tot t CROSS JOIN wk w LEFT JOIN cells c ON c.competitor=t.competitor AND c.week=w.week""", "promotions")
def weekly_trend(t: Tables) -> DataFrame:
    p = V.promotions(t, "competitor", "first_seen_at", "discount_percentage")
    return P.weekly_trend(p, as_of=V.AS_OF).withColumn("week", F.col("week").cast("string"))


@query("competitor_overview", f"""+ m AS (SELECT competitor_id, promotion_type, row_number() OVER (PARTITION BY competitor_id ORDER BY count(*) DESC, promotion_type) rn FROM live GROUP BY 1,2),
ch AS (SELECT competitor_id, count(*) AS n FROM change_events e JOIN promotions p ON p.promotion_id=e.promotion_id WHERE observed_at>={AS_OF}-INTERVAL 7 DAY AND event_type<>'CREATED' GROUP BY 1)
SELECT c.competitor_id, c.name, count(l.promotion_id) AS live_promotions, {r(xavg('l.discount_percentage', 4, ' FILTER (l.discount_percentage<>0)'), 1)} AS avg_discount, max(m.promotion_type) AS top_mechanic,
 count(DISTINCT l.retailer_id) AS outlets, count(*) FILTER (l.first_seen_at>={AS_OF}-INTERVAL 7 DAY) AS new_this_week, coalesce(max(ch.n),0) AS changes_this_week,
 count(*) FILTER (l.end_date>={AS_OF} AND l.end_date<={AS_OF}+INTERVAL 7 DAY) AS ending_soon
FROM competitors c LEFT JOIN live l ON l.competitor_id=c.competitor_id LEFT JOIN m ON m.competitor_id=c.competitor_id AND rn=1 LEFT JOIN ch ON ch.competitor_id=c.competitor_id WHERE c.is_active GROUP BY 1,2""", "live competitors promotions change_events")
def competitor_overview(t: Tables) -> DataFrame:
    shown = live(t, "discount_percentage", "promotion_type", "retailer_id", "first_seen_at")
    return P.competitor_overview(shown, V.competitors(t), V.promotions(t, "promotion_id", "competitor_id"), V.change_events(t), as_of=V.AS_OF)


DIGEST = ["product_name", "competitor", "retailer", "channel", "retailer_channel_type", "promotion_type", "promo_price", "discount_percentage",
          "first_seen_at", "rank_score"]
_NEW = f"SELECT * FROM live WHERE first_seen_at>={AS_OF}-INTERVAL 7 DAY"


@query("digest_new", f"SELECT promotion_id, product_name, competitor, retailer, rank_score FROM ({_NEW}) ORDER BY rank_score DESC, promotion_id LIMIT 15", "live")
def digest_new(t: Tables) -> DataFrame:
    return P.digest_new(live(t, *DIGEST), as_of=V.AS_OF).select("promotion_id", "product_name", "competitor", "retailer", "rank_score")


@query("digest_ending", f"""SELECT promotion_id, product_name, CAST(CAST(end_date AS DATE) AS VARCHAR) AS valid_until FROM promotions WHERE status='ACTIVE' AND {_ENDING}
 ORDER BY end_date, rank_score DESC, promotion_id LIMIT 15""", "promotions")
def digest_ending(t: Tables) -> DataFrame:
    p = V.promotions(t, "promotion_id", "status", "end_date", "rank_score", "product_name")
    return P.digest_ending(p, as_of=V.AS_OF).select("promotion_id", "product_name", F.to_date("end_date").cast("string").alias("valid_until"))


@query("digest_changes", f"""+ e AS (SELECT * FROM change_events WHERE observed_at>={AS_OF}-INTERVAL 7 DAY AND event_type<>'CREATED' ORDER BY change_impact DESC, observed_at DESC, promotion_id LIMIT 15)
SELECT e.promotion_id, product_name, competitor, event_type, field_name, previous_value, new_value, observed_at FROM e JOIN promotions p ON p.promotion_id=e.promotion_id""", "change_events promotions")
def digest_changes(t: Tables) -> DataFrame:
    p = V.promotions(t, "promotion_id", "product_name", "competitor")
    return P.digest_changes(V.change_events(t), p, as_of=V.AS_OF).drop("change_impact")


@query("digest_by_competitor", f"SELECT competitor, count(*) AS promotions FROM ({_NEW}) WHERE competitor IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "live")
def digest_by_competitor(t: Tables) -> DataFrame:
    return P.digest_by_competitor(live(t, "competitor", "first_seen_at"), as_of=V.AS_OF)


@query("digest_text", f"""SELECT concat('Competitor promotions: ', (SELECT count(*) FROM ({_NEW})), ' new, ', (SELECT count(*) FROM change_events WHERE observed_at>={AS_OF}-INTERVAL 7 DAY AND event_type<>'CREATED'),
 ' changed, ', (SELECT count(*) FROM promotions WHERE status='ACTIVE' AND {_ENDING}), ' ending soon') AS subject""", "live change_events promotions")
def digest_text(t: Tables) -> DataFrame:
    p = V.promotions(t, "promotion_id", "status", "end_date", "rank_score", "product_name", "competitor", "brand", "retailer", "discount_percentage", "promo_price")
    return P.render_digest(live(t, *DIGEST), p, V.change_events(t), as_of=V.AS_OF).select("subject")


@query("executive_exposures", """+ s AS (SELECT own_id, count(*) FILTER (gap<0) AS undercuts, min(gap) AS largest_gap_pct FROM matches GROUP BY 1),
top AS (SELECT * FROM s WHERE undercuts>0 ORDER BY largest_gap_pct, own_id LIMIT 10), f AS (SELECT *, row_number() OVER (PARTITION BY own_id ORDER BY unit, promotion_id) rn FROM matches)
SELECT t.own_id, f.name, f.category, t.undercuts, t.largest_gap_pct, f.promotion_id, f.unit, f.gap AS gap_pct FROM top t JOIN f ON f.own_id=t.own_id AND rn=1""", "matches")
def executive_exposures(t: Tables) -> DataFrame:
    catalogue, book, verdicts = own(t), offers(t), decisions(t)
    products = C.compare_products(catalogue, book, verdicts)
    return P.executive_exposures(products, C.comparison_matches(catalogue, book, verdicts, as_of=V.AS_OF, keep=1))


@query("recent_by_category", f"SELECT category, count(*) AS promotions FROM ({_NEW}) GROUP BY 1", "live")
def recent_by_category(t: Tables) -> DataFrame:
    return P.recent_by_category(live(t, "category", "first_seen_at"), as_of=V.AS_OF)


@query("field_verified", "SELECT count(*) AS field_verified FROM live l WHERE EXISTS (SELECT 1 FROM evidence e WHERE e.promotion_id=l.promotion_id AND evidence_type='APPROVED_FIELD')", "live evidence")
def field_verified(t: Tables) -> DataFrame:
    return live(t).filter("has_field_evidence").agg(F.count(F.lit(1)).alias("field_verified"))


@query("marketing_responses", """SELECT promotion_id AS action_id, promotion_id, product_name, 'OPEN' AS status, last_seen_at AS recorded_at FROM promotions WHERE promotion_type='BUY_X_GET_Y' AND has_open_conflict
 ORDER BY last_seen_at DESC, promotion_id LIMIT 30""", "promotions")
def marketing_responses(t: Tables) -> DataFrame:
    p = V.promotions(t, "promotion_id", "product_name", "promotion_type", "has_open_conflict", "last_seen_at")
    actions = p.filter((F.col("promotion_type") == "BUY_X_GET_Y") & F.col("has_open_conflict")).select(
        F.col("promotion_id").alias("action_id"), "promotion_id", F.lit("OPEN").alias("status"), F.col("last_seen_at").alias("recorded_at"))
    return P.newest_actions(actions, p).select("action_id", "promotion_id", "product_name", "status", "recorded_at")


REGIONAL = ["product_name", "pack_size", "regular_price", "promo_price", "discount_percentage", "promotion_type", "buy_quantity", "free_quantity",
            "geography", "geography_region", "retailer"]
_CELLS = f"""cells AS (SELECT concat(lower(product_name),'|',regexp_replace(lower(pack_size),'[^a-z0-9]+','','g')) AS product_key, geography_region AS region, min(eff) AS min_price, max(eff) AS max_price, count(*) AS offers,
 string_agg(DISTINCT retailer, ',' ORDER BY retailer) AS outlets, string_agg(DISTINCT geography, ',' ORDER BY geography) AS wordings, min(product_name) AS product_name, min(grams) AS grams FROM priced WHERE eff IS NOT NULL GROUP BY 1,2)"""


def cells(t: Tables) -> DataFrame:
    return P.regional_cells(live(t, *REGIONAL))


@query("regional_cells", f"+ {_CELLS} SELECT product_key, region, min_price, max_price, offers, outlets, coalesce(wordings,'') AS wordings, {r('(min_price/grams*100.0::DOUBLE)', 2)} AS unit FROM cells", "priced")
def regional_cells(t: Tables) -> DataFrame:
    return cells(t).select("product_key", "region", "min_price", "max_price", "offers", F.concat_ws(",", "outlets").alias("outlets"),
                           F.concat_ws(",", "wordings").alias("wordings"), "unit")


@query("regional_products", f"""+ {_CELLS}, g AS (SELECT product_key, min(product_name) AS product_name, count(*) FILTER (region<>'UNKNOWN') AS regions_compared, min(min_price) FILTER (region<>'UNKNOWN') AS lo,
 max(min_price) FILTER (region<>'UNKNOWN') AS hi, bool_or(region='UNKNOWN') AS has_unstated FROM cells GROUP BY 1), s AS (SELECT *, CASE WHEN regions_compared>=2 AND lo>0 THEN {r('((hi-lo)/lo*100.0::DOUBLE)', 1)} END AS spread_pct FROM g)
SELECT product_key, product_name, regions_compared, has_unstated, spread_pct, coalesce(spread_pct>0,false) AS differs_by_region FROM s""", "priced")
def regional_products(t: Tables) -> DataFrame:
    return P.regional_products(cells(t))


@query("regional_columns", f"""+ {_CELLS}, o AS (SELECT * FROM (VALUES ('NATIONAL','Nationwide (stated)',1),('JABODETABEK','Jabodetabek',2),('JAWA','Jawa',3),('STORE_SPECIFIC','Selected stores',11),('MULTI_REGION','Several regions',12),('UNMAPPED','Stated, not mapped',13)) v(region,label,p))
SELECT c.region, label, (row_number() OVER (ORDER BY p))::INTEGER AS place FROM (SELECT DISTINCT region FROM cells WHERE region<>'UNKNOWN') c JOIN o ON o.region=c.region""", "priced")
def regional_columns(t: Tables) -> DataFrame:
    return P.regional_columns(cells(t))


@query("shrinkflation", f"""+ p AS (SELECT *, row_number() OVER (PARTITION BY competitor, brand, product_name ORDER BY first_seen_at, promotion_id) rn, row_number() OVER (PARTITION BY competitor, brand, product_name ORDER BY first_seen_at DESC, promotion_id DESC) rd
 FROM promotions WHERE first_seen_at>={AS_OF}-INTERVAL 700 DAY), s AS (SELECT a.competitor, a.brand, a.product_name AS fam, a.grams AS ga, b.grams AS gb, a.pack_size AS old_pack_size, b.pack_size AS new_pack_size, a.first_seen_at AS baseline_at, b.first_seen_at AS latest_at,
 a.regular_price AS old_price, b.regular_price AS new_price, b.category, b.retailer AS outlet, {r('(a.regular_price/a.grams*100.0::DOUBLE)', 2)} AS old_unit, {r('(b.regular_price/b.grams*100.0::DOUBLE)', 2)} AS new_unit
 FROM p a JOIN p b ON a.competitor IS NOT DISTINCT FROM b.competitor AND a.brand IS NOT DISTINCT FROM b.brand AND a.product_name=b.product_name WHERE a.rn=1 AND b.rd=1 AND a.promotion_id<>b.promotion_id AND a.grams>b.grams),
u AS (SELECT *, {r('(ga-gb)', 1)} AS downsize_grams, {r(f"({r('(ga-gb)', 1)}/ga*100.0::DOUBLE)", 1)} AS downsize_pct, {r('((new_unit-old_unit)/old_unit*100.0::DOUBLE)', 1)} AS unit_inflation_pct FROM s)
SELECT coalesce(competitor,'Competitor') AS competitor, coalesce(brand,'Brand') AS brand, array_to_string(list_transform(string_split(fam,' '), lambda w: concat(upper(w[1]), w[2:])),' ') AS product_family, old_pack_size, new_pack_size, baseline_at, latest_at,
 downsize_grams, downsize_pct, old_price, new_price, old_unit, new_unit, unit_inflation_pct, category, outlet FROM u WHERE downsize_pct>=5.0 AND old_unit>0 AND unit_inflation_pct>=-2.0""", "promotions")
def shrinkflation(t: Tables) -> DataFrame:
    p = V.promotions(t, "promotion_id", "competitor", "brand", "product_name", "pack_size", "regular_price", "promo_price", "category", "retailer", "first_seen_at")
    return P.shrinkflation(p, as_of=V.AS_OF, window_days=700, min_downsize_pct=config.SHRINK_MIN_DOWNSIZE, unit_floor=config.SHRINK_UNIT_FLOOR)


FEED = ["rank_score", "ai_confidence", "source_reliability", "channel", "geography", "geography_region", "first_seen_at"]
_KW = """coalesce(bool_or(regexp_matches(lower(e.evidence_text),'akhir pekan')),false) AS k_jsm, coalesce(bool_or(regexp_matches(lower(e.evidence_text),'beli 2 gratis 1')),false) AS k_bogo,
 coalesce(bool_or(regexp_matches(lower(e.evidence_text),'gopay')),false) AS k_cash, coalesce(bool_or(regexp_matches(lower(e.evidence_text),'member')),false) AS k_mem"""
_CODES = """concat_ws(',', CASE WHEN k_jsm THEN 'JSM_WEEKEND' END, CASE WHEN k_bogo OR promotion_type='BUY_X_GET_Y' THEN 'BOGO' END, CASE WHEN k_cash THEN 'CASHBACK_EWALLET' END,
 CASE WHEN k_mem OR promotion_type='MEMBER_PRICE' THEN 'MEMBER_SPECIAL' END)"""


def feed_rows(t: Tables) -> DataFrame:
    """Live promotions with pack economics and the feed's own undercut rule (any live offer, regular own price)."""
    from ..functions.price import comparable_offer, effective_pack_price, per_100g
    from ..functions.text import offer_key, pack_grams
    from ..sources.staging import stage
    df = live(t, *OFFER_COLUMNS, *LABEL_COLUMNS, *FEED)
    df = df.withColumns({"grams": pack_grams("pack_size"), "pack_price": effective_pack_price(), "offer_key": offer_key()})
    df = stage(df.withColumn("unit", per_100g("pack_price", "grams")).withColumn("_comparable", comparable_offer()), "feed")
    flagged = M.undercut_flags(df, own(t), decisions(t), F.col("own_unit"))
    return flagged.withColumn("undercuts", F.col("undercuts") & F.col("_comparable"))


@query("bi_feed", f"""+ kw AS (SELECT promotion_id, {_KW} FROM evidence e GROUP BY 1), ne AS (SELECT *, row_number() OVER (PARTITION BY promotion_id ORDER BY captured_at DESC, created_at DESC, evidence_id DESC) rn FROM evidence)
SELECT p.promotion_id, product_name, coalesce(brand,'Unbranded') AS brand, coalesce(competitor,'Unknown') AS competitor, category, pack_size, grams AS pack_grams, regular_price, promo_price, eff AS effective_pack_price, unit AS price_per_100g, discount_percentage, promotion_type,
 {_CODES} AS campaign_codes, retailer, coalesce(channel,'Offline') AS channel, geography_region, coalesce(geography,'') AS geography_raw, CAST(CAST(start_date AS DATE) AS VARCHAR) AS start_date, CAST(CAST(end_date AS DATE) AS VARCHAR) AS end_date,
 start_date IS NOT NULL OR end_date IS NOT NULL AS dates_stated, status, status='ACTIVE' AND (end_date IS NULL OR end_date>={AS_OF}) AS is_active, {r('rank_score', 1)} AS rank_score, {r('ai_confidence', 2)} AS ai_confidence, {r('source_reliability', 2)} AS source_reliability,
 has_open_conflict AS has_conflict, (promotion_type<>'MEMBER_PRICE' AND coalesce(minimum_purchase_amount,0)=0 AND (coalesce(minimum_purchase_quantity,0)=0 OR promotion_type='BUY_X_GET_Y') AND EXISTS (SELECT 1 FROM own o LEFT JOIN decisions d ON d.own_id=o.own_id AND d.offer_key=p.offer_key
  WHERE o.category=p.category AND o.own_unit IS NOT NULL AND p.grams/o.grams BETWEEN 0.5::DOUBLE AND 2.0::DOUBLE AND coalesce(d.accepted,true) AND p.unit<o.own_unit)) AS undercuts_our_product,
 first_seen_at, last_seen_at, last_verified_at, CASE WHEN ne.evidence_type='APPROVED_FIELD' THEN 'FIELD' ELSE 'WEB' END AS evidence_origin, ne.source_url, ne.evidence_text AS evidence_quote
FROM priced p LEFT JOIN kw ON kw.promotion_id=p.promotion_id LEFT JOIN ne ON ne.promotion_id=p.promotion_id AND ne.rn=1""", "priced evidence own decisions")
def bi_feed(t: Tables) -> DataFrame:
    return P.bi_feed(feed_rows(t), V.evidence(t), as_of=V.AS_OF).drop("campaign_labels")


@query("campaign_codes", f"""+ kw AS (SELECT promotion_id, {_KW} FROM evidence e GROUP BY 1), c AS (SELECT {_CODES} AS campaign_codes FROM live p LEFT JOIN kw ON kw.promotion_id=p.promotion_id)
SELECT campaign_codes, count(*) AS promotions FROM c GROUP BY 1""", "live evidence")
def campaign_codes(t: Tables) -> DataFrame:
    from ..functions.campaigns import campaign_codes as codes
    df = live(t, "product_name", "category", "promotion_type", "buy_quantity")
    quotes = V.evidence(t).join(df.select("promotion_id"), "promotion_id", "left_semi").select(
        "promotion_id", F.explode_outer(codes("evidence_text", F.lit(None).cast("string"))).alias("code"))
    own_codes = df.select("promotion_id", F.explode_outer(codes(F.concat_ws(" ", "product_name", "category"), "promotion_type", buy="buy_quantity")).alias("code"))
    each = own_codes.unionByName(quotes).groupBy("promotion_id").agg(F.collect_set("code").alias("found"))
    from ..functions.campaigns import CAMPAIGNS
    ordered = F.concat_ws(",", F.filter(F.array(*[F.lit(c) for c in CAMPAIGNS]), lambda c: F.array_contains("found", c)))
    return each.groupBy(ordered.alias("campaign_codes")).agg(F.count(F.lit(1)).alias("promotions"))


@query("ranked_export", """+ top AS (SELECT *, row_number() OVER (ORDER BY rank_score DESC, last_verified_at DESC, promotion_id) AS rank FROM live WHERE geography_region='NATIONAL'), ne AS (SELECT *, row_number() OVER (PARTITION BY promotion_id ORDER BY captured_at DESC, created_at DESC, evidence_id DESC) rn FROM evidence)
SELECT rank::INTEGER AS rank, t.promotion_id, product_name AS product, competitor, category, retailer AS outlet, coalesce(CASE t.channel WHEN 'Modern Trade' THEN 'Modern Trade' WHEN 'E-commerce' THEN 'E-commerce' END,
 CASE retailer_channel_type WHEN 'MINIMARKET' THEN 'Modern Trade' WHEN 'SUPERMARKET' THEN 'Modern Trade' WHEN 'ECOMMERCE' THEN 'E-commerce' WHEN 'WHOLESALE' THEN 'Wholesale' END,'N/A') AS channel, regular_price, discount_percentage AS discount,
 CASE WHEN start_date IS NOT NULL OR end_date IS NOT NULL THEN 'Yes' ELSE 'No' END AS dates_stated, rank_score AS score, ne.source_url, ne.evidence_text AS evidence FROM top t LEFT JOIN ne ON ne.promotion_id=t.promotion_id AND rn=1 WHERE rank<=500""", "live evidence")
def ranked_export(t: Tables) -> DataFrame:
    from ..operators.search import dashboard_filter
    df = live(t, "product_name", "competitor", "category", "retailer", "channel", "retailer_channel_type", "regular_price", "discount_percentage", "rank_score", "geography_region")
    best = R.top(dashboard_filter(df, region="national"), 500, F.col("rank_score").desc(), F.col("last_verified_at").desc(), F.col("promotion_id"))
    newest = R.newest_evidence(V.evidence(t), best).select("promotion_id", "source_url", F.col("evidence_text").alias("evidence"))
    stated = F.col("start_date").isNotNull() | F.col("end_date").isNotNull()
    return best.join(newest, "promotion_id", "left").select(
        "rank", "promotion_id", F.col("product_name").alias("product"), "competitor", "category", F.col("retailer").alias("outlet"),
        shown_channel("channel", "retailer_channel_type").alias("channel"), "regular_price", F.col("discount_percentage").alias("discount"),
        F.when(stated, "Yes").otherwise("No").alias("dates_stated"), F.col("rank_score").alias("score"), "source_url", "evidence")


@query("own_product_list", "SELECT own_id, sku, name, brand, category, pack_size, pack_grams, regular_price, promo_price, promo_type FROM own_products", "own_products")
def own_product_list(t: Tables) -> DataFrame:
    return V.own_products(t).select("own_id", "sku", "name", "brand", "category", "pack_size", "pack_grams", "regular_price", "promo_price",
                                    "promo_type").orderBy("category", "name", "own_id")


@query("change_history", f"""SELECT promotion_id, event_type, field_name, observed_at FROM change_events WHERE observed_at>={AS_OF}-INTERVAL 30 DAY AND event_type='DATES_CHANGED'""", "change_events")
def change_history(t: Tables) -> DataFrame:
    return R.change_history(V.change_events(t), as_of=V.AS_OF, window_days=30, event_type="DATES_CHANGED").select(
        "promotion_id", "event_type", "field_name", "observed_at")


@query("promotion_latest_changes", """+ w AS (SELECT * FROM change_events WHERE promotion_id IN (SELECT promotion_id FROM live)),
n AS (SELECT *, row_number() OVER (PARTITION BY promotion_id ORDER BY observed_at DESC, event_type, field_name NULLS FIRST) AS position FROM w)
SELECT promotion_id, position::INTEGER AS position, event_type, previous_value, new_value, observed_at FROM n WHERE position<=50""", "live change_events")
def promotion_latest_changes(t: Tables) -> DataFrame:
    return R.latest_changes(V.change_events(t), live(t)).select("promotion_id", "position", "event_type", "previous_value", "new_value", "observed_at")


@query("promotion_detail", """+ p AS (SELECT promotion_id, product_name, competitor FROM promotions), e AS (SELECT promotion_id, count(*) AS evidence_rows, max(captured_at) AS newest_evidence FROM evidence GROUP BY 1), c AS (SELECT promotion_id, count(*) AS changes FROM change_events GROUP BY 1)
SELECT p.promotion_id, product_name, competitor, coalesce(evidence_rows,0) AS evidence_rows, newest_evidence, coalesce(changes,0) AS changes FROM p LEFT JOIN e ON e.promotion_id=p.promotion_id LEFT JOIN c ON c.promotion_id=p.promotion_id""", "promotions evidence change_events")
def promotion_detail(t: Tables) -> DataFrame:
    return R.detail_index(V.promotions(t, "promotion_id", "product_name", "competitor"), V.evidence(t), V.change_events(t))
