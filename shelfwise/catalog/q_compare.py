"""Price comparison, breakdown and simulation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.core import round_half_up
from ..functions.price import effective_pack_price, per_100g, regular_pack_price
from ..functions.text import pack_grams
from ..operators import history as HIST, matching as M
from ..plans import comparison as C
from ..sources import views as V
from ..sources.staging import stage
from ..sources.tables import Tables
from .oracle import AS_OF, EFFECTIVE, r, xavg
from .q_live import live
from .registry import query

OFFER_COLUMNS = ["promotion_type", "currency", "minimum_purchase_amount", "minimum_purchase_quantity", "category", "pack_size",
                 "regular_price", "promo_price", "discount_percentage", "buy_quantity", "free_quantity", "product_name"]
LABEL_COLUMNS = ["competitor", "retailer", "retailer_channel_type"]


def offers(t: Tables, *columns: str) -> DataFrame:
    """Comparable live offers, staged once: a comparison reads them from several branches."""
    book = M.priced_offers(live(t, *OFFER_COLUMNS, *columns), as_of=V.AS_OF)
    slim = ["promotion_id", "category", "grams", "unit", "pack_price", "regular_pack", "regular_unit", "discount", "offer_key", "brand",
            "product_name", "pack_size", "promotion_type", "discount_percentage", "start_date", "end_date", "last_verified_at"]
    return stage(book.select(*slim, *columns), "offers")


def own(t: Tables) -> DataFrame:
    return stage(M.own_catalogue(V.own_products(t), as_of=V.AS_OF), "own")


def decisions(t: Tables) -> DataFrame:
    return stage(M.latest_decisions(V.decision_log(t)), "decisions")


@query("effective_price_unit", f"""SELECT promotion_id, {EFFECTIVE} AS pack_price, {r(f'({EFFECTIVE}/grams*100.0::DOUBLE)', 2)} AS unit,
 {r('(regular_price/grams*100.0::DOUBLE)', 2)} AS regular_unit FROM promo_base""", "promo_base")
def effective_price_unit(t: Tables) -> DataFrame:
    p = V.promotions(t, "promotion_id", "pack_size", "regular_price", "promo_price", "discount_percentage", "promotion_type", "buy_quantity", "free_quantity")
    p = p.withColumns({"grams": pack_grams("pack_size"), "pack_price": effective_pack_price(), "regular_pack": regular_pack_price()})
    return p.select("promotion_id", "pack_price", per_100g("pack_price", "grams").alias("unit"), per_100g("regular_pack", "grams").alias("regular_unit"))


@query("own_offer_matches", """SELECT own_id, count(*) AS matches, count(*) FILTER (gap<0) AS undercuts,
 CAST(CASE WHEN max(own_promo_unit) IS NOT NULL THEN count(*) FILTER (promo_gap<0) END AS DOUBLE) AS promo_undercuts, min(unit) AS cheapest_unit, min(gap) AS largest_gap_pct
FROM matches GROUP BY own_id""", "matches")
def own_offer_matches(t: Tables) -> DataFrame:
    m = C.compare_products(own(t), offers(t), decisions(t)).filter(F.col("matches") > 0)
    promo = F.when(F.col("own_promo_unit").isNotNull(), F.col("promo_undercuts")).cast("double")
    return m.select("own_id", "matches", "undercuts", promo.alias("promo_undercuts"), "cheapest_unit", "largest_gap_pct")


@query("own_offer_top5", """SELECT own_id, rn::INTEGER AS position, promotion_id, unit, gap AS gap_pct, promo_gap AS promo_gap_pct, reg_gap AS regular_gap_pct, gap<0 AS undercuts_us,
 CASE WHEN confirmed THEN 'Analyst confirmed' ELSE 'Category and pack size' END AS match_basis, disc AS discount FROM (
 SELECT *, row_number() OVER (PARTITION BY own_id ORDER BY unit, promotion_id) rn FROM matches) WHERE rn<=5""", "matches")
def own_offer_top5(t: Tables) -> DataFrame:
    return C.comparison_matches(own(t), offers(t), decisions(t), as_of=V.AS_OF).select(
        "own_id", "position", "promotion_id", "unit", "gap_pct", "promo_gap_pct", "regular_gap_pct", "undercuts_us", "match_basis", "discount")


@query("own_offer_matches_allowlist", """+ lists AS (SELECT DISTINCT p_brand AS brand, concat('BRAND#', (CAST(regexp_extract(p_brand,'([0-9]+)',1) AS INTEGER)+k)%25+1) AS allowed FROM part, (SELECT unnest([0,1,2]) AS k)
 WHERE p_brand<>'Brand#3')
SELECT m.own_id, count(*) AS matches, count(*) FILTER (gap<0) AS undercuts, min(unit) AS cheapest_unit FROM matches m JOIN own_products o ON o.own_id=m.own_id
WHERE o.brand='Brand#3' OR EXISTS (SELECT 1 FROM lists l WHERE l.brand=o.brand AND l.allowed=upper(coalesce(m.offer_brand, m.competitor))) GROUP BY 1""", "matches own_products")
def own_offer_matches_allowlist(t: Tables) -> DataFrame:
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    allowed = t.part.filter("p_brand <> 'Brand#3'").select(F.col("p_brand").alias("brand"), number.alias("n")).distinct().select(
        "brand", F.explode(F.array(*[F.concat(F.lit("Brand#"), (F.col("n") + k) % 25 + 1) for k in range(3)])).alias("allowed_brand"))
    book = M.scope_offers(offers(t, "competitor"), by_brand=True)
    catalogue = M.scope_own(own(t), brand_map=allowed)
    return M.match_summary(catalogue, book, decisions(t)).filter("matches > 0").select("own_id", "matches", "undercuts", "cheapest_unit")


@query("own_offer_matches_sku_list", """SELECT m.own_id, count(*) AS matches, min(unit) AS cheapest_unit FROM matches m JOIN promotions p ON p.promotion_id=m.promotion_id
WHERE m.own_id%3<>0 OR p.product_id IN (m.own_id, m.own_id+1, m.own_id+2) GROUP BY 1""", "matches promotions")
def own_offer_matches_sku_list(t: Tables) -> DataFrame:
    sku = lambda number: F.concat(F.lit("SKU-"), number)
    listed = t.part.filter("p_partkey % 3 = 0").select(F.concat(sku(F.col("p_partkey")), F.lit(" ")).alias("sku"), F.explode(F.array(*[sku(F.col("p_partkey") + k) for k in range(3)])).alias("allowed_sku"))
    book = offers(t, "product_id")
    book = M.scope_offers(book.withColumn("sku", sku(F.col("product_id"))), by_sku=True)
    return M.match_summary(M.scope_own(own(t), sku_map=listed), book, decisions(t)).filter("matches > 0").select("own_id", "matches", "cheapest_unit")


@query("brand_catalogue", """SELECT 'known' AS asked, own_id FROM own_products WHERE brand='Brand#3' UNION ALL SELECT 'unknown', own_id FROM own_products UNION ALL SELECT 'none', own_id FROM own_products""", "own_products")
def brand_catalogue(t: Tables) -> DataFrame:
    book = V.own_products(t)
    asked = {"known": "Brand#3", "unknown": "Brand#none", "none": None}
    parts = [M.brand_or_all(book, brand).select(F.lit(name).alias("asked"), "own_id") for name, brand in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("scoped_catalogue", f"""+ best AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY product_id ORDER BY recorded_at DESC, id) rn FROM scoped_prices s JOIN retailers r ON r.retailer_id=s.retailer_id
 WHERE lower(r.name)='retailer_3' AND region='MULTI_REGION' AND DATE '2001-01-01' BETWEEN starts AND ends) WHERE rn=1)
SELECT o.own_id, CASE WHEN b.id IS NOT NULL THEN b.regular_price ELSE o.regular_price END AS regular_price,
 CASE WHEN b.id IS NOT NULL THEN b.promo_price ELSE o.promo_price END AS promo_price, CASE WHEN b.id IS NULL THEN o.promo_type WHEN b.promo_price IS NOT NULL THEN 'DISCOUNT' ELSE 'REGULAR' END AS promo_type,
 b.id IS NOT NULL AS scoped FROM own_products o LEFT JOIN best b ON b.product_id=o.own_id""", "own_products scoped_prices retailers")
def scoped_catalogue(t: Tables) -> DataFrame:
    priced = M.apply_scoped_prices(V.own_products(t), V.scoped_prices(t), V.retailers(t), retailer="Retailer_3", region="MULTI_REGION",
                                   local_day="2001-01-01")
    return priced.select("own_id", "regular_price", "promo_price", "promo_type", "scoped")


_SUMMARY = f"""pp AS (SELECT *, coalesce(own_promo_unit,own_unit)/mean*100.0::DOUBLE AS idx FROM (SELECT o.own_id, o.own_unit, o.own_promo_unit, o.has_promo, count(m.promotion_id) AS matches, count(*) FILTER (gap<0) AS undercuts,
 count(*) FILTER (promo_gap<0) AS pu, min(gap) AS largest_gap_pct, min(promo_gap) AS pg, {xavg('m.unit')} AS mean
 FROM own o LEFT JOIN matches m ON m.own_id=o.own_id GROUP BY 1,2,3,4))"""


@query("comparison_products", f"""+ {_SUMMARY} SELECT own_id, matches, undercuts, CAST(CASE WHEN has_promo THEN pu END AS DOUBLE) AS promo_undercuts, largest_gap_pct, CASE WHEN has_promo THEN pg END AS largest_promo_gap_pct,
 {r('idx', 4)} AS price_index, CASE WHEN own_unit IS NULL THEN '{C.NO_PACK_NOTE}' WHEN matches=0 THEN '{C.NO_OFFER_NOTE}' END AS note FROM pp""", "own matches")
def comparison_products(t: Tables) -> DataFrame:
    return C.compare_products(own(t), offers(t), decisions(t)).select(
        "own_id", "matches", "undercuts", F.col("promo_undercuts").cast("double").alias("promo_undercuts"), "largest_gap_pct", "largest_promo_gap_pct",
        round_half_up(F.col("price_index"), 4).alias("price_index"), "note")


@query("comparison_pressure_search", f"""SELECT own_id, count(*) AS matches, count(*) FILTER (gap<0) AS undercuts FROM matches
 WHERE contains(lower(name),'bolt') OR contains(lower(sku),'bolt') OR contains(lower(product_name),'bolt') OR contains(lower(coalesce(competitor,'')),'bolt')
 GROUP BY 1 HAVING count(*) FILTER (gap<0)>0""", "matches")
def comparison_pressure_search(t: Tables) -> DataFrame:
    return C.compare_products(own(t), offers(t, "competitor"), decisions(t), pressure="UNDER_PRESSURE", search="Bolt").select("own_id", "matches", "undercuts")


@query("comparison_filtered", """SELECT own_id, count(*) AS matches, min(unit) AS cheapest_unit FROM matches m JOIN (SELECT promotion_id AS pid, geography_region, retailer_channel_type FROM promotions) p
 ON p.pid=m.promotion_id WHERE geography_region='NATIONAL' AND category='WAFER' AND contains(lower(coalesce(competitor,'')),'nation_1') AND retailer_channel_type='MINIMARKET' GROUP BY 1""", "matches promotions")
def comparison_filtered(t: Tables) -> DataFrame:
    picked = C.filter_offers(live(t, *OFFER_COLUMNS, *LABEL_COLUMNS, "geography_region"), category="wafer", competitor="NATION_1",
                             channel="minimarket", region="national")
    m = C.compare_products(own(t), M.priced_offers(picked, as_of=V.AS_OF), decisions(t)).filter("matches > 0")
    return m.select("own_id", "matches", "cheapest_unit")


@query("comparison_summary", f"""+ {_SUMMARY}, a AS (SELECT count(*) AS own_products, count(*) FILTER (matches>0) AS comparable_products, count(*) FILTER (matches>0 AND undercuts>0) AS under_pressure,
 {r('avg(idx)', 1)} AS price_index_vs_market FROM pp), b AS (SELECT count(*) AS active_competitor_promotions, count(DISTINCT coalesce(brand,competitor,'Unknown')) AS brands_tracked,
 count(*) FILTER (end_date<={AS_OF}+INTERVAL 7 DAY) AS expiring_soon FROM offers)
SELECT a.*, b.*, own_products-comparable_products AS not_comparable, {r('(under_pressure/comparable_products::DOUBLE*100.0::DOUBLE)', 1)} AS pct_under_pressure,
 {r('(active_competitor_promotions/brands_tracked::DOUBLE)', 1)} AS avg_promos_per_brand, {r('(price_index_vs_market-100.0::DOUBLE)', 1)} AS price_index_gap_pct FROM a, b""", "own matches offers")
def comparison_summary(t: Tables) -> DataFrame:
    book = offers(t, "competitor")
    return C.summary(C.compare_products(own(t), book, decisions(t)), book, as_of=V.AS_OF)


@query("price_index", f"""+ {_SUMMARY} SELECT {r('avg(idx)', 1)} AS price_index_vs_market, {r(f"({r('avg(idx)', 1)}-100.0::DOUBLE)", 1)} AS price_index_gap_pct FROM pp""", "own matches")
def price_index(t: Tables) -> DataFrame:
    return C.price_index(C.compare_products(own(t), offers(t), decisions(t)))


@query("deepest_discounts", """+ d AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY disc DESC, promotion_id) rn FROM offers WHERE disc>0)
SELECT category, disc AS discount, product_name, coalesce(competitor, brand) AS competitor, retailer, promotion_id, row_number() OVER (ORDER BY disc DESC, promotion_id)=1 AS is_overall FROM d WHERE rn=1""", "offers")
def deepest_discounts(t: Tables) -> DataFrame:
    return C.deepest_discounts(offers(t, *LABEL_COLUMNS))


@query("comparison_export", """+ top AS (SELECT *, row_number() OVER (PARTITION BY own_id ORDER BY unit, promotion_id) rn FROM matches)
SELECT o.own_id, coalesce(rn,0)::INTEGER AS position, o.category, o.name, o.sku, coalesce(o.pack_size,'') AS pack_size, o.regular_price, CASE WHEN o.has_promo THEN o.promo_type ELSE 'REGULAR' END AS promo_type,
 CASE WHEN promotion_id IS NULL THEN 'None' ELSE coalesce(competitor,'') END AS competitor, coalesce(product_name,'No active competitor promotions') AS offer, eff AS pack_price, unit,
 CASE WHEN promotion_id IS NULL THEN '' ELSE printf('%.1f%%', gap) END AS gap,
 CASE WHEN promotion_id IS NULL THEN 'No Competitor Moves' WHEN gap<0 THEN printf('Undercut (%.1f%%)', gap) WHEN gap>0 THEN printf('Competitive (+%.1f%%)', gap) ELSE 'Parity' END AS status,
 CASE WHEN promotion_id IS NULL THEN '' ELSE coalesce(CAST(CAST(end_date AS DATE) AS VARCHAR),'Ongoing') END AS valid_until
FROM own o LEFT JOIN top t ON t.own_id=o.own_id AND rn<=5""", "own matches")
def comparison_export(t: Tables) -> DataFrame:
    catalogue, book, verdicts = own(t), offers(t, *LABEL_COLUMNS), decisions(t)
    return C.export_rows(catalogue, C.comparison_matches(catalogue, book, verdicts, as_of=V.AS_OF))


_FLAGS = """flagged AS (SELECT f.*, coalesce(f.brand,f.competitor,'Unknown') AS b, coalesce(f.competitor,f.brand,'Unknown') AS c, EXISTS (SELECT 1 FROM own o LEFT JOIN decisions d ON d.own_id=o.own_id AND d.offer_key=f.offer_key
 WHERE o.category=f.category AND o.own_unit IS NOT NULL AND f.grams/o.grams>=0.5::DOUBLE AND f.grams/o.grams<=2.0::DOUBLE AND coalesce(d.accepted,true) AND f.unit<coalesce(o.own_promo_unit,o.own_unit)) AS undercuts FROM offers f)"""
_AVG_UNIT, _AVG_DISC = r(xavg("unit"), 2), r(xavg("discount_percentage", 4), 1)
_MEASURES = f"count(*) AS offers, count(*) FILTER (undercuts) AS undercut_offers, {_AVG_UNIT} AS avg_unit, min(unit) AS min_unit, max(unit) AS max_unit, {_AVG_DISC} AS avg_discount"


def flagged(t: Tables) -> DataFrame:
    target = F.coalesce(F.col("own_promo_unit"), F.col("own_unit"))
    return C.labelled(M.undercut_flags(offers(t, *LABEL_COLUMNS), own(t), decisions(t), target))


@query("breakdown_brand", f"+ {_FLAGS} SELECT b AS brand, {_MEASURES}, string_agg(DISTINCT promotion_type, ',' ORDER BY promotion_type) AS mechanics FROM flagged GROUP BY 1", "own offers decisions")
def breakdown_brand(t: Tables) -> DataFrame:
    return C.by_brand(flagged(t))


@query("breakdown_category", f"""+ {_FLAGS} SELECT category, count(*) AS offers, count(*) FILTER (undercuts) AS undercut_offers, {_AVG_UNIT} AS avg_unit, min(unit) AS min_unit, max(unit) AS max_unit,
 count(DISTINCT b) AS brands, count(DISTINCT retailer) AS retailers FROM flagged GROUP BY 1""", "own offers decisions")
def breakdown_category(t: Tables) -> DataFrame:
    return C.by_category(flagged(t))


@query("breakdown_retailer", f"""+ {_FLAGS} SELECT a.*, top_mechanic FROM (SELECT retailer, retailer_channel_type AS channel_type, count(*) AS offers, count(*) FILTER (undercuts) AS undercut_offers, {_AVG_UNIT} AS avg_unit, min(unit) AS min_unit,
 {_AVG_DISC} AS avg_discount FROM flagged GROUP BY 1,2) a JOIN (SELECT retailer, promotion_type AS top_mechanic, row_number() OVER (PARTITION BY retailer ORDER BY count(*) DESC, promotion_type) rn FROM flagged GROUP BY 1,2) m
 ON m.retailer=a.retailer AND rn=1""", "own offers decisions")
def breakdown_retailer(t: Tables) -> DataFrame:
    return C.by_retailer(flagged(t))


@query("breakdown_mechanic", f"+ {_FLAGS} SELECT promotion_type AS mechanic, count(*) AS offers, count(*) FILTER (undercuts) AS undercut_offers, {_AVG_UNIT} AS avg_unit, {_AVG_DISC} AS avg_discount FROM flagged GROUP BY 1", "own offers decisions")
def breakdown_mechanic(t: Tables) -> DataFrame:
    return C.by_mechanic(flagged(t))


@query("breakdown_competitor", "SELECT coalesce(competitor,brand,'Unknown') AS competitor, count(*) AS offers, count(DISTINCT brand) AS brands FROM offers GROUP BY 1", "offers")
def breakdown_competitor(t: Tables) -> DataFrame:
    book = M.priced_offers(live(t, *OFFER_COLUMNS, *LABEL_COLUMNS), as_of=V.AS_OF).withColumn("undercuts", F.lit(False))
    return C.by_competitor(C.labelled(book))


@query("breakdown_grouping_sets", f"""+ {_FLAGS} SELECT 'brand' AS dimension, b AS label, {_MEASURES} FROM flagged GROUP BY 2 UNION ALL SELECT 'category', category, {_MEASURES} FROM flagged GROUP BY 2
 UNION ALL SELECT 'retailer', retailer, {_MEASURES} FROM flagged GROUP BY 2 UNION ALL SELECT 'mechanic', promotion_type, {_MEASURES} FROM flagged GROUP BY 2 UNION ALL SELECT 'competitor', c, {_MEASURES} FROM flagged GROUP BY 2""", "own offers decisions")
def breakdown_grouping_sets(t: Tables) -> DataFrame:
    return C.all_breakdowns(flagged(t))


def scenarios(t: Tables) -> DataFrame:
    """One what-if per catalogue product: a fixed price, a discount, or a 2+1 bundle."""
    kind = F.col("p_size") % 3
    none = F.lit(None)
    return t.part.select(
        F.col("p_partkey").alias("scenario_id"), F.col("p_partkey").alias("own_id"), none.cast("string").alias("category"),
        none.cast("double").alias("grams"), none.cast("double").alias("regular_price"),
        F.when(kind == 0, round_half_up(F.col("p_retailprice") * 4.0, 2)).alias("candidate_price"),
        F.when(kind == 1, F.lit(12.5)).alias("candidate_discount"),
        F.when(kind == 2, "BUY_X_GET_Y").otherwise("DISCOUNT").alias("mechanic"),
        F.when(kind == 2, 2).alias("buy_quantity"), F.when(kind == 2, 1).alias("free_quantity"))


_CAND = f"""CASE WHEN p_size%3=0 THEN {r('(p_retailprice*4.0::DOUBLE)', 2)} WHEN p_size%3=1 THEN {r('(regular_price*(1.0::DOUBLE-12.5::DOUBLE/100.0::DOUBLE))', 2)}
 ELSE {r('(regular_price*2.0::DOUBLE/3.0::DOUBLE)', 2)} END"""
_SCEN = f"""sc AS (SELECT o.*, {r('(cand_pack/grams*100.0::DOUBLE)', 2)} AS cand, coalesce(own_promo_unit, own_unit) AS base FROM (SELECT o.*, {_CAND} AS cand_pack FROM own o JOIN part ON p_partkey=own_id) o WHERE grams IS NOT NULL),
sm AS (SELECT s.own_id, s.cand, s.base, s.grams AS sg, f.unit, f.promotion_id FROM sc s JOIN offers f ON f.category=s.category AND f.grams/s.grams>=0.5::DOUBLE AND f.grams/s.grams<=2.0::DOUBLE
 LEFT JOIN decisions d ON d.own_id=s.own_id AND d.offer_key=f.offer_key WHERE coalesce(d.accepted,true))"""


@query("simulate_scenarios", f"""+ {_SCEN}, n AS (SELECT s.own_id, s.cand, s.base, s.grams, count(unit) AS n, count(*) FILTER (unit<s.cand) AS uc, count(*) FILTER (unit<s.base) AS ub, count(*) FILTER (unit>s.cand) AS ch,
 count(*) FILTER (unit<s.base AND NOT unit<s.cand) AS el, min(unit) AS mn FROM sc s LEFT JOIN sm ON sm.own_id=s.own_id GROUP BY ALL)
SELECT own_id AS scenario_id, cand AS candidate_unit, base AS baseline_unit, n AS comparable, uc+1 AS projected_rank, ub+1 AS current_rank, ub-uc AS rank_change, uc-ub AS undercut_change, ch AS cheaper_than,
 CASE WHEN n=0 THEN 'NO_COMPETITORS' WHEN uc=0 THEN 'CHEAPEST_IN_MARKET' WHEN uc+1<=greatest(1,n*0.25) THEN 'TOP_QUARTILE_COMPETITIVE' WHEN uc+1<=greatest(1,n*0.5) THEN 'MID_MARKET' ELSE 'PREMIUM_TIER' END AS market_position,
 el AS eliminated, uc AS remaining, mn AS target_unit, {r('(mn*grams/100.0::DOUBLE)', 2)} AS target_pack_price FROM n""", "own offers decisions")
def simulate_scenarios(t: Tables) -> DataFrame:
    ready, _ = C.prepare_scenarios(scenarios(t), own(t))
    return C.simulate(ready, offers(t), decisions(t))


@query("simulate_eliminated", f"""+ {_SCEN} SELECT own_id AS scenario_id, rn::INTEGER AS position, promotion_id, unit, {r('((unit-cand)/cand*100.0::DOUBLE)', 1)} AS gap_vs_candidate, {r('((unit-base)/base*100.0::DOUBLE)', 1)} AS gap_vs_baseline,
 unit<cand AS remains, unit<base AND NOT unit<cand AS eliminated FROM (SELECT *, row_number() OVER (PARTITION BY own_id ORDER BY unit, promotion_id) rn FROM sm) WHERE rn<=10""", "own offers decisions")
def simulate_eliminated(t: Tables) -> DataFrame:
    ready, _ = C.prepare_scenarios(scenarios(t), own(t))
    return C.simulation_matches(ready, offers(t), decisions(t))


@query("simulate_rejected", f"SELECT own_id AS scenario_id, 'Pack size in grams is required for comparison.' AS reason FROM own WHERE grams IS NULL", "own")
def simulate_rejected(t: Tables) -> DataFrame:
    _, rejected = C.prepare_scenarios(scenarios(t), own(t))
    return rejected


@query("decision_upsert", "SELECT own_id, offer_key, accepted FROM decisions", "decisions")
def decision_upsert(t: Tables) -> DataFrame:
    return decisions(t)


@query("decision_reset", "SELECT own_id, offer_key, accepted FROM decisions d WHERE NOT EXISTS (SELECT 1 FROM own_products o WHERE o.own_id=d.own_id AND category='WAFER')", "decisions own_products")
def decision_reset(t: Tables) -> DataFrame:
    return M.reset_decisions(decisions(t), V.own_products(t).filter("category = 'WAFER'"))


@query("own_price_history", """+ log AS (SELECT own_id, TIMESTAMP '1990-01-01' AS recorded_at, 0 AS id, 'BASELINE' AS operation, CAST(regular_price AS DOUBLE) AS regular_price, CAST(promo_price AS DOUBLE) AS promo_price FROM own_products
 UNION ALL SELECT product_id, recorded_at, id, 'UPDATE', CAST(regular_price AS DOUBLE), CAST(promo_price AS DOUBLE) FROM scoped_prices
 UNION ALL SELECT own_id, TIMESTAMP '2030-01-01', 0, 'DELETE', CAST(regular_price AS DOUBLE), CAST(promo_price AS DOUBLE) FROM own_products WHERE category='SNACK'),
c AS (SELECT *, lag(operation) OVER w AS po, lag(regular_price) OVER w AS pr, lag(promo_price) OVER w AS pp FROM log WINDOW w AS (PARTITION BY own_id ORDER BY recorded_at, id)),
k AS (SELECT * FROM c WHERE po IS NULL OR (operation='DELETE')<>(po='DELETE') OR regular_price IS DISTINCT FROM pr OR promo_price IS DISTINCT FROM pp)
SELECT own_id, row_number() OVER w AS revision, operation, regular_price, promo_price, recorded_at AS known_from, lead(recorded_at) OVER w AS known_until FROM k WINDOW w AS (PARTITION BY own_id ORDER BY recorded_at, id)""", "own_products scoped_prices")
def own_price_history(t: Tables) -> DataFrame:
    own = V.own_products(t)
    log = HIST.own_price_log(own, V.scoped_prices(t).withColumnRenamed("product_id", "own_id"), own.filter("category = 'SNACK'"), baseline_at="1990-01-01 00:00:00", deleted_at="2030-01-01 00:00:00")
    return HIST.own_price_history(log)


@query("scoped_price_history", """+ n AS (SELECT s.*, r.name AS retailer FROM scoped_prices s JOIN retailers r ON r.retailer_id=s.retailer_id),
p AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY recorded_at DESC, id DESC) AS newest FROM n)
SELECT product_id, id, retailer, region, row_number() OVER w AS revision, CAST(starts AS VARCHAR) AS starts, CAST(ends AS VARCHAR) AS ends, CAST(regular_price AS DOUBLE) AS regular_price, CAST(promo_price AS DOUBLE) AS promo_price,
 recorded_at AS known_from, lead(recorded_at) OVER w AS known_until, newest, newest<=100 AS on_first_page FROM p WINDOW w AS (PARTITION BY product_id, retailer_id, region ORDER BY recorded_at, id)""", "scoped_prices retailers")
def scoped_price_history(t: Tables) -> DataFrame:
    return HIST.scoped_price_history(V.scoped_prices(t), V.retailers(t)).withColumns({"starts": F.col("starts").cast("string"), "ends": F.col("ends").cast("string")})
