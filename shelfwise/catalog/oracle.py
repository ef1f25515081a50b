"""DuckDB SQL twins of the domain views, used only to check results."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2001-01-01 00:00:00'"


def r(expr: str, digits: int) -> str:
    k = f"{10**digits}.0::DOUBLE"
    return f"(floor({expr}*{k}+0.5000001::DOUBLE)/{k})"


def xsum(expr: str, digits: int = 2, where: str = "") -> str:
    k = f"{10**digits}.0::DOUBLE"
    return f"(CAST(sum(CAST(floor(({expr})*{k}+0.5000001::DOUBLE) AS BIGINT)){where} AS DOUBLE)/{k})"


def xavg(expr: str, digits: int = 2, where: str = "") -> str:
    return f"({xsum(expr, digits, where)}/nullif(count({expr}){where},0))"


PID = ("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER), "
       "CAST(floor(l_extendedprice*100+0.5) AS BIGINT))")
CATEGORY = ("CASE p_type WHEN 'STANDARD' THEN 'BISCUIT' WHEN 'PROMO' THEN 'CRACKER' WHEN 'LARGE' THEN 'COOKIE' "
            "WHEN 'SMALL' THEN 'WAFER' WHEN 'MEDIUM' THEN 'SNACK' ELSE 'OTHER' END")
PACK = ("CASE WHEN p_size%3=0 THEN concat(p_size,' x 10 g') WHEN p_size%3=1 THEN concat(p_size*10,'g') "
        "ELSE concat('0,', lpad(CAST(p_size AS VARCHAR),2,'0'), ' kg') END")
_REG = r("(l_extendedprice/l_quantity)", 2)


def offer_key(comp: str, name: str, pack: str, cat: str) -> str:
    return (f"concat_ws(chr(31), coalesce(CAST({comp} AS VARCHAR),''), lower(trim(coalesce({name},''))), "
            f"lower(trim(coalesce({pack},''))), upper(coalesce({cat},'')))")


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}
VIEWS["competitors"] = ((), "SELECT n_nationkey AS competitor_id, n_name AS name, n_nationkey/25.0::DOUBLE AS importance_score, n_nationkey<>13 AS is_active FROM nation")
VIEWS["retailers"] = ((), """SELECT n_nationkey AS retailer_id, concat('RETAILER_',n_nationkey) AS name,
 CASE n_nationkey%6 WHEN 0 THEN 'MINIMARKET' WHEN 1 THEN 'SUPERMARKET' WHEN 2 THEN 'ECOMMERCE' WHEN 3 THEN 'WHOLESALE' WHEN 4 THEN 'WARUNG' END AS channel_type FROM nation""")
VIEWS["promo_base"] = (("competitors", "retailers"), f"""
SELECT {PID} AS promotion_id, l_partkey AS product_id, l_suppkey AS source_id, {_REG} AS regular_price,
 CASE WHEN l_linenumber=2 THEN {r(f"({_REG}*(1.0::DOUBLE-l_discount*5.0::DOUBLE))", 2)} END AS promo_price,
 CASE WHEN NOT (l_linenumber=2 AND l_tax>=0.06::DOUBLE) THEN {r("(l_discount*500.0::DOUBLE)", 1)} END AS discount_percentage,
 CASE WHEN l_returnflag='R' THEN 'BUY_X_GET_Y' WHEN l_returnflag='A' AND l_linestatus='O' THEN 'MEMBER_PRICE' ELSE 'DISCOUNT' END AS promotion_type,
 CASE WHEN l_returnflag='R' THEN 2 END AS buy_quantity, CASE WHEN l_returnflag='R' THEN 1 END AS free_quantity,
 CASE WHEN l_linenumber=3 THEN 'E-commerce' WHEN l_linenumber=4 THEN 'Modern Trade' END AS channel, 'IDR' AS currency,
 CASE WHEN l_linenumber=5 AND l_tax=0.01::DOUBLE THEN 50000.0::DOUBLE END AS minimum_purchase_amount,
 CASE WHEN l_linenumber=6 THEN 3 END AS minimum_purchase_quantity,
 l_tax>=0.08::DOUBLE AS has_open_conflict, 0.7::DOUBLE+l_tax*3.0::DOUBLE AS source_reliability,
 0.6::DOUBLE+l_discount*4.0::DOUBLE AS ai_confidence, ((l_orderkey*31+l_linenumber*7+l_partkey)%1000)/1000.0::DOUBLE AS rank_score,
 l_shipdate AS last_verified_at, l_shipdate AS last_seen_at, o_orderdate AS first_seen_at,
 CASE WHEN l_linenumber NOT IN (3,6) THEN o_orderdate END AS start_date,
 CASE WHEN l_linenumber NOT IN (3,5,6) THEN o_orderdate + to_days(CAST(30+l_quantity*10 AS INTEGER)) END AS end_date,
 p_name AS product_name, CASE WHEN NOT (l_linenumber=7 AND l_returnflag='N') THEN p_brand END AS brand,
 {CATEGORY} AS category, {PACK} AS pack_size, p_size*10.0::DOUBLE AS grams,
 CASE WHEN l_linenumber<>7 THEN s_nationkey END AS competitor_id, c_nationkey AS retailer_id,
 CASE WHEN c_mktsegment='MACHINERY' THEN 'Sumatera, Bali' WHEN c_mktsegment='HOUSEHOLD' AND r_name='AFRICA' THEN 'Semua kecuali Papua'
  WHEN r_name='AFRICA' THEN 'Jawa Barat' WHEN r_name='AMERICA' THEN 'Seluruh Indonesia' WHEN r_name='ASIA' THEN 'Jakarta dan Bandung'
  WHEN r_name='MIDDLE EAST' THEN 'Toko tertentu' END AS geography,
 CASE WHEN c_mktsegment='MACHINERY' THEN 'MULTI_REGION' WHEN c_mktsegment='HOUSEHOLD' AND r_name='AFRICA' THEN 'UNMAPPED'
  WHEN r_name='AFRICA' THEN 'JAWA' WHEN r_name='AMERICA' THEN 'NATIONAL' WHEN r_name='ASIA' THEN 'JABODETABEK'
  WHEN r_name='MIDDLE EAST' THEN 'STORE_SPECIFIC' ELSE 'UNKNOWN' END AS geography_region
FROM lineitem LEFT JOIN orders ON l_orderkey=o_orderkey LEFT JOIN part ON l_partkey=p_partkey LEFT JOIN supplier ON l_suppkey=s_suppkey
LEFT JOIN customer ON o_custkey=c_custkey LEFT JOIN nation cn ON c_nationkey=cn.n_nationkey LEFT JOIN region ON cn.n_regionkey=r_regionkey""")
VIEWS["promotions"] = (("promo_base",), f"""
SELECT b.*, c.name AS competitor, c.importance_score AS importance, rt.name AS retailer, rt.channel_type AS retailer_channel_type,
 CASE WHEN start_date IS NULL AND end_date IS NULL THEN 'UNKNOWN' WHEN {AS_OF}<start_date THEN 'UPCOMING'
  WHEN {AS_OF}>end_date THEN 'EXPIRED' ELSE 'ACTIVE' END AS status
FROM promo_base b LEFT JOIN competitors c ON b.competitor_id=c.competitor_id LEFT JOIN retailers rt ON b.retailer_id=rt.retailer_id""")
VIEWS["evidence"] = ((), f"""
SELECT {PID} AS promotion_id, concat_ws('/', {PID}, k) AS evidence_id, l_orderkey AS document_id,
 CASE WHEN l_tax=0.05::DOUBLE THEN 'APPROVED_FIELD' ELSE 'TEXT' END AS evidence_type,
 CASE WHEN l_tax=0.03::DOUBLE THEN '   ' WHEN l_returnflag='R' THEN 'Promo beli 2 gratis 1' WHEN l_returnflag='A' THEN 'Harga member gopay'
  ELSE 'Diskon akhir pekan' END AS evidence_text, concat('https://shop.example/', l_suppkey, '/', k) AS source_url,
 l_shipdate + to_days(k) AS captured_at, l_shipdate + to_days(k) AS created_at
FROM lineitem JOIN (SELECT unnest([0,1]) AS k) ks ON (k=0 OR l_linenumber IN (2,4)) WHERE l_tax>0""")
VIEWS["crawl_documents"] = ((), """SELECT o_orderkey AS document_id, CASE WHEN o_orderpriority<>'5-LOW' THEN o_custkey END AS document_source_id,
 o_orderdate AS retrieved_at FROM orders""")
VIEWS["sources"] = ((), f"""
SELECT s_suppkey AS source_id, s_name AS name, concat('shop', s_suppkey, '.example') AS domain,
 CASE WHEN s_acctbal<0 THEN 'CANDIDATE' WHEN s_nationkey=24 THEN 'REJECTED' ELSE 'APPROVED' END AS approval_status,
 s_nationkey<>23 AS is_active, CASE WHEN s_nationkey<>22 THEN 'retailer' END AS adapter_key,
 0.6::DOUBLE+(s_nationkey%8)*0.05::DOUBLE AS reliability_score, (s_nationkey%48+1)*60 AS crawl_frequency_minutes, s_nationkey%5 AS priority,
 CASE WHEN s_nationkey<>21 THEN {AS_OF}-to_days(CAST(s_suppkey%5 AS INTEGER)) END AS last_crawled_at,
 CASE WHEN s_nationkey<>20 THEN {AS_OF}-to_days(CAST(s_suppkey%6 AS INTEGER)) END AS last_success_at,
 CASE WHEN s_suppkey%4=0 THEN {AS_OF}-to_days(CAST(s_suppkey%3 AS INTEGER)) END AS last_error_at,
 CASE WHEN s_suppkey%7<>0 THEN {AS_OF}-to_days(CAST(s_suppkey%6 AS INTEGER)) END AS last_processed_at FROM supplier""")
VIEWS["brands"] = ((), "SELECT DISTINCT CAST(regexp_extract(p_brand,'([0-9]+)',1) AS INTEGER) AS brand_id, p_brand AS name, CAST(regexp_extract(p_brand,'([0-9]+)',1) AS INTEGER)%25 AS competitor_id FROM part")
VIEWS["own_products"] = ((), f"""
SELECT p_partkey AS own_id, concat('SKU-',p_partkey) AS sku, p_name AS name, p_brand AS brand, {CATEGORY} AS category,
 CASE WHEN p_size<>50 THEN {PACK} END AS pack_size, CASE WHEN p_size<>50 AND p_size%5<>0 THEN p_size*10.0::DOUBLE END AS pack_grams,
 CASE WHEN p_size<>50 THEN p_size*10.0::DOUBLE END AS grams,
 {r("(p_retailprice*5.0::DOUBLE)", 2)} AS regular_price,
 CASE WHEN p_size%7<>0 AND p_size%4=0 THEN {r("(p_retailprice*4.25::DOUBLE)", 2)} END AS promo_price,
 CASE WHEN p_size%7=0 THEN 'BUY_X_GET_Y' WHEN p_size%4=0 THEN 'DISCOUNT' ELSE 'REGULAR' END AS promo_type,
 CASE WHEN p_size%7=0 THEN 3 END AS buy_quantity, CASE WHEN p_size%7=0 THEN 1 END AS free_quantity,
 CASE WHEN p_size%8=0 THEN TIMESTAMP '2001-02-01 00:00:00' END AS promo_start_date FROM part""")
_OWN_PACK = ("(CASE WHEN promo_price IS NOT NULL THEN promo_price WHEN promo_type='BUY_X_GET_Y' THEN regular_price*3.0::DOUBLE/4.0::DOUBLE END)")
VIEWS["own"] = (("own_products",), f"""
SELECT *, CASE WHEN has_promo THEN {r("(own_promo_pack/grams*100.0::DOUBLE)", 2)} END AS own_promo_unit FROM (
 SELECT *, {r("(regular_price/grams*100.0::DOUBLE)", 2)} AS own_unit,
  (promo_price IS NOT NULL OR promo_type='BUY_X_GET_Y') AND coalesce(promo_start_date<={AS_OF}, true) AS has_promo,
  {r(_OWN_PACK, 2)} AS own_promo_pack FROM own_products)""")
VIEWS["change_events"] = ((), f"""
SELECT {PID} AS promotion_id, CASE WHEN l_linenumber=1 THEN 'CREATED' WHEN l_linenumber IN (2,3) THEN 'PRICE_OR_VALUE_CHANGED'
  WHEN l_linenumber=4 THEN 'MECHANIC_CHANGED' WHEN l_linenumber=5 THEN 'DATES_CHANGED' ELSE 'TERMS_CHANGED' END AS event_type,
 CASE WHEN l_linenumber=1 THEN NULL WHEN l_linenumber IN (2,3) THEN 'promo_price' WHEN l_linenumber=4 THEN 'promotion_type'
  WHEN l_linenumber=5 THEN 'end_date' ELSE 'channel' END AS field_name,
 CAST(l_linenumber AS VARCHAR) AS previous_value, CAST(l_linenumber+1 AS VARCHAR) AS new_value,
 {r("(l_discount*4.0::DOUBLE)", 4)} AS change_impact, l_shipdate+to_days(l_linenumber%3) AS observed_at FROM lineitem WHERE l_discount>0""")
VIEWS["scoped_prices"] = (("promo_base",), f"""
SELECT promotion_id AS id, product_id, retailer_id, geography_region AS region, CAST(first_seen_at AS DATE) AS starts,
 CAST(first_seen_at AS DATE)+90 AS ends, regular_price, CASE WHEN promotion_type='DISCOUNT' THEN {r("(regular_price*0.9::DOUBLE)", 2)} END AS promo_price,
 first_seen_at AS recorded_at FROM promo_base""")
VIEWS["decision_log"] = ((), f"""
SELECT p_partkey AS own_id, {offer_key('s_nationkey', 'p_name', PACK, CATEGORY)} AS offer_key, l_discount>=0.05::DOUBLE AS accepted,
 l_shipdate AS reviewed_at, {PID} AS log_id FROM lineitem LEFT JOIN part ON l_partkey=p_partkey LEFT JOIN supplier ON l_suppkey=s_suppkey
WHERE l_tax<=0.01::DOUBLE AND l_linenumber<>7""")
VIEWS["decisions"] = (("decision_log",), """SELECT own_id, offer_key, accepted FROM (SELECT *, row_number() OVER (PARTITION BY own_id, offer_key
 ORDER BY reviewed_at DESC, log_id DESC) rn FROM decision_log) WHERE rn=1""")
VIEWS["gates"] = (("promotions", "evidence", "sources"), f"""
SELECT p.*, coalesce((status='ACTIVE' AND (start_date IS NULL OR start_date<={AS_OF}) AND (end_date IS NULL OR end_date>={AS_OF}))
   OR (status='UNKNOWN' AND start_date IS NULL AND end_date IS NULL), false) AS g_active,
 coalesce(last_verified_at>={AS_OF}-INTERVAL 90 DAY, false) AS g_verified,
 EXISTS (SELECT 1 FROM evidence e WHERE e.promotion_id=p.promotion_id AND length(trim(e.evidence_text))>0) AS g_evidence,
 EXISTS (SELECT 1 FROM evidence e WHERE e.promotion_id=p.promotion_id AND e.evidence_type='APPROVED_FIELD')
  OR EXISTS (SELECT 1 FROM sources s WHERE s.source_id=p.source_id AND s.is_active AND s.approval_status='APPROVED') AS g_source,
 NOT has_open_conflict AS g_conflict, (competitor_id IS NOT NULL OR brand IS NOT NULL) AS g_identity FROM promotions p""")
VIEWS["live"] = (("gates",), "SELECT * FROM gates WHERE g_active AND g_verified AND g_evidence AND g_source AND g_conflict AND g_identity")
_BASE_PRICE = "coalesce(promo_price, CASE WHEN discount_percentage>0 THEN regular_price*(1.0::DOUBLE-discount_percentage/100.0::DOUBLE) END, CASE WHEN promotion_type='BUY_X_GET_Y' THEN regular_price END)"
EFFECTIVE = f"(CASE WHEN {_BASE_PRICE}>0 THEN {r(f'(CASE WHEN promotion_type={chr(39)}BUY_X_GET_Y{chr(39)} THEN {_BASE_PRICE}*2.0::DOUBLE/3.0::DOUBLE ELSE {_BASE_PRICE} END)', 2)} END)"
VIEWS["priced"] = (("live",), f"""
SELECT *, {r("(eff/grams*100.0::DOUBLE)", 2)} AS unit, {r("(regular_price/grams*100.0::DOUBLE)", 2)} AS reg_unit,
 {offer_key('competitor_id', 'product_name', 'pack_size', 'category')} AS offer_key FROM (SELECT *, {EFFECTIVE} AS eff FROM live)""")
VIEWS["offers"] = (("priced",), f"""
SELECT *, coalesce(discount_percentage, CASE WHEN regular_price>eff THEN {r("((1.0::DOUBLE-eff/regular_price)*100.0::DOUBLE)", 1)} END) AS disc
FROM priced WHERE promotion_type<>'MEMBER_PRICE' AND coalesce(minimum_purchase_amount,0)=0
 AND (coalesce(minimum_purchase_quantity,0)=0 OR promotion_type='BUY_X_GET_Y')
 AND (start_date IS NOT NULL OR end_date IS NOT NULL OR last_verified_at>={AS_OF}-INTERVAL 14 DAY) AND unit IS NOT NULL""")
VIEWS["matches"] = (("own", "offers", "decisions"), f"""
SELECT o.own_id, o.name, o.sku, o.own_unit, o.own_promo_unit, o.has_promo, f.promotion_id, f.unit, f.reg_unit, f.grams AS offer_grams, f.eff, f.competitor, f.product_name,
 f.brand AS offer_brand, f.offer_key, f.retailer, f.end_date, f.start_date, f.disc, coalesce(d.accepted,false) AS confirmed, o.category, o.grams AS own_grams,
 {r("((f.unit-o.own_unit)/o.own_unit*100.0::DOUBLE)", 1)} AS gap, {r("((f.unit-o.own_promo_unit)/o.own_promo_unit*100.0::DOUBLE)", 1)} AS promo_gap,
 {r("((f.reg_unit-o.own_unit)/o.own_unit*100.0::DOUBLE)", 1)} AS reg_gap
FROM own o JOIN offers f ON o.category=f.category AND f.grams/o.grams>=0.5::DOUBLE AND f.grams/o.grams<=2.0::DOUBLE
LEFT JOIN decisions d ON d.own_id=o.own_id AND d.offer_key=f.offer_key
WHERE o.own_unit IS NOT NULL AND coalesce(d.accepted,true)""")


def with_views(body: str, *names: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    head = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    recursive = "RECURSIVE " if "/*recursive*/" in body else ""
    glue = ", " if body.lstrip().startswith("+") else " "
    return f"WITH {recursive}{head}{glue}{body.lstrip().lstrip('+')}"
