"""Entity resolution and review-queue queries: names with injected typos against master data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import entity_key
from ..operators import resolution as RES
from ..sources import views as V
from ..sources.tables import Tables
from .registry import query

_GRAMS = "list_distinct(list_transform(range(1, length({0})+2), lambda i: substr(concat('  ',{0},' '), i::INTEGER, 3)))"


def _sim(a: str, b: str) -> str:
    ga, gb = _GRAMS.format(a), _GRAMS.format(b)
    return f"(len(list_intersect({ga},{gb}))::DOUBLE/(len({ga})+len({gb})-len(list_intersect({ga},{gb}))::DOUBLE))"


def _norm(x: str) -> str:
    return f"regexp_replace(lower({x}),'[^a-z0-9]','','g')"


def shop_mentions(t: Tables) -> DataFrame:
    """Every customer mentions its shop: exact, by alias, with a typo, with extra words, or not at all."""
    k, shop = F.col("c_custkey") % 6, F.concat(F.lit("Retailer "), F.col("c_nationkey"))
    text = (F.when(k == 0, shop).when(k == 1, F.concat(F.lit("Shop-"), F.col("c_nationkey"))).when(k == 2, F.concat(shop, F.lit("x")))
            .when(k == 3, F.concat(F.lit("the "), shop, F.lit(" market"))).when(k == 4, F.concat(F.lit("RETAILR"), F.col("c_nationkey"))))
    return t.customer.select(F.col("c_custkey").alias("item_id"), text.alias("retailer_text"))


def shop_aliases(t: Tables) -> DataFrame:
    """'Shop-n' maps to retailer n; every fifth alias is dangling."""
    k = F.col("n_nationkey")
    return t.nation.select(entity_key(F.concat(F.lit("Shop-"), k)).alias("norm"), F.when(k % 5 == 0, k + 1000).otherwise(k).cast("bigint").alias("alias_entity_id"),
                           F.lit(0.95).alias("alias_confidence"))


_MENTION = """CASE c_custkey%6 WHEN 0 THEN concat('Retailer ',c_nationkey) WHEN 1 THEN concat('Shop-',c_nationkey) WHEN 2 THEN concat('Retailer ',c_nationkey,'x') WHEN 3 THEN concat('the Retailer ',c_nationkey,' market')
 WHEN 4 THEN concat('RETAILR',c_nationkey) END"""
_SHOPS = f"""m AS (SELECT c_custkey AS item_id, {_MENTION} AS txt, coalesce({_norm(_MENTION)},'') AS norm FROM customer), u AS (SELECT DISTINCT norm FROM m WHERE norm<>''),
dim AS (SELECT retailer_id, {_norm('name')} AS dn FROM retailers), al AS (SELECT {_norm("concat('Shop-',n_nationkey)")} AS norm, CASE WHEN n_nationkey%5=0 THEN n_nationkey+1000 ELSE n_nationkey END AS aid FROM nation),
s AS (SELECT u.norm, d.retailer_id, {_sim('u.norm', 'd.dn')} AS sim FROM u, dim d), f AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY sim DESC, retailer_id) rn FROM s WHERE sim>=0.70),
b AS (SELECT norm, max(sim) FILTER (rn=1) AS best, max(retailer_id) FILTER (rn=1) AS cand, coalesce(max(sim) FILTER (rn=2),0) AS second FROM f WHERE rn<=2 GROUP BY 1),
o AS (SELECT u.norm, CASE WHEN al.norm IS NOT NULL THEN CASE WHEN al.aid<1000 THEN 'RESOLVED' ELSE 'REVIEW' END WHEN d.dn IS NOT NULL THEN 'RESOLVED' WHEN best>=0.92 AND best-second>=0.08 THEN 'RESOLVED' WHEN best IS NOT NULL THEN 'REVIEW' ELSE 'UNRESOLVED' END AS status,
 CASE WHEN al.norm IS NOT NULL THEN 'MAPPING' WHEN d.dn IS NOT NULL THEN 'NORMALIZED' WHEN best IS NOT NULL THEN 'FUZZY' ELSE 'NONE' END AS method, coalesce(al.aid, d.retailer_id, cand) AS target FROM u LEFT JOIN al ON al.norm=u.norm LEFT JOIN dim d ON d.dn=u.norm LEFT JOIN b ON b.norm=u.norm)"""


def shop_outcomes(t: Tables) -> DataFrame:
    return RES.resolve_retailers(shop_mentions(t), V.retailers(t), shop_aliases(t))


@query("alias_exact_resolution", f"""+ {_SHOPS} SELECT method, coalesce(o.status,'UNRESOLVED') AS status, count(*) AS mentions FROM m JOIN o ON o.norm=m.norm WHERE method IN ('MAPPING','NORMALIZED') GROUP BY 1,2""", "retailers")
def alias_exact_resolution(t: Tables) -> DataFrame:
    return shop_outcomes(t).filter(F.col("method").isin("MAPPING", "NORMALIZED")).groupBy("method", "status").agg(F.count(F.lit(1)).alias("mentions"))


@query("resolution_outcome", f"""+ {_SHOPS} SELECT item_id, coalesce(o.status,'UNRESOLVED') AS status, coalesce(o.method,'NONE') AS method, CAST(coalesce(target,-1) AS BIGINT) AS target FROM m LEFT JOIN o ON o.norm=m.norm""", "retailers")
def resolution_outcome(t: Tables) -> DataFrame:
    return shop_outcomes(t).select("item_id", "status", "method", F.coalesce("entity_id", "candidate_id", F.lit(-1)).alias("target"))


@query("trigram_candidates", f"""WITH p AS (SELECT DISTINCT p_brand AS scope, {_norm("concat(p_name,p_size,p_type)")} AS norm FROM part), q AS (SELECT DISTINCT p_brand AS scope, {_norm("concat(p_name,'s',p_size,p_type)")} AS norm FROM part)
SELECT q.scope, q.norm, p.norm AS dim_norm, round({_sim('q.norm', 'p.norm')},9) AS sim FROM q JOIN p ON p.scope=q.scope WHERE {_sim('q.norm', 'p.norm')}>=0.70""")
def trigram_candidates(t: Tables) -> DataFrame:
    dim = t.part.select(F.col("p_brand").alias("scope"), entity_key(F.concat("p_name", "p_size", "p_type")).alias("norm"))
    asked = t.part.select(F.col("p_brand").alias("scope"), entity_key(F.concat("p_name", F.lit("s"), "p_size", "p_type")).alias("norm"))
    return RES.trigram_candidates(asked, dim).withColumn("sim", F.round("sim", 9))


def product_dim(t: Tables) -> DataFrame:
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return t.part.select(
        F.col("p_partkey").alias("product_id"), number.alias("brand_id"), F.concat_ws(" ", "p_name", "p_size", "p_type").alias("name"),
        F.concat(F.lit("S"), F.col("p_partkey")).alias("sku"), F.concat(F.lit("899"), F.col("p_partkey")).alias("barcode"),
        F.concat(F.col("p_size") * 10, F.lit("g")).alias("pack_label"))


def product_mentions(t: Tables) -> DataFrame:
    """Every product is mentioned once: exactly, by SKU, by barcode, with a typo, with a wrong pack, or without a brand."""
    k, name = F.col("p_partkey") % 8, F.concat_ws(" ", "p_name", "p_size", "p_type")
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    text = (F.when(k == 3, F.concat(name, F.lit("x"))).when(k == 4, F.concat(F.lit("new "), name)).when(k.isin(1, 2), F.concat(F.lit("item "), F.col("p_partkey")))
            .when(k == 7, F.concat(F.lit("alias "), F.col("p_partkey"))).otherwise(name))
    return t.part.select(
        F.col("p_partkey").alias("item_id"), text.alias("product_text"), F.when(k != 6, number).alias("brand_id"),
        F.when(k == 1, F.concat(F.lit("S"), F.col("p_partkey"))).alias("sku"), F.when(k == 2, F.concat(F.lit("899"), F.col("p_partkey"))).alias("barcode"),
        F.when(k == 5, "1 kg").when(k == 0, F.concat(F.col("p_size") * 10, F.lit(" g"))).alias("pack_size"))


def product_aliases(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(entity_key(F.concat(F.lit("alias "), k)).alias("norm"), k.alias("alias_entity_id"), F.lit(0.9).alias("alias_confidence"))


_PN = _norm("concat_ws(' ',p_name,p_size,p_type)")


@query("product_resolution", f"""WITH d AS (SELECT p_partkey AS pid, p_brand, {_PN} AS dn, concat(p_size*10,'g') AS pk FROM part), x AS (SELECT p_brand, dn, min(pid) AS pid FROM d GROUP BY 1,2), i AS (SELECT p_partkey, p_partkey%8 AS k, p_brand, p_size, CASE p_partkey%8 WHEN 3 THEN concat({_PN},'x') WHEN 4 THEN concat('new',{_PN}) ELSE {_PN} END AS norm FROM part),
s AS (SELECT i.p_partkey, d.pid, {_sim('i.norm', 'd.dn')} AS sim FROM i JOIN d ON d.p_brand=i.p_brand WHERE k IN (3,4)), f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY sim DESC, pid) rn FROM s WHERE sim>=0.70),
b AS (SELECT p_partkey, max(sim) FILTER (rn=1) AS best, max(pid) FILTER (rn=1) AS cand, coalesce(max(sim) FILTER (rn=2),0) AS second FROM f WHERE rn<=2 GROUP BY 1)
SELECT i.p_partkey AS item_id, CASE WHEN k=6 THEN 'REVIEW' WHEN k IN (1,2,7,0) THEN CASE WHEN k=0 AND xd.pk<>concat(i.p_size*10,'g') THEN 'REVIEW' ELSE 'RESOLVED' END WHEN k=5 THEN CASE WHEN xd.pk='1kg' THEN 'RESOLVED' ELSE 'REVIEW' END
  WHEN x.pid IS NOT NULL THEN 'RESOLVED' WHEN best>=0.92 AND best-second>=0.08 THEN 'RESOLVED' WHEN best IS NOT NULL THEN 'REVIEW' ELSE 'UNRESOLVED' END AS status,
 CASE WHEN k=6 THEN 'DEPENDENT' WHEN k=7 THEN 'MAPPING' WHEN k=1 THEN 'SKU' WHEN k=2 THEN 'BARCODE' WHEN x.pid IS NOT NULL THEN 'NORMALIZED' WHEN best IS NOT NULL THEN 'FUZZY' ELSE 'NONE' END AS method,
 CAST(CASE WHEN k=6 THEN -1 WHEN k IN (1,2,7) THEN i.p_partkey ELSE coalesce(x.pid, cand, -1) END AS BIGINT) AS target
FROM i LEFT JOIN x ON x.p_brand=i.p_brand AND x.dn=i.norm LEFT JOIN d xd ON xd.pid=x.pid LEFT JOIN b ON b.p_partkey=i.p_partkey""")
def product_resolution(t: Tables) -> DataFrame:
    out = RES.resolve_products(product_mentions(t), product_dim(t), product_aliases(t))
    return out.select("item_id", "status", "method", F.coalesce("entity_id", "candidate_id", F.lit(-1)).alias("target"))


def pending_queue(t: Tables) -> DataFrame:
    """The stored review queue, one item per order."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("RETAILER", "BRAND", "COMPETITOR", "PRODUCT", "CONFLICT")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    return t.orders.select(
        F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("observation_id"), F.col("o_custkey").alias("promotion_id"), kind.alias("entity_type"),
        F.when(F.col("o_orderstatus") == "O", "PENDING").otherwise("APPROVED").alias("status"),
        F.when(kind == "CONFLICT", 5).when(kind == "PRODUCT", 1).otherwise(2).alias("priority"), F.col("o_orderdate").alias("created_at"))


_QUEUE = """q AS (SELECT o_orderkey AS review_id, o_custkey AS promotion_id, ['RETAILER','BRAND','COMPETITOR','PRODUCT','CONFLICT'][CAST(substr(o_orderpriority,1,1) AS INTEGER)] AS entity_type, CASE WHEN o_orderstatus='O' THEN 'PENDING' ELSE 'APPROVED' END AS status,
 CASE WHEN substr(o_orderpriority,1,1)='5' THEN 5 WHEN substr(o_orderpriority,1,1)='4' THEN 1 ELSE 2 END AS priority, o_orderdate AS created_at FROM orders)"""


@query("review_rows_new", f"""+ {_SHOPS}, {_QUEUE} SELECT item_id AS observation_id, CASE coalesce(o.status,'UNRESOLVED') WHEN 'REVIEW' THEN 2 ELSE 1 END AS priority, concat('Source value ''',txt,''': Entity resolution status: ',o.status,'; method=',o.method) AS reason
FROM m JOIN o ON o.norm=m.norm WHERE o.status<>'RESOLVED' AND NOT EXISTS (SELECT 1 FROM q WHERE q.promotion_id=m.item_id AND q.entity_type='RETAILER' AND q.status='PENDING')""", "retailers")
def review_rows_new(t: Tables) -> DataFrame:
    out = shop_outcomes(t).select(F.col("item_id").alias("observation_id"), F.lit("RETAILER").alias("entity_type"), F.col("retailer_text").alias("source_value"),
                                  "status", "method", "candidate_id", "confidence")
    return RES.review_rows(out, pending_queue(t)).select("observation_id", "priority", "reason")


@query("review_worklist", f"WITH {_QUEUE} SELECT review_id, entity_type, priority, created_at FROM q WHERE status='PENDING'")
def review_worklist(t: Tables) -> DataFrame:
    return RES.review_worklist(pending_queue(t)).select("review_id", "entity_type", "priority", "created_at")


@query("review_backlog", f"WITH {_QUEUE} SELECT count(*) FILTER (status='PENDING') AS pending, count(*) FILTER (status='PENDING' AND entity_type='CONFLICT') AS conflicts, 'WARN' AS severity FROM q")
def review_backlog(t: Tables) -> DataFrame:
    return RES.review_backlog(pending_queue(t))


@query("open_conflicts", f"WITH {_QUEUE} SELECT promotion_id, count(*) AS open_conflicts FROM q WHERE status='PENDING' AND entity_type='CONFLICT' GROUP BY 1")
def open_conflicts(t: Tables) -> DataFrame:
    return RES.open_conflicts(pending_queue(t))


def unresolved_customers(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Promotions (one per customer) missing brand or retailer, and what their newest observation says."""
    k = F.col("c_custkey")
    promos = t.customer.select(k.alias("promotion_id"), F.when(k % 4 == 1, k % 25 + 1).cast("bigint").alias("brand_id"), F.when(k % 4 == 1, k % 20).cast("bigint").alias("competitor_id"),
                               F.when(k % 3 == 0, F.col("c_nationkey")).cast("bigint").alias("retailer_id"))
    brand = F.concat(F.lit("Brand "), k % 30 + 1)
    newest = t.customer.select(k.alias("promotion_id"), F.when(k % 4 == 2, brand).alias("brand_text"),
                               F.when(k % 4 == 3, F.concat(F.lit("Brand#"), k % 30 + 1, F.lit(" wafer"))).otherwise("unnamed").alias("product_text"),
                               F.concat(F.lit("Retailer "), F.col("c_nationkey")).alias("retailer_text"))
    return promos, newest


_RE = """p AS (SELECT c_custkey AS k, c_nationkey AS n, CASE WHEN c_custkey%4=1 THEN c_custkey%25+1 END AS b, CASE WHEN c_custkey%4=1 THEN c_custkey%20 END AS c, CASE WHEN c_custkey%3=0 THEN c_nationkey END AS r FROM customer),
z AS (SELECT *, CASE WHEN b IS NULL AND k%4 IN (2,3) AND k%30+1<=25 THEN k%30+1 ELSE b END AS nb FROM p WHERE b IS NULL OR r IS NULL)"""


@query("re_resolved", f"""WITH {_RE} SELECT k AS promotion_id, CAST(coalesce(nb,-1) AS BIGINT) AS brand_id, CAST(coalesce(CASE WHEN b IS NULL THEN nb%25 ELSE c END,-1) AS BIGINT) AS competitor_id, CAST(n AS BIGINT) AS retailer_id FROM z""")
def re_resolved(t: Tables) -> DataFrame:
    promos, newest = unresolved_customers(t)
    none = t.nation.filter("false").select(F.lit("").alias("norm"), F.lit(0).cast("bigint").alias("alias_entity_id"), F.lit(0.0).alias("alias_confidence"))
    out = RES.re_resolve(promos, newest, V.brands(t), V.retailers(t), none, none)
    return out.select("promotion_id", *[F.coalesce(c, F.lit(-1)).cast("bigint").alias(c) for c in ("brand_id", "competitor_id", "retailer_id")])


@query("reviews_closed", f"""WITH {_QUEUE}, p AS (SELECT c_custkey AS k, c_custkey%4=1 AS done, c_custkey%3=0 AS shop FROM customer)
SELECT entity_type, count(*) AS closed FROM q JOIN p ON p.k=q.promotion_id WHERE status='PENDING' AND done AND (entity_type IN ('BRAND','COMPETITOR') OR (entity_type='RETAILER' AND shop)) GROUP BY 1""")
def reviews_closed(t: Tables) -> DataFrame:
    queue = pending_queue(t)
    closed = RES.close_resolved_reviews(queue.filter("status = 'PENDING'"), unresolved_customers(t)[0]).filter("status = 'APPROVED'")
    return closed.groupBy("entity_type").agg(F.count(F.lit(1)).alias("closed"))
