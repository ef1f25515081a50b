"""Parsers and validators, checked by rendering known values as text and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates as D, geo as GEO, text as T
from ..functions.core import round_half_up
from ..operators import validation as VAL
from ..sources import views as V
from ..sources.tables import Tables
from .oracle import AS_OF, CATEGORY, PACK, PID, r
from .registry import query

MONTH_NAMES = ["Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli", "Agustus", "September", "Oktober", "November", "Desember"]


@query("pack_grams_parse", f"SELECT p_partkey AS product_id, p_size*10.0::DOUBLE AS grams, {r('(p_size*25.0::DOUBLE)', 2)} AS multi_grams, 1000.0::DOUBLE*p_size AS kilo_grams FROM part")
def pack_grams_parse(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t.part.select(
        F.col("p_partkey").alias("product_id"), T.pack_grams(V.pack_text(size)).alias("grams"),
        T.pack_grams(F.concat(F.lit("Isi "), size, F.lit(" X 25 gr"))).alias("multi_grams"),
        T.pack_grams(F.concat(size, F.lit(",0 Kg"))).alias("kilo_grams"))


@query("price_parse", f"SELECT {PID} AS promotion_id, l_extendedprice AS local_price, l_extendedprice AS plain_price, floor(l_extendedprice) AS dotted_price, CAST(NULL AS DOUBLE) AS bad_price FROM lineitem")
def price_parse(t: Tables) -> DataFrame:
    local = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    whole = F.translate(F.format_number(F.floor("l_extendedprice"), 0), ",", ".")
    dotted = F.when(F.col("l_extendedprice") >= 1000, whole).otherwise(F.concat(F.floor("l_extendedprice").cast("string"), F.lit(",0")))
    return t.lineitem.select(
        V.promotion_key().alias("promotion_id"), T.extracted_price(F.concat(F.lit("Rp "), local)).alias("local_price"),
        T.import_price(F.concat(F.lit("IDR "), F.replace(F.format_number("l_extendedprice", 2), F.lit(","), F.lit("")))).alias("plain_price"),
        T.extracted_price(F.concat(F.lit("Rp."), dotted)).alias("dotted_price"), T.import_price(F.lit("gratis")).alias("bad_price"))


@query("pack_from_name", f"SELECT p_partkey AS product_id, {PACK} AS found, CAST(NULL AS VARCHAR) AS none FROM part")
def pack_from_name(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("product_id"), T.pack_from_name(F.concat_ws(" ", "p_name", V.pack_text(F.col("p_size")))).alias("found"),
                         T.pack_from_name("p_name").alias("none"))


def _month(day, short: bool = False):
    names = F.array(*[F.lit(m[:3] if short and m != "Agustus" else "Agt" if short else m) for m in MONTH_NAMES])
    return F.element_at(names, F.month(day))


def _worded(day, short: bool = False):
    return F.concat_ws(" ", F.dayofmonth(day), _month(day, short), F.year(day))


@query("local_date_parse", "SELECT o_orderkey AS order_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS parsed FROM orders")
def local_date_parse(t: Tables) -> DataFrame:
    day, kind = F.to_date("o_orderdate"), F.col("o_orderkey") % 6
    text = (F.when(kind == 0, _worded(day)).when(kind == 1, F.date_format(day, "dd/MM/yyyy")).when(kind == 2, F.date_format(day, "yyyy-MM-dd"))
            .when(kind == 3, F.concat(F.lit("s/d "), _worded(day, True))).when(kind == 4, F.date_format(day, "yyyy.M.d"))
            .otherwise(F.concat(F.lit("tgl "), F.date_format(day, "d-M-yyyy"))))
    return t.orders.select(F.col("o_orderkey").alias("order_id"), D.parse_local_date(text, 1999).cast("string").alias("parsed"))


_RANGE_KIND = "o_orderkey%9"


@query("local_range_parse", f"""+ d AS (SELECT o_orderkey, {_RANGE_KIND} AS k, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE)+CAST(o_custkey%25 AS INTEGER) AS e FROM orders)
SELECT o_orderkey AS order_id, CASE WHEN k=4 THEN NULL ELSE CAST(s AS VARCHAR) END AS starts, CAST(CASE k WHEN 5 THEN s+13 WHEN 8 THEN s ELSE e END AS VARCHAR) AS ends FROM d""".replace("+ d AS", "WITH d AS", 1))
def local_range_parse(t: Tables) -> DataFrame:
    s = F.to_date("o_orderdate")
    e = F.date_add(s, (F.col("o_custkey") % 25).cast("int"))
    kind, same = F.col("o_orderkey") % 9, F.trunc(s, "month") == F.trunc(e, "month")
    full = F.concat(_worded(s), F.lit(" - "), _worded(e))
    text = (F.when(kind == 0, F.concat(F.lit("Periode: "), full))
            .when(kind == 1, F.concat(F.concat_ws(" ", F.dayofmonth(s), _month(s, True)), F.lit(" - "), _worded(e, True)))
            .when((kind == 2) & same, F.concat(F.dayofmonth(s), F.lit(" s/d "), _worded(e)))
            .when(kind == 3, F.concat(F.date_format(s, "dd/MM/yyyy"), F.lit(" - "), F.date_format(e, "dd/MM/yyyy")))
            .when(kind == 4, F.concat(F.lit("sampai "), _worded(e)))
            .when(kind == 5, F.concat(F.lit("Berlaku 2 minggu mulai "), _worded(s)))
            .when(kind == 6, F.concat(F.lit("Minggu ke-1: "), _worded(s), F.lit(" hingga "), _worded(e)))
            .when(kind == 7, F.concat(F.lit("Week 1 ("), full, F.lit(")")))
            .when(kind == 8, F.concat(F.lit("Berlaku "), _worded(s))).otherwise(full))
    p = t.orders.select(F.col("o_orderkey").alias("order_id"), D.parse_local_range(text, 1999).alias("p"))
    return p.select("order_id", F.col("p.starts").cast("string").alias("starts"), F.col("p.ends").cast("string").alias("ends"))


@query("banner_fallback", """SELECT o_orderkey AS order_id, CAST(CASE WHEN o_orderkey%3=2 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS starts,
 CAST(CASE WHEN o_orderkey%3=0 THEN CAST(o_orderdate AS DATE)+9 WHEN o_orderkey%3=1 THEN CAST(o_orderdate AS DATE)+4 ELSE NULL END AS VARCHAR) AS ends FROM orders""")
def banner_fallback(t: Tables) -> DataFrame:
    s, kind = F.to_date("o_orderdate"), F.col("o_orderkey") % 3
    named = F.when(kind == 0, F.concat(_worded(s), F.lit(" - "), _worded(F.date_add(s, 9))))
    top_start = F.when(kind == 1, F.concat(_worded(s), F.lit(" s/d "), _worded(F.date_add(s, 4)))).when(kind == 2, _worded(s))
    p = t.orders.select(F.col("o_orderkey").alias("order_id"),
                        D.banner_validity([F.lit("katalog"), named], top_start, F.lit(None).cast("string"), 1999).alias("p"))
    return p.select("order_id", F.col("p.starts").cast("string").alias("starts"), F.col("p.ends").cast("string").alias("ends"))


@query("region_class", "SELECT coalesce(geography,'') AS geography, geography_region AS region, count(*) AS promotions FROM promo_base GROUP BY 1,2", "promo_base")
def region_class(t: Tables) -> DataFrame:
    p = V.promotions(t, "geography").groupBy("geography").agg(F.count(F.lit(1)).alias("promotions"))
    return p.select(F.coalesce("geography", F.lit("")).alias("geography"), GEO.region_code("geography").alias("region"), "promotions")


@query("geography_token", """SELECT coalesce(CASE WHEN geography_region IN ('STORE_SPECIFIC','UNMAPPED','MULTI_REGION') THEN concat(geography_region,':',lower(geography)) WHEN geography_region='UNKNOWN' THEN NULL ELSE geography_region END,'') AS token,
 count(*) AS promotions FROM promo_base GROUP BY 1""", "promo_base")
def geography_token(t: Tables) -> DataFrame:
    p = V.promotions(t, "geography").groupBy("geography").agg(F.count(F.lit(1)).alias("n"))
    return p.groupBy(F.coalesce(GEO.geography_key("geography"), F.lit("")).alias("token")).agg(F.sum("n").alias("promotions"))


@query("channel_class", """SELECT coalesce(CASE channel WHEN 'E-commerce' THEN 'E-commerce' WHEN 'Modern Trade' THEN 'Modern Trade' END, CASE retailer_channel_type WHEN 'MINIMARKET' THEN 'Modern Trade' WHEN 'SUPERMARKET' THEN 'Modern Trade'
 WHEN 'ECOMMERCE' THEN 'E-commerce' WHEN 'WHOLESALE' THEN 'Wholesale' END, 'N/A') AS channel, count(*) AS promotions FROM promotions GROUP BY 1""", "promotions")
def channel_class(t: Tables) -> DataFrame:
    p = V.promotions(t, "channel", "retailer_channel_type").groupBy("channel", "retailer_channel_type").agg(F.count(F.lit(1)).alias("n"))
    return p.groupBy(GEO.shown_channel("channel", "retailer_channel_type").alias("channel")).agg(F.sum("n").alias("promotions"))


@query("formula_guard", "SELECT s_suppkey AS source_id, CASE WHEN s_nationkey%3=0 THEN concat('''=',s_name) WHEN s_nationkey%3=1 THEN concat('''@',s_name) ELSE s_name END AS cell FROM supplier")
def formula_guard(t: Tables) -> DataFrame:
    raw = F.concat(F.when(F.col("s_nationkey") % 3 == 0, "=").when(F.col("s_nationkey") % 3 == 1, "@").otherwise(""), F.col("s_name"))
    return t.supplier.select(F.col("s_suppkey").alias("source_id"), T.guard_formula(raw).alias("cell"))


def faulty_items(t: Tables) -> DataFrame:
    """Extracted items over every line, with one kind of fault per (line number, tax) combination."""
    line, tax, flag = F.col("l_linenumber"), F.col("l_tax"), F.col("l_returnflag")
    regular = round_half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    iso = F.to_date("l_shipdate").cast("string")
    df = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return df.select(
        V.promotion_key().alias("item_id"), F.when((line == 7) & (tax == 0.0), "x").otherwise(
            F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_name"), F.lit(" Wafer"))).otherwise(F.col("p_name"))).alias("product_name"),
        F.col("p_brand").alias("brand"), F.when((line == 1) & (tax == 0.08), "DRINK").otherwise(V.category_of(F.col("p_type"))).alias("category"),
        F.when((line == 6) & (tax == 0.06), "FLASH").when(flag == "R", "BUY_X_GET_Y").otherwise("DISCOUNT").alias("promotion_type"), iso.alias("start_date"),
        F.when((line == 5) & (tax == 0.02), F.date_sub(F.to_date("l_shipdate"), 1).cast("string")).when((line == 4) & (tax == 0.07), "soon")
         .otherwise(iso).alias("end_date"),
        F.when((line == 3) & (tax == 0.01), F.lit(150.0)).when(line != 2, round_half_up(F.col("l_discount") * 500.0, 1)).alias("discount_percentage"),
        F.when((flag == "R") & (line != 2), F.lit(2)).alias("buy_quantity"), F.when(flag == "R", F.lit(1)).alias("free_quantity"),
        F.when((line == 1) & (tax == 0.05), -regular).otherwise(regular).alias("regular_price"),
        F.when((line == 2) & (tax == 0.03), regular * 2.0).when(line == 2, round_half_up(regular * (F.lit(1.0) - F.col("l_discount")), 2)).alias("promo_price"))


_REG = r("(l_extendedprice/l_quantity)", 2)
_VAL = f"""WITH i AS (SELECT *, {PID} AS item_id, {_REG} AS reg, CASE WHEN l_linenumber=2 THEN {r(f"({_REG}*(1.0::DOUBLE-l_discount))", 2)} END AS pro, CASE WHEN l_linenumber<>2 THEN {r('(l_discount*500.0::DOUBLE)', 1)} END AS off,
 {CATEGORY} AS cat FROM lineitem LEFT JOIN part ON l_partkey=p_partkey),
v AS (SELECT *, CASE WHEN l_linenumber=7 AND l_tax=0 THEN 'Missing product name' WHEN (l_linenumber=1 AND l_tax=0.08::DOUBLE) OR (cat='OTHER' AND p_size%2=1) THEN 'Category outside core scope'
 WHEN l_linenumber=6 AND l_tax=0.06::DOUBLE THEN 'Unsupported promotion type' WHEN l_linenumber=4 AND l_tax=0.07::DOUBLE THEN 'Invalid end date' WHEN l_linenumber=5 AND l_tax=0.02::DOUBLE THEN 'Promotion end date is before start date'
 WHEN l_linenumber=3 AND l_tax=0.01::DOUBLE THEN 'Discount percentage must be between 0 and 100' WHEN l_returnflag='R' AND l_linenumber=2 THEN 'BUY_X_GET_Y requires positive buy and free quantities'
 WHEN l_linenumber=1 AND l_tax=0.05::DOUBLE THEN 'Regular price cannot be negative' WHEN l_linenumber=2 AND l_tax=0.03::DOUBLE THEN 'Promo price exceeds regular price' END AS reason FROM i)"""


@query("validation_split", f"""{_VAL} SELECT item_id, reason, CASE WHEN reason IS NULL THEN {r(f"(CASE WHEN l_returnflag='R' THEN greatest(coalesce(off,0), 1.0::DOUBLE/3.0::DOUBLE*100.0::DOUBLE) ELSE coalesce(off, {r('((reg-pro)/reg*100.0::DOUBLE)', 2)}) END)", 2)} END AS effective_discount FROM v""")
def validation_split(t: Tables) -> DataFrame:
    return VAL.validate_items(faulty_items(t), default_year=2001).select("item_id", "reason", "effective_discount")


def submissions(t: Tables) -> DataFrame:
    """Field submissions over every line, some of them faulty."""
    line, tax, flag = F.col("l_linenumber"), F.col("l_tax"), F.col("l_returnflag")
    regular = round_half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    day = F.to_date("l_shipdate")
    df = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return df.select(
        V.promotion_key().alias("submission_id"), F.col("p_name").alias("product_name"), V.category_of(F.col("p_type")).alias("category"),
        F.when(line != 7, "Jawa Barat").otherwise("  ").alias("geography"), V.pack_text(F.col("p_size")).alias("pack_size"),
        F.when(flag == "R", "BUY_X_GET_Y").when(tax == 0.08, "MULTIBUY").otherwise("DISCOUNT").alias("promotion_type"),
        F.when(line != 2, F.lit(2)).alias("buy_quantity"), F.lit(1).alias("free_quantity"), regular.alias("regular_price"),
        F.when(line == 3, regular * 1.5).when(line == 4, F.lit(0.0)).otherwise(regular * 0.8).alias("promo_price"),
        F.when(tax == 0.07, "ok").otherwise("Seen on shelf").alias("evidence"), day.alias("observed_on"), day.alias("starts"),
        F.when(line == 5, F.date_sub(day, 3)).otherwise(day).alias("ends"))


@query("submission_rejects", f"""WITH i AS (SELECT {PID} AS submission_id, {CATEGORY} AS cat, * FROM lineitem LEFT JOIN part ON l_partkey=p_partkey)
SELECT submission_id, CASE WHEN cat='OTHER' THEN 'Check the category.' WHEN l_linenumber=7 THEN 'Check the geography.' WHEN l_returnflag<>'R' AND l_tax=0.08::DOUBLE THEN 'Check the mechanic.' WHEN l_linenumber=4 THEN 'Check the promotion price.'
 WHEN l_tax=0.07::DOUBLE THEN 'Check the evidence.' WHEN l_shipdate>{AS_OF} OR l_linenumber=5 THEN 'Check observation and validity dates.' WHEN l_returnflag='R' AND l_linenumber=2 THEN 'Enter paid and free quantities.'
 WHEN l_linenumber=3 THEN 'Promotion price exceeds regular price.' END AS reason FROM i""")
def submission_rejects(t: Tables) -> DataFrame:
    return VAL.validate_submissions(submissions(t), local_today="2001-01-01").select("submission_id", "reason")


@query("scoped_price_rejects", """SELECT id, CASE WHEN region='UNKNOWN' THEN 'UNKNOWN' WHEN region='UNMAPPED' THEN 'UNMAPPED' ELSE region END AS region_code,
 CASE WHEN region IN ('UNKNOWN','UNMAPPED') OR promo_price>regular_price THEN 'Check region, campaign dates and price.' END AS reason FROM scoped_prices""", "scoped_prices")
def scoped_price_rejects(t: Tables) -> DataFrame:
    return VAL.validate_scoped_prices(V.scoped_prices(t)).select("id", "region_code", "reason")


@query("submission_chain", f"""WITH s AS (SELECT o_orderkey AS submission_id, o_custkey%3 AS submitted_by, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN o_orderkey-1 END AS previous_id, CASE o_orderstatus WHEN 'F' THEN 'CORRECTION' WHEN 'O' THEN 'PENDING' ELSE 'APPROVED' END AS status FROM orders)
SELECT c.submission_id, c.previous_id, CASE WHEN p.submission_id IS NULL THEN 'unknown parent' WHEN p.status<>'CORRECTION' THEN 'parent not returned' ELSE 'other submitter' END AS reason
FROM s c LEFT JOIN s p ON p.submission_id=c.previous_id WHERE c.previous_id IS NOT NULL AND (p.submission_id IS NULL OR p.status<>'CORRECTION' OR p.submitted_by<>c.submitted_by)""")
def submission_chain(t: Tables) -> DataFrame:
    return VAL.correction_violations(order_submissions(t))


def order_submissions(t: Tables) -> DataFrame:
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    status = F.when(F.col("o_orderstatus") == "F", "CORRECTION").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("APPROVED")
    payload = F.to_json(F.struct((F.col("o_custkey") % 30).alias("competitor_id"), (F.col("o_custkey") % 25).alias("retailer_id"),
                                 F.col("o_orderpriority").alias("product_name"), F.when(urgent, "x").alias("photo")))
    return t.orders.select(
        F.col("o_orderkey").alias("submission_id"), (F.col("o_custkey") % 3).alias("submitted_by"),
        F.when(urgent, F.col("o_orderkey") - 1).alias("previous_id"), status.alias("status"),
        F.col("o_orderdate").alias("submitted_at"), payload.alias("payload"))


@query("submission_worklist", """SELECT o_orderkey AS submission_id, 'NATION_'||(o_custkey%30) AS competitor, 'RETAILER_'||(o_custkey%25) AS retailer, o_orderpriority AS product, o_orderpriority IN ('1-URGENT','2-HIGH') AS has_photo,
 CASE o_orderstatus WHEN 'F' THEN 'CORRECTION' WHEN 'O' THEN 'PENDING' ELSE 'APPROVED' END AS status FROM orders""".replace(
    "'NATION_'||(o_custkey%30) AS competitor", "CASE WHEN o_custkey%30<25 THEN 'NATION_'||(o_custkey%30) END AS competitor"))
def submission_worklist(t: Tables) -> DataFrame:
    return VAL.submission_worklist(order_submissions(t), V.competitors(t), V.retailers(t)).select(
        "submission_id", "competitor", "retailer", "product", "has_photo", "status")
