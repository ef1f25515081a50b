"""Promotion-domain views over the star-schema test tables.

``promotions`` joins only the tables behind the columns a caller asks for, so a
report that needs no customer data never reads or shuffles customers. All joins
are left joins on unique keys: asking for fewer columns cannot change the rows.
No join carries a broadcast hint; Spark broadcasts a side when its measured
size is under the session threshold and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.core import count_if, instant, round_half_up
from ..functions.dates import lifecycle
from .tables import Tables

AS_OF = "2001-01-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

CATEGORY_OF_TYPE = {"STANDARD": "BISCUIT", "PROMO": "CRACKER", "LARGE": "COOKIE", "SMALL": "WAFER", "MEDIUM": "SNACK"}
WORDING_OF_REGION = {"AFRICA": ("Jawa Barat", "JAWA"), "AMERICA": ("Seluruh Indonesia", "NATIONAL"),
                     "ASIA": ("Jakarta dan Bandung", "JABODETABEK"), "EUROPE": (None, "UNKNOWN"),
                     "MIDDLE EAST": ("Toko tertentu", "STORE_SPECIFIC")}

_BASE = ["promotion_id", "product_id", "source_id", "regular_price", "promo_price", "discount_percentage",
         "promotion_type", "buy_quantity", "free_quantity", "channel", "currency", "minimum_purchase_amount",
         "minimum_purchase_quantity", "has_open_conflict", "source_reliability", "ai_confidence", "rank_score",
         "last_verified_at", "last_seen_at"]
_ORDER = ["start_date", "end_date", "first_seen_at", "status"]
_PART = ["product_name", "brand", "category", "pack_size"]
_SUPPLIER = ["competitor_id"]
_COMPETITOR = ["competitor", "importance"]
_CUSTOMER = ["retailer_id"]
_RETAILER = ["retailer", "retailer_channel_type"]
_GEOGRAPHY = ["geography", "geography_region"]
PROMOTION_COLUMNS = _BASE + _ORDER + _PART + _SUPPLIER + _COMPETITOR + _CUSTOMER + _RETAILER + _GEOGRAPHY


def promotion_key():
    return F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"),
        F.floor(F.col("l_extendedprice") * 100 + F.lit(0.5)).cast("bigint"))


def category_of(kind):
    out = F.lit("OTHER")
    for name, category in CATEGORY_OF_TYPE.items():
        out = F.when(kind == name, F.lit(category)).otherwise(out)
    return out


def pack_text(size):
    return (F.when(size % 3 == 0, F.concat(size, F.lit(" x 10 g"))).when(size % 3 == 1, F.concat(size * 10, F.lit("g")))
            .otherwise(F.concat(F.lit("0,"), F.lpad(size.cast("string"), 2, "0"), F.lit(" kg"))))


def promotions(t: Tables, *columns: str) -> DataFrame:
    """One row per order line. Columns are worked out after the joins, so lines are shuffled as they are stored: first
    for the joins that add least, with customers already beside their orders."""
    wanted = list(columns) or PROMOTION_COLUMNS
    need = set(wanted)
    line, qty = F.col("l_linenumber"), F.col("l_quantity")
    geo = need & set(_GEOGRAPHY)
    customer = geo or need & set(_CUSTOMER + _RETAILER)
    df = t.facts("lineitem")
    if need & set(_SUPPLIER + _COMPETITOR):
        df = df.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    if customer or need & set(_ORDER):
        orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
        if customer:
            orders = orders.join(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if need & set(_PART):
        df = df.join(t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"), "left")
    regular = round_half_up(F.col("l_extendedprice") / qty, 2)
    df = df.select(
        "*", promotion_key().alias("promotion_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("source_id"), regular.alias("regular_price"),
        F.when(line == 2, round_half_up(regular * (F.lit(1.0) - F.col("l_discount") * 5.0), 2)).alias("promo_price"),
        F.when(~((line == 2) & (F.col("l_tax") >= 0.06)), round_half_up(F.col("l_discount") * 500.0, 1)).alias("discount_percentage"),
        F.when(F.col("l_returnflag") == "R", "BUY_X_GET_Y")
         .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), "MEMBER_PRICE")
         .otherwise("DISCOUNT").alias("promotion_type"),
        F.when(F.col("l_returnflag") == "R", F.lit(2)).alias("buy_quantity"),
        F.when(F.col("l_returnflag") == "R", F.lit(1)).alias("free_quantity"),
        F.when(line == 3, "E-commerce").when(line == 4, "Modern Trade").alias("channel"),
        F.lit("IDR").alias("currency"),
        F.when((line == 5) & (F.col("l_tax") == 0.01), F.lit(50000.0)).alias("minimum_purchase_amount"),
        F.when(line == 6, F.lit(3)).alias("minimum_purchase_quantity"),
        (F.col("l_tax") >= 0.08).alias("has_open_conflict"),
        (F.lit(0.7) + F.col("l_tax") * 3.0).alias("source_reliability"),
        (F.lit(0.6) + F.col("l_discount") * 4.0).alias("ai_confidence"),
        (((F.col("l_orderkey") * 31 + line * 7 + F.col("l_partkey")) % 1000) / F.lit(1000.0)).alias("rank_score"),
        F.col("l_shipdate").alias("last_verified_at"), F.col("l_shipdate").alias("last_seen_at"),
    )
    if customer or need & set(_ORDER):
        dated = ~line.isin(3, 6)
        df = df.withColumns({
            "first_seen_at": F.col("o_orderdate"),
            "start_date": F.when(dated, F.col("o_orderdate")),
            "end_date": F.when(dated & (line != 5),
                               (F.col("o_orderdate") + F.make_dt_interval((F.lit(30) + qty * 10).cast("int")))),
        })
        df = df.withColumn("status", lifecycle("start_date", "end_date", AS_OF))
    if need & set(_PART):
        df = df.withColumns({
            "product_name": F.col("p_name"),
            "brand": F.when(~((line == 7) & (F.col("l_returnflag") == "N")), F.col("p_brand")),
            "category": category_of(F.col("p_type")), "pack_size": pack_text(F.col("p_size")),
        })
    if need & set(_SUPPLIER + _COMPETITOR):
        df = df.withColumn("competitor_id", F.when(line != 7, F.col("s_nationkey")))
        if need & set(_COMPETITOR):
            names = competitors(t).select(F.col("competitor_id").alias("ck"), F.col("name").alias("competitor"),
                                          F.col("importance_score").alias("importance"))
            df = df.join(names, F.col("competitor_id") == F.col("ck"), "left")
    if customer:
        df = df.withColumn("retailer_id", F.col("c_nationkey"))
        if need & set(_RETAILER):
            names = retailers(t).select(F.col("retailer_id").alias("rk"), F.col("name").alias("retailer"),
                                        F.col("channel_type").alias("retailer_channel_type"))
            df = df.join(names, F.col("c_nationkey") == F.col("rk"), "left")
        if geo:
            where = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "r_name")
            df = df.join(where, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            machinery = F.col("c_mktsegment") == "MACHINERY"
            excluded = (F.col("c_mktsegment") == "HOUSEHOLD") & (F.col("r_name") == "AFRICA")
            wording, code = F.lit(None).cast("string"), F.lit("UNKNOWN")
            for name, (text, region) in WORDING_OF_REGION.items():
                wording = F.when(F.col("r_name") == name, F.lit(text)).otherwise(wording)
                code = F.when(F.col("r_name") == name, F.lit(region)).otherwise(code)
            df = df.withColumns({
                "geography": F.when(machinery, "Sumatera, Bali").when(excluded, "Semua kecuali Papua").otherwise(wording),
                "geography_region": F.when(machinery, "MULTI_REGION").when(excluded, "UNMAPPED").otherwise(code),
            })
    return df.select(*wanted)


def evidence(t: Tables) -> DataFrame:
    line, kind = F.col("l_linenumber"), F.col("l_returnflag")
    return (
        t.facts("lineitem").filter(F.col("l_tax") > 0)
        .withColumn("k", F.explode(F.when(line.isin(2, 4), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            promotion_key().alias("promotion_id"),
            F.concat_ws("/", promotion_key(), F.col("k")).alias("evidence_id"), F.col("l_orderkey").alias("document_id"),
            F.when(F.col("l_tax") == 0.05, "APPROVED_FIELD").otherwise("TEXT").alias("evidence_type"),
            F.when(F.col("l_tax") == 0.03, "   ").when(kind == "R", "Promo beli 2 gratis 1")
             .when(kind == "A", "Harga member gopay").otherwise("Diskon akhir pekan").alias("evidence_text"),
            F.concat(F.lit("https://shop.example/"), F.col("l_suppkey"), F.lit("/"), F.col("k")).alias("source_url"),
            (F.col("l_shipdate") + F.make_dt_interval(F.col("k"))).alias("captured_at"),
            (F.col("l_shipdate") + F.make_dt_interval(F.col("k"))).alias("created_at"),
        )
    )


def crawl_documents(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("document_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("document_source_id"),
        F.col("o_orderdate").alias("retrieved_at"))


def sources(t: Tables) -> DataFrame:
    n, k, now = F.col("s_nationkey"), F.col("s_suppkey"), instant(AS_OF)
    ago = lambda d: now - F.make_dt_interval(d.cast("int"))
    return t.supplier.select(
        k.alias("source_id"), F.col("s_name").alias("name"),
        F.concat(F.lit("shop"), k, F.lit(".example")).alias("domain"),
        F.when(F.col("s_acctbal") < 0, "CANDIDATE").when(n == 24, "REJECTED").otherwise("APPROVED").alias("approval_status"),
        (n != 23).alias("is_active"), F.when(n != 22, F.lit("retailer")).alias("adapter_key"),
        (F.lit(0.6) + (n % 8) * F.lit(0.05)).alias("reliability_score"),
        ((n % 48 + 1) * 60).alias("crawl_frequency_minutes"), (n % 5).alias("priority"),
        F.when(n != 21, ago(k % 5)).alias("last_crawled_at"),
        F.when(n != 20, ago(k % 6)).alias("last_success_at"),
        F.when(k % 4 == 0, ago(k % 3)).alias("last_error_at"),
        F.when(k % 7 != 0, ago(k % 6)).alias("last_processed_at"),
    )


def competitors(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("competitor_id"), F.col("n_name").alias("name"),
                           (F.col("n_nationkey") / F.lit(25.0)).alias("importance_score"),
                           (F.col("n_nationkey") != 13).alias("is_active"))


def retailers(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    kind = (F.when(k % 6 == 0, "MINIMARKET").when(k % 6 == 1, "SUPERMARKET").when(k % 6 == 2, "ECOMMERCE")
            .when(k % 6 == 3, "WHOLESALE").when(k % 6 == 4, "WARUNG"))
    return t.nation.select(k.alias("retailer_id"), F.concat(F.lit("RETAILER_"), k).alias("name"), kind.alias("channel_type"))


def brands(t: Tables) -> DataFrame:
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return (t.part.select(number.alias("brand_id"), F.col("p_brand").alias("name")).distinct()
            .withColumn("competitor_id", F.col("brand_id") % 25))


def own_products(t: Tables) -> DataFrame:
    size = F.col("p_size")
    bundle, sale = size % 7 == 0, size % 4 == 0
    return t.part.select(
        F.col("p_partkey").alias("own_id"), F.concat(F.lit("SKU-"), F.col("p_partkey")).alias("sku"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), category_of(F.col("p_type")).alias("category"),
        F.when(size != 50, pack_text(size)).alias("pack_size"),
        F.when((size != 50) & (size % 5 != 0), size * 10.0).alias("pack_grams"),
        round_half_up(F.col("p_retailprice") * 5.0, 2).alias("regular_price"),
        F.when(~bundle & sale, round_half_up(F.col("p_retailprice") * 4.25, 2)).alias("promo_price"),
        F.when(bundle, "BUY_X_GET_Y").when(sale, "DISCOUNT").otherwise("REGULAR").alias("promo_type"),
        F.when(bundle, F.lit(3)).alias("buy_quantity"), F.when(bundle, F.lit(1)).alias("free_quantity"),
        F.when(size % 8 == 0, F.lit("2001-02-01 00:00:00").cast("timestamp_ntz")).alias("promo_start_date"),
        F.lit(None).cast("timestamp_ntz").alias("promo_end_date"),
    )


def change_events(t: Tables) -> DataFrame:
    line = F.col("l_linenumber")
    return t.facts("lineitem").filter(F.col("l_discount") > 0).select(
        promotion_key().alias("promotion_id"),
        F.when(line == 1, "CREATED").when(line.isin(2, 3), "PRICE_OR_VALUE_CHANGED").when(line == 4, "MECHANIC_CHANGED")
         .when(line == 5, "DATES_CHANGED").otherwise("TERMS_CHANGED").alias("event_type"),
        F.when(line == 1, F.lit(None).cast("string")).when(line.isin(2, 3), "promo_price").when(line == 4, "promotion_type")
         .when(line == 5, "end_date").otherwise("channel").alias("field_name"),
        line.cast("string").alias("previous_value"), (line + 1).cast("string").alias("new_value"),
        round_half_up(F.col("l_discount") * 4.0, 4).alias("change_impact"),
        (F.col("l_shipdate") + F.make_dt_interval((line % 3).cast("int"))).alias("observed_at"),
    )


def scoped_prices(t: Tables) -> DataFrame:
    p = promotions(t, "promotion_id", "product_id", "retailer_id", "geography_region", "regular_price", "first_seen_at", "promotion_type")
    return p.select(
        F.col("promotion_id").alias("id"), "product_id", "retailer_id", F.col("geography_region").alias("region"),
        F.to_date("first_seen_at").alias("starts"), F.date_add(F.to_date("first_seen_at"), 90).alias("ends"),
        F.col("regular_price").cast("decimal(14,2)").alias("regular_price"),
        F.when(F.col("promotion_type") == "DISCOUNT", round_half_up(F.col("regular_price") * 0.9, 2).cast("decimal(14,2)")).alias("promo_price"),
        F.col("first_seen_at").alias("recorded_at"))


def decision_log(t: Tables) -> DataFrame:
    """Analyst verdicts on own-product / offer pairs, every recorded version."""
    from ..functions.text import offer_key
    base = (t.lineitem.filter((F.col("l_tax") <= 0.01) & (F.col("l_linenumber") != 7))
            .join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
            .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left"))
    return base.select(
        F.col("p_partkey").alias("own_id"),
        offer_key(F.col("s_nationkey"), F.col("p_name"), pack_text(F.col("p_size")), category_of(F.col("p_type"))).alias("offer_key"),
        (F.col("l_discount") >= 0.05).alias("accepted"), F.col("l_shipdate").alias("reviewed_at"), promotion_key().alias("log_id"))


def observations(t: Tables) -> DataFrame:
    """Sightings of a product by its sources over time: the input of the canonical fold."""
    return t.facts("lineitem").select(
        F.col("l_partkey").alias("fold_key"), promotion_key().alias("observation_id"), F.col("l_orderkey").alias("document_id"),
        F.col("l_shipdate").alias("observed_at"), F.col("l_suppkey").alias("source_id"),
        F.when(F.col("l_tax") != 0.04, round_half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2)).alias("regular_price"),
        F.when(F.col("l_linenumber") != 2, round_half_up(F.col("l_discount") * 500.0, 1)).alias("discount_percentage"),
        F.when(F.col("l_returnflag") == "R", "BUY_X_GET_Y").when(F.col("l_returnflag") == "A", "MEMBER_PRICE")
         .otherwise("DISCOUNT").alias("promotion_type"),
        F.when(F.col("l_linestatus") == "O", F.to_date("l_shipdate")).alias("end_date"),
        (F.lit(0.6) + F.col("l_discount") * 4.0).alias("confidence"))


def full_observations(t: Tables, *, crowd: bool = False) -> DataFrame:
    """Sightings that state any of the sixteen tracked fields; ``crowd`` gives a tenth of them to one identity, -1."""
    line, supplier, quantity = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_quantity").cast("int")
    price = round_half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    gift = F.col("l_returnflag") == "R"
    more = {
        "promo_price": F.when(~F.col("l_returnflag").isin("R", "A") & (F.col("l_tax") != 0.02), round_half_up(price * (F.lit(1.0) - F.col("l_discount")), 2)),
        "buy_quantity": F.when(gift, (2 + line % 2).cast("int")), "free_quantity": F.when(gift, F.lit(1)),
        "bundle_quantity": F.when(quantity % 10 == 0, (quantity / 10).cast("int")), "cashback_amount": F.when(quantity % 7 == 0, line * 1000.0),
        "voucher_amount": F.when(quantity % 11 == 0, line * 500.0), "minimum_purchase_amount": F.when(F.col("l_tax") == 0.06, line * 10000.0),
        "minimum_purchase_quantity": F.when(F.col("l_tax") == 0.07, line.cast("int")), "gift_description": F.when(quantity % 13 == 0, F.concat(F.lit("gift "), line)),
        "channel": F.when(supplier % 3 == 0, "ONLINE").when(supplier % 3 == 1, "IN_STORE"), "geography": F.when(supplier % 4 != 0, F.concat(F.lit("area "), supplier % 4)),
        "start_date": F.when(line != 5, F.trunc("l_shipdate", "month"))}
    plain = ["fold_key", "observation_id", "document_id", "observed_at", "source_id", "regular_price", "discount_percentage", "promotion_type", "end_date", "confidence"]
    lines = t.facts("lineitem")
    key = F.when(F.col("l_orderkey") % 10 == 0, F.lit(-1)).otherwise(F.col("l_partkey")) if crowd else F.col("l_partkey")
    known = {"document_id": F.col("l_orderkey"), "observed_at": F.col("l_shipdate"), "source_id": supplier, "observation_id": promotion_key(),
             "regular_price": F.when(F.col("l_tax") != 0.04, price), "discount_percentage": F.when(line != 2, round_half_up(F.col("l_discount") * 500.0, 1)),
             "promotion_type": F.when(gift, "BUY_X_GET_Y").when(F.col("l_returnflag") == "A", "MEMBER_PRICE").otherwise("DISCOUNT"),
             "end_date": F.when(F.col("l_linestatus") == "O", F.to_date("l_shipdate")), "confidence": F.lit(0.6) + F.col("l_discount") * 4.0, "fold_key": key}
    return lines.select(*[known[c].alias(c) for c in plain], *[c.alias(name) for name, c in more.items()])


def assert_promotion_key(t: Tables) -> None:
    """Loader check (runs a job): the six-column key must identify a promotion."""
    row = promotions(t, "promotion_id").groupBy("promotion_id").count().agg(count_if(F.col("count") > 1).alias("n")).first()
    if row["n"]:
        raise ValueError(f"{row['n']} promotion keys are not unique")
