from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import campaigns, dates, geo, price, text


def test_pack_grams(evaluate):
    cases = {"300g": 300.0, "1,5 kg": 1500.0, "12x25g": 300.0, "12 X 25 gr": 300.0, "0.25 kilogram": 250.0, "6 pcs": None, "": None, "300 ml": None, "0 g": None}
    assert evaluate(text.pack_grams, list(cases)) == list(cases.values())
    assert evaluate(text.pack_grams, [None]) == [None]


def test_import_and_extracted_price(evaluate):
    cases = {"12500": 12500.0, "12.500": 12500.0, "Rp 12.500,50": 12500.5, "12,5": 12.5, "idr 1.234.567": 1234567.0, "0": None, "99999999": None, "abc": None, "": None}
    assert evaluate(text.import_price, list(cases)) == list(cases.values())
    assert evaluate(text.extracted_price, ["0", "Rp 14.500", "14500.0", "-5", "100000000"]) == [0.0, 14500.0, 14500.0, None, None]


def test_pack_from_name(evaluate):
    assert evaluate(text.pack_from_name, ["Wafer Cokelat 110g", "Biskuit 12 x 25g isi", "Susu 250 ml", "Polos"]) == ["110g", "12 x 25g", "250 ml", None]


def test_family_name(evaluate):
    assert evaluate(text.family_name, ["Promo Roma Kelapa 300g", "Roma, Kelapa 12x25 g kemasan baru"]) == ["roma kelapa", "roma kelapa"]


def test_trigram_similarity(spark):
    row = spark.range(1).select(text.similarity(text.trigrams(F.lit("indomaret")), text.trigrams(F.lit("indomart"))).alias("s")).first()
    assert round(row["s"], 3) == 0.583


def test_canonical_url(evaluate):
    got = evaluate(text.canonical_url, ["HTTPS://Shop.Example/A?b=1#c", "http://X.example", "http://x.example/p?"])
    assert got == ["https://shop.example/A?b=1", "http://x.example/", "http://x.example/p"]


def test_formula_guard(evaluate):
    assert evaluate(text.guard_formula, ["=1+1", "+a", "-a", "@x", "ok", ""]) == ["'=1+1", "'+a", "'-a", "'@x", "ok", ""]


def test_region(evaluate):
    cases = {"Jawa Barat": "JAWA", "Seluruh Indonesia": "NATIONAL", "Jakarta dan Bandung": "JABODETABEK", "Semua kecuali Papua": "UNMAPPED", "Toko tertentu": "STORE_SPECIFIC",
             "Sumatera, Bali": "MULTI_REGION", "Seluruh Indonesia, online": "ONLINE", "balikpapan": "KALIMANTAN", "somewhere": "UNMAPPED", "  ": "UNKNOWN"}
    assert evaluate(geo.region_code, list(cases)) == list(cases.values())
    assert evaluate(geo.geography_key, ["Jawa", "Toko  Tertentu", "", None]) == ["JAWA", "STORE_SPECIFIC:toko tertentu", None, None]


def test_channels(evaluate):
    assert evaluate(geo.channel_of, ["minimarket", "E-COMMERCE", "general_trade", "kiosk", None]) == ["Modern Trade", "E-commerce", "General Trade", None, None]


@pytest.mark.parametrize("wording, starts, ends", [
    ("12 - 14 Mei 2026", (2026, 5, 12), (2026, 5, 14)), ("28 Oktober - 3 November 2026", (2026, 10, 28), (2026, 11, 3)),
    ("28 Des - 3 Jan 2026", (2025, 12, 28), (2026, 1, 3)), ("28 Des - 3 Jan", (2024, 12, 28), (2025, 1, 3)), ("28 Des 2025 - 05 Jan 2026", (2025, 12, 28), (2026, 1, 5)),
    ("01 s/d 15 Maret 2026", (2026, 3, 1), (2026, 3, 15)), ("s/d 15 Mei 2026", None, (2026, 5, 15)), ("12/05/2026 - 14/05/2026", (2026, 5, 12), (2026, 5, 14)),
    ("Periode: 12 - 14 Mei 2026", (2026, 5, 12), (2026, 5, 14)), ("Week 1 (1 - 7 Nov 2026)", (2026, 11, 1), (2026, 11, 7)),
    ("Periode 2 Minggu (1 - 14 Mei 2026)", (2026, 5, 1), (2026, 5, 14)), ("Berlaku 2 minggu mulai 1 Mei 2026", (2026, 5, 1), (2026, 5, 14)),
    ("Berlaku 3 hari sejak 12 Mei 2026", (2026, 5, 12), (2026, 5, 14)), ("12 January 2026", (2026, 1, 12), (2026, 1, 12)), ("(12 - 14 Mei 2026)", (2026, 5, 12), (2026, 5, 14)),
])
def test_ranges(evaluate, wording, starts, ends):
    got = evaluate(lambda c: dates.parse_local_range(c, 2024), [wording])[0]
    assert (got["starts"], got["ends"]) == (date(*starts) if starts else None, date(*ends))


def test_unreadable_dates(evaluate):
    assert evaluate(lambda c: dates.parse_local_range(c, 2024), ["katalog", "31 Februari 2026", None, "12"]) == [None] * 4
    got = evaluate(lambda c: dates.parse_local_date(c, 2024), ["12 Mei", "12-Mei-'26", "2026-05-12T10:00", "31/02/2026", "tgl 5/6/26"])
    assert got == [date(2024, 5, 12), date(2026, 5, 12), date(2026, 5, 12), None, date(2026, 6, 5)]


def test_economics(spark):
    rows = [(10000.0, None, 20.0, "DISCOUNT", None, None), (9000.0, None, None, "BUY_X_GET_Y", 2, 1), (None, 8000.0, 20.0, "DISCOUNT", None, None), (9000.0, None, None, "DISCOUNT", None, None)]
    df = spark.createDataFrame(rows, "regular_price double, promo_price double, discount_percentage double, promotion_type string, buy_quantity int, free_quantity int")
    got = df.select(price.effective_pack_price().alias("p"), price.regular_pack_price().alias("r")).collect()
    assert [(g["p"], g["r"]) for g in got] == [(8000.0, 10000.0), (6000.0, 9000.0), (8000.0, 10000.0), (None, 9000.0)]
    one = spark.range(1).select(price.per_100g(F.lit(7000.0), F.lit(300.0)).alias("u"), price.gap_pct(F.lit(75.0), F.lit(100.0)).alias("g"), price.per_100g(F.lit(1.0), F.lit(0.0)).alias("z")).first()
    assert (one["u"], one["g"], one["z"]) == (2333.33, -25.0, None)


def test_campaigns(spark):
    df = spark.createDataFrame([("Biskuit kaleng lebaran gopay", "DISCOUNT"), ("Wafer", "BUY_X_GET_Y"), ("pointless", "MEMBER_PRICE")], "v string, m string")
    got = [r["c"] for r in df.select(campaigns.campaign_codes("v", "m").alias("c")).collect()]
    assert got == [["RAMADHAN_LEBARAN", "CASHBACK_EWALLET"], ["BOGO"], ["MEMBER_SPECIAL"]]


def test_long_wordings_stay_whole(evaluate):
    shared = "toko tertentu " + "x" * 300
    one, other = evaluate(geo.geography_key, [shared + " a", shared + " b"])
    assert one != other and one.endswith(" a")


def test_average_discount_keeps_its_decimals(spark):
    from pyspark.sql import functions as F
    from shelfwise.functions.core import exact_avg, round_half_up
    df = spark.createDataFrame([(33.33,), (33.33,), (33.34,), (66.65,)], "v double")
    assert df.select(round_half_up(exact_avg(F.col("v"), 4), 2)).first()[0] == 41.66
