from shelfwise.functions import dates as D


def test_texts_that_begin_with_no_date_skip_its_shapes(spark, evaluate):
    """Every candidate text went through all patterns of a single date before; now one look tells."""
    texts = ["Promo Susu berlaku 05/06/1998", "s/d  12 Mei 2026", "\t12  Mei\n2026 ", "tanggal 2026-05-12", "sampai", "maks. 3/4", "berlaku 1 - 7 Juni 2000", "sd.5/6/26", "- 5/6/26", None]
    got = evaluate(lambda c: D.parse_local_date(c, 2024).cast("string"), texts)
    assert got == [None, "2026-05-12", "2026-05-12", "2026-05-12", None, None, None, None, None, None]
    ranges = evaluate(lambda c: D.parse_local_range(c, 2024)["ends"].cast("string"), texts)
    assert ranges == [None, "2026-05-12", "2026-05-12", "2026-05-12", None, None, "2000-06-07", None, None, None]
    plan = spark.range(1).selectExpr("'x' AS v").select(D.parse_local_date("v", 2024))._jdf.queryExecution().analyzed().toString()
    assert D._BEGINS in plan
