from shelfwise.operators import resolution as RES


def test_text_ids_are_carried(spark):
    shops = spark.createDataFrame([("u-1", "Alpha Mart"), ("u-2", "Beta Store")], "retailer_id string, name string")
    aliases = spark.createDataFrame([("alphamini", "u-1", 0.9)], "norm string, alias_entity_id string, alias_confidence double")
    items = spark.createDataFrame([(1, "ALPHA mart"), (2, "alpha-mini"), (3, "nothing like it"), (4, None)], "item_id int, retailer_text string")
    got = {r.item_id: (r.status, r.entity_id) for r in RES.resolve_retailers(items, shops, aliases).collect()}
    assert got[1] == ("RESOLVED", "u-1") and got[2] == ("RESOLVED", "u-1") and got[3][0] == "UNRESOLVED" and got[4] == ("UNRESOLVED", None)


def test_text_and_large_brand_ids_scope_products(spark):
    for kind, brand in (("string", "b-9"), ("bigint", 3_000_000_000)):
        products = spark.createDataFrame([("p-1", brand, "Wafer Coklat", None, None, "100g")], f"product_id string, brand_id {kind}, name string, sku string, barcode string, pack_label string")
        aliases = spark.createDataFrame([], "norm string, alias_entity_id string, alias_confidence double")
        items = spark.createDataFrame([(1, "wafer coklat", brand, None, None, None), (2, "wafer coklatt", brand, None, None, None)],
                                      f"item_id int, product_text string, brand_id {kind}, sku string, barcode string, pack_size string")
        got = {r.item_id: (r.status, r.entity_id, r.candidate_id) for r in RES.resolve_products(items, products, aliases).collect()}
        assert got[1] == ("RESOLVED", "p-1", None) and "p-1" in got[2]
