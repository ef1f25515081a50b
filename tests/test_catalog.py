"""A slice of the catalogue against DuckDB on the smallest data folder; tools/check.py runs all of it."""

import os

import pytest

from shelfwise.catalog import load
from tools.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
BOOK = load()
SAMPLE = ["top10_live", "gate_failures", "lifecycle_sweep", "own_offer_matches", "own_offer_top5", "breakdown_grouping_sets", "simulate_scenarios", "regional_products", "shrinkflation",
          "bi_feed", "validation_split", "product_resolution", "identity_match", "canonical_fold", "alert_episodes", "extraction_quality", "stream_fold_counts", "retention_totals"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, con, name):
    line = compare(spark, con, FOLDER, name, BOOK.queries[name], BOOK.oracles[name])
    assert line.startswith("ok"), line


def test_oracles_belong_to_queries():
    assert set(BOOK.oracles) <= set(BOOK.queries) and len(BOOK.queries) > 120


def test_gates_and_filter_are_one_definition(spark):
    from shelfwise.catalog.q_live import gated, live
    from shelfwise.sources.tables import Tables
    t = Tables(spark, FOLDER)
    shown = {r["promotion_id"] for r in gated(t).filter("is_live").select("promotion_id").collect()}
    assert shown == {r["promotion_id"] for r in live(t).select("promotion_id").collect()}


def test_promotion_key_is_unique(spark):
    from shelfwise.sources.tables import Tables
    from shelfwise.sources.views import assert_promotion_key
    assert_promotion_key(Tables(spark, FOLDER))


def test_csv_round_trip(spark, tmp_path):
    from shelfwise.sources.imports import parse_catalogue, read_catalogue_csv, upsert
    from shelfwise.sources.sinks import write_csv
    df = spark.createDataFrame([("=Wafer", 12500.0, "A1"), ("Roma", 9000.0, "A2")], "name string, regular_price double, sku string")
    write_csv(df, str(tmp_path / "out"))
    text = "".join(p.read_text("utf-8") for p in (tmp_path / "out").glob("*.csv"))
    assert "﻿name" in text and "'=Wafer" in text
    (tmp_path / "in.csv").write_text("Name, Regular_Price ,sku,category\nWafer,Rp 12.500,A1,wafer\nRoma,0,A2,\n")
    parsed = parse_catalogue(read_catalogue_csv(spark, str(tmp_path / "in.csv")))
    stock = spark.createDataFrame([(1, "A1", "Old", 100.0)], "own_id long, sku string, name string, regular_price double")
    assert {r["operation"] for r in upsert(parsed, stock).collect()} == {"kept"}
    assert {(r["operation"], r["name"], r["regular_price"]) for r in upsert(parsed.filter("error is null"), stock).collect()} == {("updated", "Wafer", 12500.0)}
