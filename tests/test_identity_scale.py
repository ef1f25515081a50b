"""What the identity queries shuffle and keep, and that rows without a key or standing there twice get their due."""

import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import canonical as K
from shelfwise.operators.intervals import with_newest
from shelfwise.sources.staging import stage

STORED = "promotion_id string, fingerprint string, source_fingerprint string, start_date date, end_date date, last_seen_at int, product_id int, retailer_id int, status string"
A, B = date(2024, 1, 1), date(2024, 2, 1)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


def stored(spark):
    return spark.createDataFrame([("s1", "x", "c", A, B, 1, 1, 1, "ACTIVE"), ("s2", "y", "c", A, B, 2, 1, 1, "ACTIVE"), ("s3", None, None, None, None, 3, 1, 1, "ACTIVE"),
                                  ("s4", "z", "d", A, A, 4, 2, 1, "EXPIRED")], STORED)


def test_a_staged_frame_leaves_nothing_shuffled(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    before = files()
    assert len(stage(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count(), "test").collect()) == 10
    for _ in range(20):
        if files() <= before:
            return
        time.sleep(0.25)
    raise AssertionError("shuffled files are still there")


@pytest.mark.parametrize("few", [0, 1000])
def test_rows_keep_their_number(spark, few):
    pool = stored(spark).filter("source_fingerprint IS NOT NULL").selectExpr("source_fingerprint AS k", "start_date AS first", "end_date AS last", "struct(last_seen_at, promotion_id) AS newest")
    rows = spark.createDataFrame([(1, "c", A, None), (1, "c", A, None), (2, None, A, B), (3, "d", B, B), (4, "d", None, None)], "id int, k string, first date, last date")
    got = with_newest(rows, pool, ["k"], newest="newest", few=few, how="left").selectExpr("id", "newest.promotion_id AS p").collect()
    assert sorted((r.id, r.p or "") for r in got) == [(1, "s2"), (1, "s2"), (2, ""), (3, ""), (4, "s4")]
    assert sorted(r.id for r in with_newest(rows, pool, ["k"], newest="newest", few=few).collect()) == [1, 1, 4]


def test_lineage_shuffles_by_product_and_retailer_only(spark):
    new = stored(spark).withColumnRenamed("promotion_id", "item_id")
    found = K.lineage(new.withColumn("source_fingerprint", F.lit("other")), stored(spark))
    assert {(r.item_id, r.supersedes_id) for r in found.collect()} == {("s1", "s2"), ("s2", "s2"), ("s3", "s2")}
    assert exchanges(found) and not any("source_fingerprint" in e for e in exchanges(found))


def test_items_are_shuffled_by_their_fingerprints_only(spark):
    new = stored(spark).selectExpr("concat('i', promotion_id) AS item_id", "if(promotion_id = 's2', 'new', fingerprint) AS fingerprint", "source_fingerprint", "start_date", "end_date")
    found = K.match_identity(new.unionByName(new), stored(spark))
    assert sorted((r.item_id, r.promotion_id, r.match) for r in found.collect()) == sorted(2 * [("is1", "s1", "EXACT"), ("is2", "s2", "CAMPAIGN"), ("is3", None, "NEW"), ("is4", "s4", "EXACT")], key=lambda r: r[0])
    assert exchanges(found) and not any("first" in e or "start_date" in e for e in exchanges(found))


def test_field_observations_meet_by_one_key(spark):
    kind = "{} string, fingerprint string, source_fingerprint string, competitor_id int, retailer_id int, category string, promo_price double, regular_price double, start_date date, end_date date"
    old = spark.createDataFrame([("s1", "x", "c", None, 1, "WAFER", None, 5.0, A, None), ("s2", "y", "c", 1, 1, "WAFER", 1.0, 5.0, A, None), ("s3", "z", "c", 1, 1, "WAFER", 1.0, 5.0, A, None)], kind.format("promotion_id"))
    new = spark.createDataFrame([("a", "x", "q", 9, 9, "WAFER", None, 5.0, A, None), ("b", "n", "c", None, 1, "WAFER", None, 5.0, A, None), ("c", "n", "c", 1, 1, "WAFER", 1.0, 5.0, A, None),
                                 ("d", None, None, 1, 1, "WAFER", 1.0, 5.0, A, None), ("e", "x", "c", 1, 1, "WAFER", 1.0, 6.0, A, None)], kind.format("submission_id"))
    merged = K.merge_field_observations(new, old)
    assert {r.submission_id: (r.outcome, r.promotion_id) for r in merged.collect()} == {"a": ("MATCHED", "s1"), "b": ("MATCHED", "s1"), "c": ("CONFLICT", None), "d": ("NEW", None), "e": ("CONFLICT", None)}
    assert exchanges(merged) and not any(e.startswith("source_fingerprint#") for e in exchanges(merged))


def test_events_are_told_apart_by_short_keys(spark):
    event = lambda i: (f"{i:064x}", f"o{i}", datetime(2024, 1, 1))
    events = spark.createDataFrame([event(i) for i in range(6)] * 2, "fingerprint string, observation_id string, observed_at timestamp")
    fresh = K.new_events(events, events.filter("observation_id < 'o2'"))
    assert sorted(r.fingerprint for r in fresh.collect()) == [event(i)[0] for i in range(2, 6)] and fresh.columns == events.columns
    assert not any("fingerprint" in e for e in exchanges(fresh))
