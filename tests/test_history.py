import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import history as H


def log(rng, n, days):
    """A key with most of the rows, null keys, equal values in a row and equal times."""
    start = datetime(2024, 1, 1)
    return [(rng.choice([1, 1, 1, 1, 2, None]), start + timedelta(hours=rng.randint(0, 24 * days)), i, rng.choice([1.0, 1.0, 2.0, None])) for i in range(n)]


@pytest.mark.parametrize("days", [1, 9, 300])
def test_versions_against_brute_force(spark, days):
    rows = log(random.Random(days), 400, days)
    df = spark.createDataFrame(rows, "k int, recorded_at timestamp_ntz, id int, price double")
    got = sorted(((r.k, r.recorded_at, r.id, r.price, r.revision, r.known_until) for r in H.versions(df, ["k"], ["price"]).collect()), key=repr)
    want = []
    for key in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if not kept or kept[-1][3] != r[3] or r[3] is None != kept[-1][3] is None:
                kept.append(r)
        want += [(*r, i + 1, kept[i + 1][1] if i + 1 < len(kept) else None) for i, r in enumerate(kept)]
    assert got == sorted(want, key=repr)
    assert H.versions(df.limit(0), ["k"], ["price"]).count() == 0


def test_a_deleted_product_and_saves_without_change(spark):
    products = spark.createDataFrame([(1, 5.0, None), (2, 7.0, 6.0)], "own_id int, regular_price double, promo_price double")
    at = lambda day: datetime(2024, 1, day)
    saves = spark.createDataFrame([(1, at(2), 10, 5.0, None), (1, at(3), 11, 6.0, None), (1, at(3), 12, 6.0, 5.5)], "own_id int, recorded_at timestamp_ntz, id int, regular_price double, promo_price double")
    whole = H.own_price_log(products, saves, products.filter("own_id = 2"), baseline_at="2024-01-01 00:00:00", deleted_at="2024-02-01 00:00:00")
    got = [tuple(r) for r in H.own_price_history(whole).orderBy("own_id", "revision").collect()]
    end = datetime(2024, 2, 1)
    assert got == [(1, 1, "BASELINE", 5.0, None, at(1), at(3)), (1, 2, "UPDATE", 6.0, None, at(3), at(3)), (1, 3, "UPDATE", 6.0, 5.5, at(3), None),
                   (2, 1, "BASELINE", 7.0, 6.0, at(1), end), (2, 2, "DELETE", 7.0, 6.0, end, None)]


def test_places_count_over_spans(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    got = H.in_sequence(df, ["k"], ["id"], F.col("id"), F.floor(F.col("id") / 37))
    assert got.filter((F.col("place") != F.floor(F.col("id") / 2) + 1) | (F.col("places") != 500) | ~F.col("before").eqNullSafe(F.when(F.col("id") > 1, F.col("id") - 2))).count() == 0


def test_crowded_and_small_keys_are_ordered_alike(spark):
    """Small keys need no join with their spans; which keys go by spans changes nothing, null keys included."""
    rows = [(None if n % 5 == 0 else n % 5 if n % 2 else n, n // 3, n, n % 4) for n in range(400)]
    df = spark.createDataFrame(rows, "k int, day int, id int, v int")
    ask = lambda crowded: sorted(map(tuple, H.in_sequence(df, ["k"], ["id"], F.col("v"), F.col("day"), crowded=crowded).collect()), key=lambda r: r[2])
    many = H.crowded_keys(df, ["k"], few=20)
    assert many.count() == 5 and H.crowded_keys(df, ["k"], few=400) is None
    assert ask(None) == ask(many)
    plan = H.in_sequence(df, ["k"], ["id"], F.col("v"), F.col("day"))._jdf.queryExecution().toString()
    assert "Join" not in plan
