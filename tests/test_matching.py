import random
import re

import pytest
from pyspark.sql import functions as F

from shelfwise.functions.core import round_half_up
from shelfwise.operators import matching as M


def gap(a, b):
    import math
    return math.floor((a - b) / b * 100.0 * 10 + 0.5000001) / 10


@pytest.fixture(scope="module")
def market(spark):
    rng = random.Random(5)
    cats = ["WAFER", "SNACK"]
    own = [(i, f"S{i}", f"B{i % 3}", rng.choice(cats), float(rng.choice([50, 100, 149, 150, 300, 600])), rng.randint(900, 1100) / 1.0,
            rng.choice([None, rng.randint(800, 1000) / 1.0])) for i in range(25)]
    offers = [(f"p{i:03d}", rng.choice(cats), float(rng.choice([74, 75, 100, 150, 300, 601])), rng.randint(85000, 115000) / 100.0, f"k{rng.randint(0, 12)}", f"B{rng.randint(0, 4)}", f"C{i % 2}")
              for i in range(160)]
    verdicts = [(rng.randint(0, 24), f"k{rng.randint(0, 12)}", rng.random() < 0.4) for _ in range(40)]
    verdicts = list({(a, b): (a, b, c) for a, b, c in verdicts}.values())
    frames = (spark.createDataFrame(own, "own_id long, sku string, brand string, category string, grams double, own_unit double, own_promo_unit double"),
              spark.createDataFrame(offers, "promotion_id string, category string, grams double, unit double, offer_key string, brand string, competitor string"),
              spark.createDataFrame(verdicts, "own_id long, offer_key string, accepted boolean"))
    return own, offers, verdicts, frames


def brute(own, offers, verdicts, allowed=None):
    said = {(a, b): c for a, b, c in verdicts}
    out = {}
    for o in own:
        hits = [f for f in offers if f[1] == o[3] and 0.5 <= f[2] / o[4] <= 2.0 and said.get((o[0], f[4]), True)
                and (not allowed or o[2] not in allowed or f[5] in allowed[o[2]])]
        out[o[0]] = sorted(hits, key=lambda f: (f[3], f[0]))
    return out


def check(own, expected, rows):
    got = {r["own_id"]: r for r in rows}
    for o in own:
        hits, r = expected[o[0]], got[o[0]]
        assert r["matches"] == len(hits)
        assert r["undercuts"] == sum(gap(f[3], o[5]) < 0 for f in hits)
        assert r["cheapest_unit"] == (hits[0][3] if hits else None)
        if o[6] is not None:
            assert r["promo_undercuts"] == sum(gap(f[3], o[6]) < 0 for f in hits)
        if hits:
            assert abs(r["mean_unit"] - sum(f[3] for f in hits) / len(hits)) < 1e-6


def test_summary_equals_brute_force(market):
    own, offers, verdicts, (o, f, d) = market
    check(own, brute(own, offers, verdicts), M.match_summary(M.scope_own(o), M.scope_offers(f), d).collect())


def test_summary_with_brand_lists(spark, market):
    own, offers, verdicts, (o, f, d) = market
    allowed = {"B0": ["B1", "B2"], "B1": ["B4"]}
    table = spark.createDataFrame([(a, b) for a, bs in allowed.items() for b in bs], "brand string, allowed_brand string")
    rows = M.match_summary(M.scope_own(o, brand_map=table), M.scope_offers(f, by_brand=True), d).collect()
    check(own, brute(own, offers, verdicts, allowed), rows)


def test_top_matches_equal_brute_force(market):
    own, offers, verdicts, (o, f, d) = market
    got = {}
    for r in M.top_matches(M.scope_own(o), M.scope_offers(f), d, keep=5).collect():
        got.setdefault(r["own_id"], {})[r["position"]] = r["promotion_id"]
    for own_id, hits in brute(own, offers, verdicts).items():
        assert list(dict(sorted(got.get(own_id, {}).items())).values()) == [h[0] for h in hits[:5]]


def test_undercut_flags_equal_brute_force(market):
    own, offers, verdicts, (o, f, d) = market
    said = {(a, b): c for a, b, c in verdicts}
    got = {r["promotion_id"]: r["undercuts"] for r in M.undercut_flags(f, o, d, F.coalesce("own_promo_unit", "own_unit")).collect()}
    for p in offers:
        want = any(q[3] == p[1] and 0.5 <= p[2] / q[4] <= 2.0 and said.get((q[0], p[4]), True) and p[3] < (q[6] if q[6] is not None else q[5]) for q in own)
        assert got[p[0]] == want


def test_pack_ratio_bounds(spark):
    own = spark.createDataFrame([("*", "WAFER", 300.0)], "scope string, category string, grams double")
    offers = spark.createDataFrame([("*", "WAFER", float(g)) for g in (149, 150, 600, 601)], "scope string, category string, grams double")
    assert sorted(r["grams"] for r in M.band(own, offers).collect()) == [150.0, 600.0]


def test_undercut_ceiling_is_the_last_negative_gap(spark):
    df = spark.range(1, 4000).select((F.col("id") * 7.31).alias("raw")).select(round_half_up(F.col("raw"), 2).alias("own"))
    rows = df.select("own", M.undercut_ceiling("own").alias("cap")).collect()
    for r in rows:
        cents = round(r["cap"] * 100)
        assert gap(cents / 100.0, r["own"]) < 0 <= gap((cents + 1) / 100.0, r["own"])


def test_all_undercuts_against_brute_force(market):
    own, offers, verdicts, (o, f, d) = market
    want = {(i, f[0]) for i, hits in brute(own, offers, verdicts).items() for f in hits for p in own if p[0] == i and gap(f[3], p[5]) <= -5.0}
    assert len(want) > 5 * len({i for i, _ in want})  # more than a shortlist
    for rows in (4096, 1):
        got = M.undercut_offers(M.scope_own(o), M.scope_offers(f), d, gap=-5.0, block_rows=rows)
        pairs = [(r.own_id, r.promotion_id) for r in got.collect()]
        assert set(pairs) == want and len(pairs) == len(want)


def test_undercuts_with_allowed_brands_and_without_rows(market, spark):
    own, offers, verdicts, (o, f, d) = market
    allowed = {"B0": {"B1", "B2"}, "B1": {"B1"}}
    brands = spark.createDataFrame([(b, a) for b, many in allowed.items() for a in many], "brand string, allowed_brand string")
    want = {(i, x[0]) for i, hits in brute(own, offers, verdicts, allowed).items() for x in hits for p in own if p[0] == i and gap(x[3], p[5]) <= -5.0}
    got = M.undercut_offers(M.scope_own(o, brand_map=brands), M.scope_offers(f, by_brand=True), d, gap=-5.0)
    assert {(r.own_id, r.promotion_id) for r in got.collect()} == want
    assert M.undercut_offers(M.scope_own(o), M.scope_offers(f.limit(0)), d, gap=-5.0).count() == 0


def test_plans_do_not_grow_with_the_classes_of_rejections(market, spark, capsys):
    """Each class of rejection counts (1, 2, 4, ... of a product) was a branch of its own; the driver keeps every version of a plan."""
    own, offers, _, (o, f, _) = market
    many = [(i, f"k{k}", False) for i in range(5) for k in range([1, 2, 4, 8, 12][i])]
    sizes = []
    for verdicts in ([(0, "k0", False)], many):
        d = spark.createDataFrame(verdicts, "own_id long, offer_key string, accepted boolean")
        found = M.match_summary(M.scope_own(o), M.scope_offers(f), d)
        check(own, brute(own, offers, verdicts), found.collect())
        best = M.top_matches(M.scope_own(o), M.scope_offers(f), d, keep=3)
        want = {(i, p + 1, x[0]) for i, hits in brute(own, offers, verdicts).items() for p, x in enumerate(hits[:3])}
        assert {(r.own_id, r.position, r.promotion_id) for r in best.collect()} == want
        capsys.readouterr()
        found.explain()
        best.explain()
        text = capsys.readouterr().out
        sizes.append((text.count("Join"), text.count("FileScan")))
    assert sizes[0] == sizes[1]


def test_undercuts_of_single_rows_are_not_shuffled_again(market, capsys):
    """Pairs of products and offers that stand there once need no dropDuplicates; those of repeated ones are still told apart."""
    own, offers, verdicts, (o, f, d) = market
    want = sorted((i, x[0]) for i, hits in brute(own, offers, verdicts).items() for x in hits for p in own if p[0] == i and gap(x[3], p[5]) <= -5.0)
    single = M.undercut_offers(M.scope_own(o), M.scope_offers(f), d, gap=-5.0)
    single.explain(True)
    assert not re.search(r"Deduplicate \[own_id#\w+, promotion_id#", capsys.readouterr().out)
    dearer = o.filter("own_id < 9").withColumn("own_unit", F.col("own_unit") * 0.999)
    for a, b in ((o, f.unionByName(f.filter("promotion_id < 'p080'"))), (o.unionByName(dearer), f), (o.unionByName(o), f.unionByName(f))):
        got = [(r.own_id, r.promotion_id) for r in M.undercut_offers(M.scope_own(a), M.scope_offers(b), d, gap=-5.0).collect()]
        assert len(got) == len(set(got)) and set(got) >= set(want)
    assert sorted((r.own_id, r.promotion_id) for r in single.collect()) == want
