import random
from datetime import date, timedelta

import pytest

from shelfwise.operators import canonical as K
from shelfwise.operators.intervals import newest_overlapping


def compatible(a, b):
    (s1, e1), (s2, e2) = a, b
    return s1 is None or s2 is None or max(s1, s2) <= min(e1 or s1, e2 or s2)


def periods(rng, n, spread):
    rows = []
    for _ in range(n):
        start = rng.choice([None] + [date(2024, 1, 1) + timedelta(days=rng.randint(-spread, spread))] * 9)
        end = rng.choice([None, start and start + timedelta(days=rng.choice([0, 1, 5, 40, 300, -3]))])
        rows.append((rng.randint(0, 2), f"c{rng.randint(0, 3)}", start, end))
    return rows


@pytest.mark.parametrize("other", [None, "campaign"])
@pytest.mark.parametrize("few", [0, 1000])
def test_newest_overlapping_against_all_pairs(spark, other, few):
    rng = random.Random(few + bool(other))
    stored = [(*p, rng.randint(0, 50), i) for i, p in enumerate(periods(rng, 120, 200))]
    asked = periods(rng, 80, 500)
    s = spark.createDataFrame(stored, "k int, campaign string, first date, last date, at int, id int").selectExpr("k", "campaign", "first", "last", "struct(at, id) AS newest")
    a = spark.createDataFrame(asked, "k int, campaign string, first date, last date")
    got = {(r.k, r["campaign"] if other else None, r["first"], r["last"]): tuple(r.newest) for r in newest_overlapping(a, s, ["k"], newest="newest", other=other, few=few).collect()}
    want = {}
    for k, c, first, last in asked:
        hits = [(at, i) for k2, c2, s2, e2, at, i in stored if k2 == k and compatible((first, last), (s2, e2)) and not (other and c2 == c)]
        if hits:
            want[k, c if other else None, first, last] = max(hits)
    assert got == want
    assert newest_overlapping(a, s.limit(0), ["k"], newest="newest", other=other, few=few).count() == 0


def test_supersede_marks_once_and_names_the_earliest(spark):
    rows = [("old", 1, 1, "a", date(2024, 1, 1), date(2024, 1, 31), "ACTIVE", 5), ("gone", 1, 1, "b", date(2024, 1, 1), None, "EXPIRED", 9), ("far", 2, 1, "a", date(2024, 1, 1), None, "ACTIVE", 1)]
    stored = spark.createDataFrame(rows, "promotion_id string, product_id int, retailer_id int, source_fingerprint string, start_date date, end_date date, status string, last_seen_at int")
    new = spark.createDataFrame([("n2", 1, 1, "c", date(2024, 1, 20), None, "o2", 20), ("n1", 1, 1, "d", date(2024, 1, 10), date(2024, 2, 1), "o1", 10), ("same", 1, 1, "a", date(2024, 1, 2), None, "o3", 1), ("none", None, 1, "z", None, None, "o4", 1)],
                                "item_id string, product_id int, retailer_id int, source_fingerprint string, start_date date, end_date date, observation_id string, observed_at int")
    marked, events = K.supersede(stored, new)
    assert {r.promotion_id: (r.status, r.superseded_by) for r in marked.collect()} == {"old": ("SUPERSEDED", "n1"), "gone": ("EXPIRED", None), "far": ("ACTIVE", None)}
    (event,) = events.collect()
    assert (event.promotion_id, event.observation_id, event.event_type, event.current) == ("old", "o1", "SUPERSEDED", '{"superseded_by_promotion_id":"n1"}')
    assert K.new_events(events, events).count() == 0


def test_many_periods_of_the_same_days_are_few_in_the_tree(spark, monkeypatch):
    """All share a key and two pairs of days; each left its moment at the tree's places before, and each asked there."""
    from shelfwise.operators import intervals as I
    stored = spark.range(600).selectExpr("1 AS k", "concat('c', id % 300) AS campaign", "date'2024-01-01' + cast(id % 2 AS int) AS first", "date'2024-02-01' AS last", "id AS newest")
    sizes, best_two = [], I._best_two
    monkeypatch.setattr(I, "_best_two", lambda rows, by, other, newest: sizes.append((by[-1], rows.count())) or best_two(rows, by, other, newest))
    got = I.newest_overlapping(stored.drop("newest"), stored, ["k"], newest="newest", other="campaign", few=5)
    found = {(r["campaign"], r["first"].day): r["newest"] for r in got.collect()}
    assert found == {(f"c{n}", 1 + n % 2): 598 if n == 299 else 599 for n in range(300)}
    assert all(n < 600 for by, n in sizes[1:])
