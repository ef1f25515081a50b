import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import canonical as K

FIELDS = ["promo_price", "promotion_type"]


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(11)
    rows = []
    for key in range(12):
        now = datetime(2024, 1, 1)
        for n in range(25):
            now += timedelta(days=rng.choice([0, 1, 2, 3, 12]), hours=rng.randint(1, 5))
            rows.append((key, f"{key}-{n:03d}", now, rng.choice([1, 2, 3, None]), 0.9, rng.choice([None, 100.0, 100.5, 120.0]), rng.choice(["DISCOUNT", "BUNDLE"])))
    obs = spark.createDataFrame(rows, "fold_key int, observation_id string, observed_at timestamp_ntz, source_id int, confidence double, promo_price double, promotion_type string")
    trust = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.6)], "source_id int, reliability_score double")
    return rows, obs, trust


def sequential(rows):
    trust, out, state = {1: 0.9, 2: 0.8, 3: 0.6, None: 0.85}, {}, {}
    for key, oid, now, src, _, price, kind in rows:
        new, cur = [price, kind], state.get(key)
        if cur is None:
            state[key] = dict(v=list(new), s=src, r=trust[src] if src else 0.85, t=now)
            out[oid] = "APPLY"
            continue
        diff = [(i, cur["v"][i], v) for i, v in enumerate(new) if v is not None and v != cur["v"][i]]
        material = any(i == 1 or (a is not None and abs(a - b) / abs(a) > 0.01) for i, a, b in diff)
        gap = trust[src] - cur["r"]
        if not material or cur["s"] is None or src is None or src == cur["s"] or now - cur["t"] > timedelta(days=7) or gap >= 0.15:
            verdict = "APPLY"
            cur["v"] = [a if b is None else b for a, b in zip(cur["v"], new)]
            cur["t"] = max(cur["t"], now)
            if src is not None:
                cur["s"], cur["r"] = src, trust[src]
        else:
            verdict = "KEEP" if gap <= -0.15 else "REVIEW"
        out[oid] = verdict
    return out, state


def test_fold_equals_a_plain_loop(history):
    rows, obs, trust = history
    verdicts, state = sequential(rows)
    folded = K.fold_observations(obs, trust, FIELDS)
    assert {r["observation_id"]: r["verdict"] for r in folded.collect()} == verdicts
    got = {r["fold_key"]: r for r in K.canonical_state(folded, FIELDS).collect()}
    for key, want in state.items():
        assert [got[key][f] for f in FIELDS] == want["v"] and got[key]["last_verified_at"] == want["t"]


@pytest.mark.parametrize("piece_rows", [1, 4])
def test_pieces_fold_from_guessed_starts(history, piece_rows):
    rows, obs, trust = history
    verdicts, state = sequential(rows)
    folded = K.fold_observations(obs, trust, FIELDS, piece_rows=piece_rows)
    assert folded.select("segment").distinct().count() > 5
    assert {r["observation_id"]: r["verdict"] for r in folded.collect()} == verdicts
    got = {r["fold_key"]: r for r in K.canonical_state(folded, FIELDS).collect()}
    assert all([got[key][f] for f in FIELDS] == want["v"] and got[key]["last_verified_at"] == want["t"] for key, want in state.items())
    assert folded.filter("created").count() == 12
    whole = K.fold_observations(obs, trust, FIELDS)
    assert whole.drop("segment").exceptAll(folded.drop("segment")).count() == 0
    events = K.change_rows(folded)
    assert events.count() == events.select("fingerprint").distinct().count()


def test_reviews_hold_both_values(history):
    rows, obs, trust = history
    verdicts, _ = sequential(rows)
    found = K.conflict_reviews(K.fold_observations(obs, trust, FIELDS)).collect()
    offered = {r[1]: r for r in rows}
    assert {r["observation_id"] for r in found} == {i for i, v in verdicts.items() if v == "REVIEW"}
    assert all(str(offered[r["observation_id"]][5 + FIELDS.index(r["field"])]) == r["new_value"] != r["current_value"] for r in found)
    assert all(r["new_source_id"] == offered[r["observation_id"]][3] != r["current_source_id"] and r["field"] in r["reason"] for r in found)


def test_repeats_change_nothing(history):
    _, obs, trust = history
    once = K.canonical_state(K.fold_observations(obs, trust, FIELDS), FIELDS)
    twice = K.canonical_state(K.fold_observations(obs.unionByName(obs), trust, FIELDS), FIELDS)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_known_events_are_not_emitted_again(history):
    _, obs, trust = history
    events = K.change_rows(K.fold_observations(obs, trust, FIELDS))
    assert K.new_events(events, events).count() == 0


def test_events_read_the_fold_once(history, capsys):
    """The fold is Python work; a union of two branches ran it twice."""
    _, obs, trust = history
    folded = K.fold_observations(obs, trust, FIELDS)
    events = K.change_rows(folded)
    events.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    want = {(r.observation_id, None, "CREATED", 0.0) for r in folded.filter("created").collect()}
    want |= {(r.observation_id, c.field, "CHANGED", None) for r in folded.collect() for c in r.changed}
    got = {(r.observation_id, r.field, r.event_type if r.field is None else "CHANGED", r.change_impact if r.field is None else None) for r in events.collect()}
    assert got == want


def test_material_rules(spark):
    rows = [("promo_price", "100", "100.5"), ("promo_price", "100", "102"), ("discount_percentage", "20", "20.5"), ("discount_percentage", "20", "21"),
            ("end_date", None, "2024-01-01"), ("channel", "a", "b"), ("promo_price", None, "5")]
    df = spark.createDataFrame(rows, "field string, previous string, current string")
    assert [r["m"] for r in df.select(K.is_material(F.col("field"), F.col("previous"), F.col("current")).alias("m")).collect()] == [False, True, False, True, True, False, False]


@pytest.mark.parametrize("stretch_rows", [40, 1_000_000])
def test_pieces_that_never_agree_take_no_round_each(spark, monkeypatch, stretch_rows):
    """One identity, many sources: guesses are wrong all along, which took a round of jobs for each of some hundred pieces."""
    rows = [(1, f"{n:04d}", datetime(2024, 1, 1) + timedelta(hours=9 * n), n % 97, 0.9, 100.0 + 7 * (n % 13), "DISCOUNT") for n in range(300)]
    obs = spark.createDataFrame(rows, "fold_key int, observation_id string, observed_at timestamp_ntz, source_id int, confidence double, promo_price double, promotion_type string")
    trust = spark.createDataFrame([(n, 0.6 + (n % 8) * 0.05) for n in range(97)], "source_id int, reliability_score double")
    want = {r["observation_id"]: tuple(r) for r in K.fold_observations(obs, trust, FIELDS).drop("segment").collect()}
    staged, stage = [], K.stage
    monkeypatch.setattr(K, "stage", lambda df, name="frame": staged.append(name) or stage(df, name))
    folded = K.fold_observations(obs.unionByName(obs), trust, FIELDS, piece_rows=4, stretch_rows=stretch_rows)
    assert {r["observation_id"]: tuple(r) for r in folded.drop("segment").collect()} == want and folded.count() == 300
    assert folded.select("segment").distinct().count() > 60 and staged.count("checked") <= max(1, 600 // stretch_rows + 1)


def test_a_source_with_two_entries_counts_with_both(history):
    """Short and long histories alike: a repeated sighting counts once, one of a repeated source twice."""
    rows, obs, trust = history
    both = trust.unionByName(trust.filter("source_id = 2"))
    want = sorted([r[1] for r in rows] + [r[1] for r in rows if r[3] == 2])
    for piece_rows in (4, 2_000):
        folded = K.fold_observations(obs.unionByName(obs), both, FIELDS, piece_rows=piece_rows)
        assert sorted(r["observation_id"] for r in folded.collect()) == want
