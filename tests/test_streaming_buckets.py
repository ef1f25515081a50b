from datetime import datetime, timedelta

from shelfwise.operators.canonical import FoldState
from shelfwise.streaming import jobs as J


def test_identities_dealt_to_buckets_fold_as_alone(spark):
    """Five micro-batches, more identities than buckets, one without a key, and one whose key a float cannot hold."""
    start, big = datetime(2024, 1, 1), 2**60 + 1
    keys = [None, big, big + 1, *range(9)]
    rows = [(k, f"{n}-{i:02d}", start + timedelta(days=i * (1 + n % 3)), (n + i) % 3 if i % 5 else None, 0.85, float(100 + (i * 7) % 5 * 10)) for n, k in enumerate(keys) for i in range(10)]
    obs = spark.createDataFrame(rows, "fold_key long, observation_id string, observed_at timestamp, source_id long, reliability double, regular_price double")
    out = J.run_to_table(J.canonical_stream(J.paced(obs, "observed_at", 5), ["regular_price"], buckets=4), "fold")
    got = {r.observation_id: (r.fold_key, r.verdict) for r in out.collect()}
    assert len(got) == len(rows) and out.schema["fold_key"].dataType.simpleString() == "bigint"
    for k in keys:
        state = FoldState(1)
        for r in rows:
            if r[0] == k:
                assert got[r[1]] == (k, state.step(["regular_price"], [r[5]], r[3], r[4], r[2])[0])
