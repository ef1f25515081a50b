from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shelfwise.config import DEFAULT_RELIABILITY
from shelfwise.operators.canonical import FoldState
from shelfwise.streaming import jobs as J

DAY = timedelta(days=1)


def test_pages_over_several_batches(spark):
    start = datetime(2024, 1, 1)
    rows = [("u", i, "a" if i % 4 else "b", start + i * DAY) for i in range(20)] + [("v", 100 + i, "same", start + 2 * i * DAY) for i in range(10)]
    pages = spark.createDataFrame(rows, "url string, document_id long, content_hash string, ts timestamp")
    got = {r.document_id: (r.unchanged, r.late) for r in J.run_to_table(J.unchanged_pages(J.paced(pages, "ts", 4)), "pages").collect()}
    for url in "uv":
        own = [r for r in rows if r[0] == url]
        assert [got[r[1]] for r in own] == [(i > 0 and r[2] == own[i - 1][2], False) for i, r in enumerate(own)]


def test_fold_with_text_sources_over_several_batches(spark):
    start = datetime(2024, 1, 1)
    rows = [(k, f"{k}-{i:02d}", start + i * DAY * (1 + k), f"shop {i % 3}", 0.85, float(100 + (i * 7) % 5 * 10)) for k in range(3) for i in range(12)]
    obs = spark.createDataFrame(rows, "fold_key long, observation_id string, observed_at timestamp, source_id string, reliability double, regular_price double")
    got = {r.observation_id: r.verdict for r in J.run_to_table(J.canonical_stream(J.paced(obs, "observed_at", 3), ["regular_price"]), "fold").collect()}
    for k in range(3):
        state = FoldState(1)
        for r in rows:
            if r[0] == k:
                assert got[r[1]] == state.step(["regular_price"], [r[5]], r[3], r[4], r[2])[0]


def test_sweep_replays_and_torn_batches(spark, tmp_path):
    promotions = spark.createDataFrame([(f"p{i}", datetime(2024, 1, 1 + i), "ACTIVE" if i % 5 else "EXPIRED") for i in range(20)], "promotion_id string, end_date timestamp_ntz, status string")
    ledger = J.Ledger(spark, str(tmp_path), "promotion_id string, expired_at timestamp_ntz")
    sweep = J.expire_at_ticks(ledger, lambda: promotions)
    tick = lambda day: spark.createDataFrame([(datetime(2024, 1, day),), (datetime(2024, 1, 1),)], "ts timestamp_ntz")
    sweep(tick(6), 0)
    # Batch 1 wrote its rows and stopped before it was entered.
    promotions.limit(3).select("promotion_id", F.lit(None).cast("timestamp_ntz").alias("expired_at")).write.parquet(f"{tmp_path}/table/batch=1")
    sweep(tick(11), 1)
    sweep(tick(20), 1)
    sweep(tick(6), 0)
    got = sorted((r.promotion_id, r.expired_at.day) for r in ledger.rows().collect())
    assert got == sorted((f"p{i}", 6 if i < 5 else 11) for i in range(10) if i % 5)


def test_sources_go_stale_without_a_row_and_recover(spark):
    start = datetime(2024, 1, 1)
    days = {1: [(d, True) for d in range(30)], 2: [(0, True), (2, False), (4, False), (5, False), (9, True), (29, True)], 3: [(1, True)], 4: [(8, False), (20, False)]}
    rows = [(k, start + d * DAY, ok) for k, own in days.items() for d, ok in own]
    checks = spark.createDataFrame(rows, "source_id long, ts timestamp, ok boolean")
    got = J.run_to_table(J.stale_episodes(J.paced(checks, "ts", 5)), "stale").collect()
    day = lambda ts: (ts - start).days
    assert sorted((r.source_id, r.kind, day(r.last_success), day(r.at)) for r in got) == [
        (2, "SOURCE_RECOVERED", 0, 9), (2, "SOURCE_RECOVERED", 9, 29), (2, "SOURCE_STALE", 0, 3), (2, "SOURCE_STALE", 9, 12), (3, "SOURCE_STALE", 1, 4)]


def test_a_piece_is_written_by_the_tasks_that_read_it(spark):
    """One task wrote a whole piece before; a piece is still one micro-batch, also where most tasks hold none of its rows."""
    from datetime import datetime, timedelta
    from pathlib import Path
    rows = [(n, datetime(2024, 1, 1) + timedelta(hours=n)) for n in range(240)]
    df = spark.createDataFrame(rows, "id int, ts timestamp").repartitionByRange(4, "id")
    paced = J.paced(df, "ts", 3)
    seen = []
    paced.writeStream.foreachBatch(lambda batch, _: seen.append((batch.rdd.getNumPartitions(), sorted(r["id"] for r in batch.collect())))).trigger(availableNow=True).start().awaitTermination()
    assert [ids for _, ids in seen] == [list(range(0, 96)), list(range(96, 168)), list(range(168, 240))]  # four, three and three of ten days
    folder = max(Path(J.ensure_checkpoint_dir(spark), "shelfwise").glob("paced-*"), key=lambda f: f.stat().st_mtime)
    assert len(list(folder.glob("part-*.parquet"))) == 12


def test_the_sweep_reads_staged_rows_at_every_tick(spark, tmp_path, monkeypatch):
    """Every tick joined whole tables again before."""
    from shelfwise.catalog import q_streaming
    from shelfwise.sources.tables import Tables
    start = datetime(2024, 1, 1)
    spark.createDataFrame([(k, 1, start + k * 40 * DAY) for k in range(12)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    line = [(k, 1, 1, n, 1.0, 100.0, 0.0, 0.0, "N", "O", start) for k in range(13) for n in (1, 3)]  # the last order is missing
    spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                                "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    plans, plain = [], J.expire_at_ticks

    def watched(ledger, promotions, **options):
        def read():
            found = promotions()
            plans.append(found._jdf.queryExecution().optimizedPlan().toString())
            return found
        return plain(ledger, read, **options)

    monkeypatch.setattr(J, "expire_at_ticks", watched)
    got = q_streaming.stream_lifecycle_sweep(Tables(spark, str(tmp_path))).collect()
    assert len(plans) == 4 and not any("Join" in p for p in plans)
    ticks = [start + k * 40 * DAY for k in (2, 5, 8, 11)]  # the newest order of each quarter of the days
    end = {f"{k}-1-1-1-1-10000": start + (k * 40 + 40) * DAY for k in range(12)}
    assert sorted((r.promotion_id, r.expired_at) for r in got) == sorted((p, min(t for t in ticks if t > e)) for p, e in end.items() if e < ticks[-1])


def test_fold_step_keeps_to_plain_rows(monkeypatch):
    """Each identity's rows went through sorted frames and records before, milliseconds for a history of a few rows."""
    import pandas as pd

    class Frame:
        def groupBy(self, *_):
            return self

        def applyInPandasWithState(self, step, *_):
            return step

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    def slow(*_, **__):
        raise AssertionError("a frame is sorted or turned into records for each identity")

    start = pd.Timestamp("2024-01-01")
    rows = [(f"{i:02d}", start + (i * 5) % 9 * DAY, [1, 2, None][i % 3], [0.6, None, 0.9][i % 3], [100.0, None, 120.0, 100.5][i % 4], ["a", None][i % 2]) for i in range(24)]
    frame = pd.DataFrame(rows, columns=["observation_id", "observed_at", "source_id", "reliability", "regular_price", "promotion_type"])
    fields = ["regular_price", "promotion_type"]
    step, state = J.canonical_stream(Frame(), fields), State()
    monkeypatch.setattr(pd.DataFrame, "sort_values", slow)
    monkeypatch.setattr(pd.DataFrame, "to_dict", slow)
    halves = [frame[frame["observed_at"] < start + 4 * DAY], frame[frame["observed_at"] >= start + 4 * DAY]]
    got = [(r[1], r[2], r[4]) for half in halves for out in step((7,), iter([half.iloc[:5], half.iloc[5:]]), state) for r in out.itertuples(index=False)]
    fold, want = FoldState(2), []
    for name, ts, source, trust, price, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        verdict, _, created = fold.step(fields, [price, kind], source, DEFAULT_RELIABILITY if trust is None else trust, ts)
        want.append((name, verdict, created))
    assert got == want
    # A sighting without a time is the last one.
    late = pd.DataFrame([("a", pd.NaT, 1, 0.6, 1.0, "a"), ("b", start, 1, 0.6, 2.0, "a")], columns=frame.columns)
    assert [r.observation_id for r in next(step((8,), iter([late]), State())).itertuples()] == ["b", "a"]
