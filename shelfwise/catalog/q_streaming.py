"""Structured Streaming queries, drained over the given tables and compared with their batch meaning."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..session import ensure_checkpoint_dir
from ..sources import views as V
from ..sources.staging import stage
from ..sources.tables import Tables
from ..streaming import jobs as J
from .q_canonical import _FOLD
from .registry import query


def events(t: Tables) -> DataFrame:
    return J.event_stream(t.spark, t.folder, "events", t.events.schema)


def _ntz(c: str):
    return F.col(c).cast("timestamp_ntz")


@query("stream_weekly_activity", "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week, event_type, count(*) AS events FROM events GROUP BY 1,2")
def stream_weekly_activity(t: Tables) -> DataFrame:
    out = J.run_to_table(J.activity(events(t)), "weekly", "complete")
    return out.select(_ntz("window.start").alias("week"), "event_type", "events")


@query("stream_sliding_activity", """SELECT d + to_days(-k) AS starts, event_type, count(*) AS events FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS d, event_type FROM events), (SELECT unnest([0,1,2,3,4,5,6]) AS k) GROUP BY 1,2""")
def stream_sliding_activity(t: Tables) -> DataFrame:
    out = J.run_to_table(J.activity(events(t), slide="1 day"), "sliding", "complete")
    return out.select(_ntz("window.start").alias("starts"), "event_type", "events")


@query("stream_change_dedup", "SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS bucket FROM events GROUP BY ALL")
def stream_change_dedup(t: Tables) -> DataFrame:
    keyed = events(t).withColumn("bucket", F.floor("value").cast("bigint"))
    # the whole month is one batch, so a month of memory makes each key unique
    out = J.run_to_table(J.emit_once(keyed.select("ts", "user_id", "event_type", "bucket"), keys=["user_id", "event_type", "bucket"], late="40 days"), "dedup")
    return out.select("user_id", "event_type", "bucket")


@query("stream_late_policy", "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week, event_type, count(*) AS events FROM events GROUP BY 1,2 HAVING time_bucket(INTERVAL 7 DAY, max(ts), TIMESTAMP '1970-01-01') + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def stream_late_policy(t: Tables) -> DataFrame:
    """Append mode: a week is final once the watermark (seven days behind) has passed its end."""
    out = J.run_to_table(J.activity(events(t)), "closed")
    return out.select(_ntz("window.start").alias("week"), "event_type", "events")


@query("stream_unchanged_pages", """WITH d AS (SELECT doc_id, text, concat('https://', source, '/', doc_id%7) AS url, TIMESTAMP '2000-01-01' + to_days(CAST(doc_id%1000 AS INTEGER)) AS ts FROM documents), x AS (SELECT doc_id, url, text = lag(text) OVER (PARTITION BY url ORDER BY ts, doc_id) AS same FROM d)
SELECT url, doc_id AS document_id, coalesce(same,false) AS unchanged, false AS late FROM x""")
def stream_unchanged_pages(t: Tables) -> DataFrame:
    """Fetches of pages over 1,000 days, arriving in five micro-batches: state is restored between them."""
    fetched = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("doc_id") % 1000).cast("int"))
    pages = t.documents.select(F.concat(F.lit("https://"), "source", F.lit("/"), F.col("doc_id") % 7).alias("url"), F.col("doc_id").alias("document_id"),
                               F.sha2("text", 256).alias("content_hash"), fetched.cast("timestamp").alias("ts"))
    return J.run_to_table(J.unchanged_pages(J.paced(pages, "ts", 5), forget_days=1500), "unchanged").select("url", "document_id", "unchanged", "late")


@query("stream_lifecycle_sweep", f"""+ o AS (SELECT o_orderdate AS d, min(o_orderdate) OVER () AS lo, max(o_orderdate) OVER () AS hi FROM orders), k AS (SELECT floor(date_diff('day',lo,d)*4/(date_diff('day',lo,hi)+1)) AS piece, max(d) AS tick FROM o GROUP BY 1)
SELECT promotion_id, min(tick) AS expired_at FROM promo_base JOIN k ON end_date<tick GROUP BY 1""", "promo_base")
def stream_lifecycle_sweep(t: Tables) -> DataFrame:
    """Runs arrive in four micro-batches, each a tick; then the second batch is replayed, which must change nothing."""
    root = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/shelfwise/sweep-{uuid.uuid4().hex}"
    ledger = J.Ledger(t.spark, f"{root}/out", "promotion_id string, expired_at timestamp_ntz")
    # Every tick reads the stored rows, so the join of whole tables behind them runs once.
    stored = stage(V.promotions(t, "promotion_id", "start_date", "end_date").select("promotion_id", "end_date", F.lit("ACTIVE").alias("status")), "stored")
    runs = t.orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("ts"))
    sweep = J.expire_at_ticks(ledger, lambda: stored)
    J.every_tick(J.paced(runs, "ts", 4), sweep, f"{root}/checkpoint", drain=True).awaitTermination()
    sweep(runs, 1)
    return ledger.rows()


@query("stream_stale_sources", """WITH c AS (SELECT user_id AS source_id, ts, event_type<>'error' AS ok FROM events), l AS (SELECT source_id, max(ts) AS last_row FROM c GROUP BY 1), m AS (SELECT max(ts)-INTERVAL 7 DAY AS mark FROM c),
s AS (SELECT DISTINCT source_id, ts AS last_success FROM c WHERE ok), n AS (SELECT *, last_success+INTERVAL 3 DAY AS due, lead(last_success) OVER (PARTITION BY source_id ORDER BY last_success) AS next_success FROM s)
SELECT source_id, 'SOURCE_STALE' AS kind, last_success, due AS at FROM n JOIN l USING (source_id), m WHERE next_success>due OR (next_success IS NULL AND (last_row>due OR due<=mark))
UNION ALL SELECT source_id, 'SOURCE_RECOVERED', last_success, next_success FROM n WHERE next_success>due""")
def stream_stale_sources(t: Tables) -> DataFrame:
    """Checks arrive in four micro-batches; a source goes stale by a timer, also where no row of it arrives any more."""
    checks = t.events.select(F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))
    out = J.run_to_table(J.stale_episodes(J.paced(checks, "ts", 4)), "stale")
    return out.select("source_id", "kind", _ntz("last_success").alias("last_success"), _ntz("at").alias("at"))


@query("stream_fold_counts", f"+ /*recursive*/ {_FOLD} SELECT verdict, count(*) AS observations, CAST(sum(chg) AS BIGINT) AS changes FROM f GROUP BY 1", "sources")
def stream_fold_counts(t: Tables) -> DataFrame:
    """The canonical fold as a stream gives the verdicts of the batch fold."""
    fields = ["regular_price", "discount_percentage", "promotion_type", "end_date"]
    stream_tables = Tables(t.spark, t.folder)
    lines = J.table_stream(t.spark, t.folder, "lineitem", t.lineitem.schema)
    stream_tables.read = lambda name: lines if name == "lineitem" else t.read(name)
    obs = V.observations(stream_tables).withColumn("end_date", F.col("end_date").cast("string"))
    trust = V.sources(t).select("source_id", F.col("reliability_score").alias("reliability"))
    buckets = max(200, t.part.count() // 500)  # an identity is a part; some hundred of them are kept together
    out = J.run_to_table(J.canonical_stream(obs.join(trust, "source_id", "left").drop("confidence", "document_id"), fields, buckets=buckets), "fold")
    return out.groupBy("verdict").agg(F.count(F.lit(1)).alias("observations"), F.sum("changes").alias("changes"))
