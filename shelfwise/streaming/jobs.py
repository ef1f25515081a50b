"""Structured Streaming forms of the incremental operators.

Each function takes a streaming frame and returns a streaming frame (or starts
a ``foreachBatch`` sink). Event time is a TIMESTAMP column; seven days is the
late-data policy: older facts are superseded without a conflict.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import CONFLICT_RECENT_DAYS, DEFAULT_RELIABILITY
from ..operators.canonical import FoldState
from ..session import ensure_checkpoint_dir
from ..sources.staging import shuffle_width

LATE = f"{CONFLICT_RECENT_DAYS} days"


def table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The Parquet files called ``name`` in a folder, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def paced(df: DataFrame, time_column: str, pieces: int) -> DataFrame:
    """``df`` as a stream that arrives in ``pieces`` micro-batches, cut into equal spans of time.

    The pieces are written one after the other, each by the tasks that read ``df``, in as many files
    (empty ones fill up the number): for trying a stream job on stored rows. A live source sets its own pace.
    """
    spark, folder = df.sparkSession, f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/shelfwise/paced-{uuid.uuid4().hex}"
    span = df.agg(F.min(F.to_date(time_column)).alias("low"), F.max(F.to_date(time_column)).alias("high")).first()
    days = (span["high"] - span["low"]).days + 1 if span["low"] is not None else 1
    piece = F.floor(F.datediff(time_column, F.lit(span["low"]).cast("date")) * pieces / F.lit(days))
    files = max(1, min(df.rdd.getNumPartitions(), shuffle_width(df)))
    nothing = df.limit(0).coalesce(1)
    for number in range(pieces):
        df.filter(piece == number).coalesce(files).write.mode("append").parquet(folder)
        for _ in range((number + 1) * files - len(spark.read.schema(df.schema).parquet(folder).inputFiles())):
            nothing.write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


def event_stream(spark: SparkSession, folder: str, name: str, schema, time_column: str = "ts") -> DataFrame:
    """A table stream whose zone-free times become timestamps under the session zone."""
    raw = table_stream(spark, folder, name, schema)
    return raw.withColumn(time_column, F.col(time_column).cast("timestamp"))


def emit_once(events: DataFrame, *, keys: list[str], time_column: str = "ts", late: str = LATE) -> DataFrame:
    """Each event key once, remembered for the late-data window."""
    return events.withWatermark(time_column, late).dropDuplicatesWithinWatermark(keys)


def activity(events: DataFrame, *, size: str = "7 days", slide: str | None = None, by: str = "event_type", time_column: str = "ts", late: str = LATE) -> DataFrame:
    """Tumbling (or sliding) activity counts per key."""
    span = F.window(time_column, size, slide) if slide else F.window(time_column, size)
    return events.withWatermark(time_column, late).groupBy(span, by).agg(F.count(F.lit(1)).alias("events"))


def unchanged_pages(pages: DataFrame, *, late: str = LATE, forget_days: int = 400) -> DataFrame:
    """Per url: is this fetch the same content as the newest one seen? Late fetches never replace newer content.

    ``pages``: url, document_id, content_hash, ts. State is one hash and time per url,
    dropped when nothing came for ``forget_days`` of event time; facts older than the
    watermark are not looked at. A call holds one url's fetches of one micro-batch, so
    the source's ``maxFilesPerTrigger`` bounds it.
    """
    keep = forget_days * 86_400_000

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        digest, newest = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "document_id"])
        out = []
        for document, current, ts in zip(rows["document_id"], rows["content_hash"], rows["ts"]):
            behind = newest is not None and ts.value < newest
            out.append((key[0], document, bool(digest == current and not behind), bool(behind)))
            if not behind:
                digest, newest = current, ts.value
        state.update((digest, newest))
        state.setTimeoutTimestamp(newest // 1_000_000 + keep)
        yield pd.DataFrame(out, columns=["url", "document_id", "unchanged", "late"])

    return pages.withWatermark("ts", late).groupBy("url").applyInPandasWithState(
        step, "url string, document_id bigint, unchanged boolean, late boolean", "content_hash string, newest bigint", "append", GroupStateTimeout.EventTimeTimeout)


def stale_episodes(checks: DataFrame, *, stale_days: int = 3, late: str = LATE) -> DataFrame:
    """Sources that had no success for ``stale_days``, and their recovery, each once per last success.

    ``checks``: source_id, ts, ok; those of a source come in order of time, batch by batch. A timer
    opens SOURCE_STALE when the watermark passes the time, with no row of the source arriving; a
    failed check after that time opens it too. The next success gives SOURCE_RECOVERED. State is the
    last success and whether it is announced; a source is known from its first success on.
    """
    allowed = stale_days * 86_400_000_000  # microseconds, as all times here: they do not depend on the session's zone

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told = state.get if state.exists else (None, False)
        out = []

        def stale():
            out.append((key[0], "SOURCE_STALE", last, last + allowed))

        if state.hasTimedOut:
            stale()
            told = True
        else:
            rows = pd.concat(list(batches)).sort_values("micros")
            for ts, ok in zip(rows["micros"].tolist(), rows["ok"].tolist()):
                if last is not None and not told and ts > last + allowed:
                    stale()
                    told = True
                if ok:
                    if told:
                        out.append((key[0], "SOURCE_RECOVERED", last, ts))
                    last, told = ts, False
        if last is not None:
            due = (last + allowed) // 1_000
            if not told and due <= state.getCurrentWatermarkMs():
                stale()
                told = True
            state.update((last, told))
            if not told:
                state.setTimeoutTimestamp(due)
        yield pd.DataFrame(out, columns=["source_id", "kind", "last_success", "at"])

    kind = checks.schema["source_id"].dataType.simpleString()
    found = checks.select("source_id", "ts", F.unix_micros("ts").alias("micros"), "ok").withWatermark("ts", late).groupBy("source_id").applyInPandasWithState(
        step, f"source_id {kind}, kind string, last_success bigint, at bigint", "last_success bigint, told boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("source_id", "kind", F.timestamp_micros("last_success").alias("last_success"), F.timestamp_micros("at").alias("at"))


def canonical_stream(observations: DataFrame, fields: list[str], *, key_type: str = "bigint", buckets: int | None = None) -> DataFrame:
    """The observation fold as keyed state: current values, last source and last verified time per identity.

    ``observations``: fold_key, observation_id, observed_at, source_id, reliability
    and the tracked ``fields`` (numbers and strings). Emits a verdict per observation.

    A call of Spark for a group costs milliseconds, whatever its rows. With ``buckets``, identities are dealt
    to so many groups, and the states of a group's identities are kept, read and written together; so a group
    should hold some hundred identities. The number stays the same for the life of a checkpoint.
    """
    tracked = [*fields, "source_id", "reliability"]
    alone = buckets is None

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Histories are many and short, so rows are plain lists. Times are nanoseconds; NaN stands for none and, like it, is never newer.
        folds, histories, out = {}, {}, []

        def held(name):
            if name not in folds:
                folds[name] = FoldState(len(fields), CONFLICT_RECENT_DAYS * 86_400_000_000_000)
            return folds[name]

        if state.exists:
            for name, values, source, reliability, verified in [(key[0], *map(json.loads, state.get[:2]), *state.get[2:])] if alone else json.loads(state.get[0]):
                fold = held(name)
                fold.values, fold.source, fold.reliability, fold.started = values, source, reliability, True
                fold.verified = math.nan if verified == pd.NaT.value else verified
        for part in batches:
            times = [math.nan if n == pd.NaT.value else n for n in pd.DatetimeIndex(part["observed_at"]).as_unit("ns").asi8.tolist()]
            names = [key[0]] * len(part) if alone else part["fold_key"].tolist()
            for name, row in zip(names, zip(times, part["observation_id"].tolist(), zip(*([None if v != v else v for v in part[c].tolist()] for c in tracked)))):
                histories.setdefault(name, []).append(row)
        for name, rows in histories.items():
            fold = held(name)
            rows.sort(key=lambda r: (r[0] != r[0], 0 if r[0] != r[0] else r[0], r[1] is None, r[1] or ""))
            for now, observation, (*new, source, trust) in rows:
                verdict, changed, created = fold.step(fields, new, source, DEFAULT_RELIABILITY if trust is None else trust, now)
                out.append((name, observation, verdict, len(changed) if verdict == "APPLY" else 0, created))
        kept = [(name, fold.values, fold.source, float(fold.reliability), pd.NaT.value if fold.verified != fold.verified else fold.verified) for name, fold in folds.items()]
        state.update((json.dumps(kept[0][1]), json.dumps(kept[0][2]), *kept[0][3:]) if alone else (json.dumps(kept),))
        yield pd.DataFrame(out, columns=["fold_key", "observation_id", "verdict", "changes", "created"])

    verdicts = "observation_id string, verdict string, changes int, created boolean"
    if alone:
        return observations.groupBy("fold_key").applyInPandasWithState(
            step, f"fold_key {key_type}, {verdicts}", "fields string, source string, reliability double, verified bigint", "append", GroupStateTimeout.NoTimeout)
    # keys and sources as texts: whole numbers beside missing ones would come to Python as floats
    texts = observations.withColumns({c: F.col(c).cast("string") for c in ("fold_key", "source_id")})
    dealt = texts.withColumn("_bucket", F.pmod(F.xxhash64("fold_key"), F.lit(buckets)))
    found = dealt.groupBy("_bucket").applyInPandasWithState(step, f"fold_key string, {verdicts}", "held string", "append", GroupStateTimeout.NoTimeout)
    return found.withColumn("fold_key", F.col("fold_key").cast(key_type))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream into Parquet under the checkpoint folder and read it back.

    Append mode uses the exactly-once file sink; complete mode overwrites the
    table per batch. The stream checkpoint lives beside the table, so a restart resumes.
    """
    spark = stream.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shelfwise/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{root}/table").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{root}/table")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/table")


class Ledger:
    """A table under ``root`` that each batch number adds to once, for ``foreachBatch``.

    A batch writes its own folder and is then entered in the ledger. One that stops in
    between writes the same folder again; one that is entered does nothing when it is replayed.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.root}/table/batch=-1")
        spark.createDataFrame([], "number bigint").write.mode("ignore").parquet(f"{self.root}/ledger")

    def rows(self) -> DataFrame:
        """What entered batches have written."""
        known = self.spark.read.schema("number bigint").parquet(f"{self.root}/ledger")
        table = self.spark.read.schema(f"{self.schema}, batch bigint").parquet(f"{self.root}/table")
        return table.join(known, F.col("batch") == F.col("number"), "left_semi").drop("batch")

    def once(self, work: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        def run(batch: DataFrame, number: int) -> None:
            entered = self.spark.read.schema("number bigint").parquet(f"{self.root}/ledger")
            if not entered.filter(F.col("number") == number).isEmpty():
                return
            work(batch).write.mode("overwrite").parquet(f"{self.root}/table/batch={number}")
            self.spark.createDataFrame([(number,)], "number bigint").write.mode("append").parquet(f"{self.root}/ledger")
        return run


def expire_at_ticks(ledger: Ledger, promotions: Callable[[], DataFrame], *, time_column: str = "ts") -> Callable[[DataFrame, int], None]:
    """The periodic sweep for ``foreachBatch``: a micro-batch's newest time is the tick.

    Writes (promotion_id, expired_at) of open promotions that ended before the tick and that no
    earlier sweep wrote. ``promotions`` gives the stored rows at the time of the sweep; they are read
    whole at every tick, so what joins tables is better staged.
    """
    def work(ticks: DataFrame) -> DataFrame:
        tick = ticks.agg(F.max(time_column).cast("timestamp_ntz").alias("expired_at"))
        open_ = promotions().filter(F.col("status").isin("ACTIVE", "UNKNOWN", "UPCOMING") & F.col("end_date").isNotNull())
        ended = open_.join(F.broadcast(tick), F.col("end_date") < F.col("expired_at"))  # one row
        # Only ids are shuffled to meet what was written; the tick is put beside them after that.
        new = ended.select("promotion_id").join(ledger.rows().select("promotion_id"), "promotion_id", "left_anti")
        return new.join(F.broadcast(tick))

    return ledger.once(work)


def every_tick(ticks: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, *, drain: bool = False):
    """Run ``work`` (expire, rescore, alert) once per micro-batch of ``ticks``; returns the running query. ``drain`` stops when nothing is left."""
    writer = ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work)
    return (writer.trigger(availableNow=True) if drain else writer).start()
