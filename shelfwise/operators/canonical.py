"""Canonical promotions: change detection, arbitration, the observation fold, identity matching and lineage.

The fold is a state machine over the ordered observations of one identity. To keep
it distributable, a long history is cut into pieces of bounded size that fold in
parallel once their starts are known. Those come from stretches of pieces that are walked
through in parallel, each from a guessed start: the state that results if every earlier
observation was applied. Where a stretch ends in another state than its successor was
started from, the successor is walked through again from there, until all starts are right;
only starts and ends are kept for that. Rows stream through sorted
partitions in Arrow batches; a task holds the current state and never a group.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..config import AUTHORITY_MARGIN, CONFLICT_RECENT_DAYS, DEFAULT_RELIABILITY, DISCOUNT_TOLERANCE, PRICE_TOLERANCE
from ..functions.core import round_half_up
from ..functions.identity import compact, event_fingerprint
from ..functions.score import change_weight
from ..sources.staging import shuffle_width, stage
from .intervals import FEW_PERIODS, with_newest
from .ranking import newest_per_key

# Tracked fields in their order, and the class of each.
TRACKED = ["regular_price", "promo_price", "discount_percentage", "promotion_type", "buy_quantity", "free_quantity", "bundle_quantity",
           "cashback_amount", "voucher_amount", "minimum_purchase_amount", "minimum_purchase_quantity", "gift_description", "channel",
           "geography", "start_date", "end_date"]
PRICE_LIKE = ["regular_price", "promo_price", "discount_percentage", "cashback_amount", "voucher_amount"]
MECHANIC_LIKE = ["promotion_type", "buy_quantity", "free_quantity", "bundle_quantity", "minimum_purchase_amount", "minimum_purchase_quantity", "gift_description"]
DATE_LIKE = ["start_date", "end_date"]
EXACT = ["start_date", "end_date", "buy_quantity", "free_quantity", "promotion_type"]
RELATIVE = ["promo_price", "regular_price"]
CHANGE = "array<struct<field:string,previous:string,current:string>>"


def event_type(field: Column) -> Column:
    return (F.when(field.isin(*PRICE_LIKE), "PRICE_OR_VALUE_CHANGED").when(field.isin(*MECHANIC_LIKE), "MECHANIC_CHANGED")
            .when(field.isin(*DATE_LIKE), "DATES_CHANGED").otherwise("TERMS_CHANGED"))


def is_material(field: Column, previous: Column, current: Column) -> Column:
    """A difference a marketer would care about: 1 % on prices, one point on discounts, any change of dates, mechanic or quantities."""
    a, b = previous.try_cast("double"), current.try_cast("double")
    price = F.when(a == 0, F.lit(True)).otherwise(F.abs(a - b) / F.abs(a) > PRICE_TOLERANCE)
    return (F.when(field.isin(*EXACT), F.lit(True)).when(field.isin(*RELATIVE), F.coalesce(price, F.lit(False)))
            .when(field == "discount_percentage", F.coalesce(F.abs(a - b) >= DISCOUNT_TOLERANCE, F.lit(False))).otherwise(F.lit(False)))


def changes_between(fields: list[str], previous: str, current: str) -> Column:
    """Array of changed fields between two struct columns; a missing new value is never a change."""
    text = lambda owner, f: F.col(f"{owner}.{f}").cast("string")
    rows = [F.when(F.col(f"{current}.{f}").isNotNull() & ~F.col(f"{current}.{f}").eqNullSafe(F.col(f"{previous}.{f}")),
                   F.struct(F.lit(f).alias("field"), text(previous, f).alias("previous"), text(current, f).alias("current"))) for f in fields]
    return F.array_compact(F.array(*rows)).cast(CHANGE)


def detect_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Long-format field changes between two tables of the same promotions."""
    pair = old.select(key, F.struct(*fields).alias("_a")).join(new.select(key, F.struct(*fields).alias("_b")), key)
    rows = pair.select(key, F.explode(changes_between(fields, "_a", "_b")).alias("c")).select(key, "c.*")
    return rows.withColumns({"event_type": event_type(F.col("field")), "material": is_material(F.col("field"), F.col("previous"), F.col("current"))})


# --- the fold -------------------------------------------------------------------------------------------------------

class FoldState:
    """Current values of one identity. Small enough to keep per key in a stream. Times are of one kind; ``recent`` is a span of it."""

    __slots__ = ("values", "source", "reliability", "verified", "started", "recent")

    def __init__(self, fields: int, recent=datetime.timedelta(days=CONFLICT_RECENT_DAYS)):
        self.values: list = [None] * fields
        self.source, self.reliability, self.verified, self.started, self.recent = None, DEFAULT_RELIABILITY, None, False, recent

    def step(self, fields: list[str], new: list, source, reliability: float, now):
        """Feed one observation; returns (verdict, changed field positions with previous and new values, whether it is the first).

        Unless it is applied, the changes are those that matter and were held back.
        """
        if not self.started:
            self.started = True
            self._take(new, source, reliability, now)
            return "APPLY", [], True
        changed = [(i, old, v) for i, (old, v) in enumerate(zip(self.values, new)) if v is not None and v != old]
        verdict = self._verdict(fields, changed, source, reliability, now)
        if verdict != "APPLY":
            return verdict, [c for c in changed if material(fields[c[0]], c[1], c[2])], False
        self._take(new, source, reliability, now)
        return verdict, changed, False

    def _verdict(self, fields, changed, source, reliability, now) -> str:
        if self.source is None or source is None or self.source == source:
            return "APPLY"
        if self.verified is None or now - self.verified > self.recent:
            return "APPLY"
        gap = reliability - self.reliability
        if gap >= AUTHORITY_MARGIN or not any(material(fields[i], a, b) for i, a, b in changed):
            return "APPLY"
        return "KEEP" if gap <= -AUTHORITY_MARGIN else "REVIEW"

    def _take(self, new, source, reliability, now) -> None:
        self.values = [old if v is None else v for old, v in zip(self.values, new)]
        if source is not None:
            self.source, self.reliability = source, reliability
        self.verified = now if self.verified is None else max(self.verified, now)


def material(field: str, previous, current) -> bool:
    if field in EXACT:
        return True
    if previous is None or current is None:
        return False
    if field in RELATIVE:
        return previous == 0 or abs(previous - current) / abs(previous) > PRICE_TOLERANCE
    return field == "discount_percentage" and abs(previous - current) >= DISCOUNT_TOLERANCE


def _text(value) -> str | None:
    return None if value is None else str(value)


#: Observations of one identity that fold in one piece, about; a day is never cut.
PIECE_ROWS = 2_000
#: Observations of one identity whose pieces one task walks through to find their starts, about.
STRETCH_ROWS = 1_000_000
_OWN = ["observed_at", "source_id", "reliability"]
_RECENT_MICROS = CONFLICT_RECENT_DAYS * 86_400_000_000


def _pieces(obs: DataFrame, piece_rows: int, stretch_rows: int) -> DataFrame:
    """Adds ``segment``, the piece of an identity's history, counted from 0, and ``stretch``, which holds some pieces in a row.

    Works on one row per (key, day), combined map-side, so a crowded key shrinks
    to its days before anything is ordered by key.
    """
    daily = obs.groupBy("fold_key", F.to_date("observed_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("fold_key").orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    filled = daily.withColumn("before", before).withColumn("filled", F.floor(F.col("before") / F.lit(piece_rows)))
    in_turn = lambda c: (F.dense_rank().over(W.partitionBy("fold_key").orderBy(c)) - 1).cast("bigint")  # noqa: E731  a crowded day fills several, but is one
    begun = F.floor(F.min("before").over(W.partitionBy("fold_key", "filled")) / F.lit(stretch_rows))
    marked = filled.withColumns({"segment": in_turn("filled"), "begun": begun}).select("fold_key", "day", "segment", in_turn("begun").alias("stretch"))
    return obs.withColumn("day", F.to_date("observed_at")).join(marked, ["fold_key", "day"]).drop("day")


def _guesses(obs: DataFrame, fields: list[str]) -> DataFrame:
    """(fold_key, stretch, segment, state): each later stretch's start, at its first piece, if every observation before was applied. One row per stretch is ordered by key."""
    moment = F.struct("observed_at", "observation_id")
    latest = lambda value, stated: F.max_by(F.col(value), F.when(F.col(stated).isNotNull(), moment)).alias(value)
    each = obs.groupBy("fold_key", "stretch").agg(F.min("segment").alias("segment"), *[latest(f, f) for f in fields], latest("source_id", "source_id"),
                                                  latest("reliability", "source_id"), F.max("observed_at").alias("observed_at"))
    so_far = W.partitionBy("fold_key").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    known = each.select("fold_key", "stretch", "segment", *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in [*fields, *_OWN]])
    return known.filter(F.col("observed_at").isNotNull()).select(
        "fold_key", "stretch", "segment", F.struct(*fields, "observed_at", "source_id", F.coalesce("reliability", F.lit(DEFAULT_RELIABILITY)).alias("reliability")).alias("state"))


def _with_starts(obs: DataFrame, starts: DataFrame | None, group: str) -> DataFrame:
    """Observations in order, those of a (fold_key, ``group``) in one task, and before those of a piece its start as a row of its own (``is_row`` 0)."""
    rows = obs.withColumn("is_row", F.lit(1))
    if starts is not None:
        rows = rows.unionByName(starts.select(*[c for c in starts.columns if c != "state"], "state.*", F.lit(0).alias("is_row")), allowMissingColumns=True)
    by = ["fold_key"] if group == "fold_key" else ["fold_key", group]
    return rows.repartition(shuffle_width(obs), *by).sortWithinPartitions(*by, *(["segment"] if group == "stretch" else []), "is_row", "observed_at", "observation_id")


def _is_new(seen: dict, name, source, copy: int) -> bool:
    """Enters an observation; new is the first of its id, once for each entry that its source has."""
    first, copies = seen.setdefault(name, (source, set()))
    if first != source or copy in copies:
        return False
    copies.add(copy)
    return True


def _walk(batches: Iterator[pa.RecordBatch], fields: list[str], group: str, visit, done=lambda batch: None) -> Iterator:
    """Feeds sorted rows to the state of their (fold_key, ``group``); times are microseconds.

    ``visit(n, at, state, step, opens)`` sees the n-th row of a batch after its step, which is None for a start
    and for an observation that this key had before; ``at`` is its piece. Yields what ``done`` gives for each batch.
    """
    held, state, seen, whole = None, FoldState(len(fields), _RECENT_MICROS), {}, group == "fold_key"
    for batch in batches:
        plain = lambda c: batch.column(c).to_pylist()
        times = batch.column("observed_at").cast(pa.int64()).to_pylist()
        values = zip(*[plain(f) for f in fields])
        groups = zip(plain("fold_key"), plain(group))
        copies = plain("copy") if whole else [0] * batch.num_rows
        for n, (at, piece, is_row, name, copy, new, source, reliability, now) in enumerate(zip(groups, plain("segment"), plain("is_row"), plain("observation_id"), copies, values, plain("source_id"), plain("reliability"), times)):
            opens = at != held
            if opens:
                held, state = at, FoldState(len(fields), _RECENT_MICROS)
                seen.clear()
            if not is_row:
                state.values, state.started = list(new), True
                state.source, state.reliability, state.verified = source, reliability, now
                visit(n, (at, piece), state, None, opens)
            elif whole and not _is_new(seen, name, source, copy):
                visit(n, (at, piece), state, None, opens)
            else:
                visit(n, (at, piece), state, state.step(fields, new, source, reliability, now), opens)
        out = done(batch)
        if out is not None:
            yield out


def _times(micros: list, kind: pa.DataType) -> pa.Array:
    return pa.array(micros, pa.int64()).cast(kind)


def _ends(obs: DataFrame, starts: DataFrame, fields: list[str]) -> DataFrame:
    """(fold_key, stretch, segment, state): how each piece of ``obs`` ends; a stretch is walked through by one task, from its start."""
    from pyspark.sql.pandas.types import to_arrow_schema
    kept = [*fields, *_OWN]
    types = {f.name: f.dataType for f in obs.schema.fields}
    out = T.StructType([T.StructField(c, types[c]) for c in ("fold_key", "stretch", "segment", *kept)])
    arrow = to_arrow_schema(out)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = [None], []  # the piece that goes on: its place and its state so far

        def visit(n, at, state, step, opens):
            if now[0] is not None and now[0][0] != at:
                found.append(now[0])
            now[0] = (at, (*state.values, state.verified, state.source, state.reliability))

        def packed(batch):
            rows = found.copy()
            found.clear()
            if not rows:
                return None
            columns = [[at[0][0] for at, _ in rows], [at[0][1] for at, _ in rows], [at[1] for at, _ in rows], *zip(*[values for _, values in rows])]
            return pa.RecordBatch.from_arrays([_times(c, f.type) if f.name == "observed_at" else pa.array(c, f.type) for c, f in zip(map(list, columns), arrow)], schema=arrow)

        yield from _walk(batches, fields, "stretch", visit, packed)
        if now[0] is not None:
            found.append(now[0])
            yield packed(None)

    found = _with_starts(obs, starts, "stretch").mapInArrow(walked, out)
    return found.select("fold_key", "stretch", "segment", F.struct(*kept).alias("state"))


def settled_starts(obs: DataFrame, fields: list[str]) -> DataFrame:
    """(fold_key, segment, state): the right start of each later piece of ``obs``.

    A round walks through the stretches whose start was wrong (all of them at first) and looks
    which successors that proves wrong. The first wrong stretch of a key is right in the next round, so there
    are at most as many rounds as a key has stretches, however often its pieces disagree with their guesses.
    """
    starts = stage(_guesses(obs, fields), "starts")
    todo, ends = obs, None
    while True:
        found = stage(_ends(todo, starts.join(todo.select("fold_key", "stretch").distinct(), ["fold_key", "stretch"], "left_semi"), fields), "ends")
        ends = found if ends is None else stage(ends.join(found.select("fold_key", "stretch").distinct(), ["fold_key", "stretch"], "left_anti").unionByName(found), "ends")
        after = ends.select("fold_key", (F.col("segment") + 1).alias("segment"), F.col("state").alias("right"))
        checked = stage(starts.join(after, ["fold_key", "segment"]).withColumn("wrong", ~F.col("state").eqNullSafe(F.col("right"))), "checked")
        starts = checked.select("fold_key", "stretch", "segment", F.col("right").alias("state"))
        wrong = checked.filter("wrong").select("fold_key", "stretch")
        if wrong.isEmpty():
            return after.select("fold_key", "segment", F.col("right").alias("state"))
        todo = obs.join(wrong, ["fold_key", "stretch"], "left_semi")


def fold_observations(observations: DataFrame, sources: DataFrame, fields: list[str], *, piece_rows: int = PIECE_ROWS, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """One row per observation with its verdict, the changes it made, those held back, and the state after it.

    ``observations``: fold_key, observation_id, observed_at, source_id, confidence
    and the tracked ``fields``. Feeding an observation twice changes nothing. Which identities
    have several pieces is a job that runs here, and so are those that settle the starts of their pieces.
    All others are dealt to tasks whole, once.
    """
    entries = W.partitionBy("source_id").orderBy("reliability_score")  # a source with several entries counts with each of them
    trust = sources.select("source_id", F.col("reliability_score").alias("reliability"), F.row_number().over(entries).alias("copy"))
    obs = observations.select("fold_key", "observation_id", "observed_at", "source_id", "confidence", *fields).filter(F.col("fold_key").isNotNull() & F.col("observed_at").isNotNull())
    crowded = stage(obs.groupBy("fold_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > piece_rows).select("fold_key"), "crowded")
    trusted = lambda df: df.join(trust, "source_id", "left").withColumn("reliability", F.coalesce("reliability", F.lit(DEFAULT_RELIABILITY))).withColumn("copy", F.coalesce("copy", F.lit(1)))
    none = crowded.isEmpty()
    few = trusted(obs if none else obs.join(crowded, "fold_key", "left_anti")).withColumn("segment", F.lit(0).cast("bigint"))
    out = _folded(few, None, fields, "fold_key")
    if none:
        return out
    many = trusted(obs.join(crowded, "fold_key", "left_semi").dropDuplicates(["fold_key", "observation_id"])).drop("copy")
    many = stage(_pieces(many, piece_rows, stretch_rows), "long")
    return out.unionByName(_folded(many.drop("stretch"), settled_starts(many, fields), fields, "segment"))


def _folded(obs: DataFrame, starts: DataFrame | None, fields: list[str], group: str) -> DataFrame:
    """The fold of the observations of each (fold_key, ``group``); under the group fold_key, each observation_id counts once."""
    from pyspark.sql.pandas.types import to_arrow_schema
    types = {f.name: f.dataType for f in obs.schema.fields}
    change = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("field", "previous", "current")]))
    base = ["fold_key", "segment", "observation_id", *_OWN, "confidence"]
    out = T.StructType([*[T.StructField(c, types[c]) for c in base], T.StructField("verdict", T.StringType()), T.StructField("created", T.BooleanType()),
                        T.StructField("changed", change), T.StructField("held_back", change), T.StructField("held_source_id", types["source_id"]),
                        T.StructField("state_source_id", types["source_id"]), T.StructField("verified_at", types["observed_at"]),
                        *[T.StructField(f"state_{f}", types[f]) for f in fields]])
    arrow = to_arrow_schema(out)

    def listed(rows: list[list], kind: pa.ListType) -> pa.Array:
        offsets, total = [0], 0
        for row in rows:
            total += len(row)
            offsets.append(total)
        flat = [c for row in rows for c in row]
        parts = [pa.array([fields[i] for i, _, _ in flat], pa.string()), pa.array([_text(a) for _, a, _ in flat], pa.string()), pa.array([_text(b) for _, _, b in flat], pa.string())]
        items = pa.StructArray.from_arrays([x.cast(f.type) for x, f in zip(parts, kind.value_type)], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, type=kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, verdicts, created, changed, back, holders, owners, verified, states = [], [], [], [], [], [], [], [], []

        def visit(n, at, state, step, opens):
            if step is None:
                return
            verdict, changes, first = step
            applied = verdict == "APPLY"
            places.append(n)
            verdicts.append(verdict)
            created.append(first)
            changed.append(changes if applied else ())
            back.append(() if applied else changes)
            holders.append(None if applied else state.source)
            owners.append(state.source)
            verified.append(state.verified)
            states.append(state.values)

        def packed(batch):
            if not places:
                return None
            given = batch.select(base).take(pa.array(places, pa.int64()))
            made = [pa.array(verdicts, pa.string()), pa.array(created, pa.bool_()), listed(changed, arrow.field("changed").type), listed(back, arrow.field("held_back").type),
                    pa.array(holders, arrow.field("held_source_id").type), pa.array(owners, arrow.field("state_source_id").type), _times(verified, arrow.field("verified_at").type),
                    *[pa.array(list(c), arrow.field(f"state_{f}").type) for f, c in zip(fields, zip(*states))]]
            for held in (places, verdicts, created, changed, back, holders, owners, verified, states):
                held.clear()
            return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*given.columns, *made], arrow)], schema=arrow)

        yield from _walk(batches, fields, group, visit, packed)

    return _with_starts(obs, starts, group).mapInArrow(rows, out)


def conflict_reviews(folded: DataFrame) -> DataFrame:
    """Review items of contradicting sources: one row per field that matters, with the value held, the value offered, and both sources."""
    fields = F.array_join(F.transform("held_back", lambda c: c["field"]), ", ")
    open_ = folded.filter(F.col("verdict") == "REVIEW").withColumn("reason", F.concat(F.lit("Two sources of like reliability differ on "), fields))
    return open_.select("fold_key", "observation_id", "observed_at", "reason", F.col("held_source_id").alias("current_source_id"), F.col("source_id").alias("new_source_id"),
                        F.explode("held_back").alias("c")).select("fold_key", "observation_id", "observed_at", "reason", "current_source_id", "new_source_id",
                                                                  F.col("c.field").alias("field"), F.col("c.previous").alias("current_value"), F.col("c.current").alias("new_value"))


def canonical_state(folded: DataFrame, fields: list[str]) -> DataFrame:
    """Current state per identity. Everything combines map-side."""
    moment = F.struct("observed_at", "observation_id")
    applied = F.col("verdict") == "APPLY"
    return folded.groupBy("fold_key").agg(
        F.max_by(F.struct(*[F.col(f"state_{f}").alias(f) for f in fields], F.col("state_source_id").alias("source_id"), F.col("verified_at").alias("last_verified_at")),
                 moment).alias("s"),
        F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"), F.count(F.lit(1)).alias("observations"),
        F.max(F.when(applied, F.col("reliability"))).alias("source_reliability"), F.max(F.when(applied, F.col("confidence"))).alias("ai_confidence"),
        F.max(F.col("verdict") == "REVIEW").alias("has_open_conflict")).select("fold_key", "s.*", "first_seen_at", "last_seen_at", "observations",
                                                                               "source_reliability", "ai_confidence", "has_open_conflict")


def change_rows(folded: DataFrame) -> DataFrame:
    """Change events: CREATED once per identity, then one row per changed field with the impact of its observation."""
    weight = lambda c: change_weight(event_type(c["field"]))
    impact = round_half_up(F.least(F.lit(1.0), F.aggregate("changed", F.lit(0.0), lambda a, c: a + weight(c))), 4)
    entry = lambda new, *values: F.struct(F.lit(new).alias("new"), *[v.alias(n) for n, v in zip(("field", "previous", "current"), values)])
    first = F.array(entry(True, *[F.lit(None).cast("string")] * 3))
    none = F.slice(first, 1, 0)
    changes = F.transform("changed", lambda c: entry(False, c["field"], c["previous"], c["current"]))
    # one pass: the fold below runs once, however many rows an observation gives
    entries = F.concat(F.when(F.col("created"), first).otherwise(none), F.coalesce(changes, none))
    rows = folded.withColumn("_impact", impact).select("fold_key", "observation_id", "observed_at", "_impact", F.explode(entries).alias("c"))
    rows = rows.select("fold_key", "observation_id", "observed_at", F.when(F.col("c.new"), "CREATED").otherwise(event_type(F.col("c.field"))).alias("event_type"),
                       "c.field", "c.previous", "c.current", F.when(F.col("c.new"), 0.0).otherwise(F.col("_impact")).alias("change_impact"))
    return rows.withColumn("fingerprint", event_fingerprint("fold_key", "observation_id", "event_type", "field", "previous", "current"))


def new_events(events: DataFrame, log: DataFrame) -> DataFrame:
    """Events not in the log yet (same fingerprint = same event). Fingerprints travel as 16 bytes."""
    key = lambda df: compact(df.withColumn("_key", F.col("fingerprint")), "_key")
    return key(events).dropDuplicates(["_key"]).join(key(log).select("_key").distinct(), "_key", "left_anti").drop("_key")


def change_impact(changes: DataFrame, key: list[str]) -> DataFrame:
    """Impact of a change set: one weight per distinct field, capped at 1."""
    distinct = changes.groupBy(*key, "field").agg(F.min("event_type").alias("event_type"))
    return distinct.groupBy(*key).agg(round_half_up(F.least(F.lit(1.0), F.sum(change_weight("event_type"))), 4).alias("impact"))


def lag_changes(observations: DataFrame, fields: list[str], *, key: str = "fold_key") -> DataFrame:
    """Field changes against the last stated value, for identities one source reports (no arbitration)."""
    before = W.partitionBy(key).orderBy("observed_at", "observation_id").rowsBetween(W.unboundedPreceding, -1)
    df = observations.withColumns({f"_p_{f}": F.last(f, ignorenulls=True).over(before) for f in fields})
    df = df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("observed_at", "observation_id"))).filter(F.col("_n") > 1)
    df = df.select(key, "observation_id", "observed_at", F.struct(*[F.col(f"_p_{f}").alias(f) for f in fields]).alias("_a"), F.struct(*fields).alias("_b"))
    rows = df.select(key, "observation_id", "observed_at", F.explode(changes_between(fields, "_a", "_b")).alias("c")).select(key, "observation_id", "observed_at", "c.*")
    return rows.withColumns({"event_type": event_type(F.col("field")), "material": is_material(F.col("field"), F.col("previous"), F.col("current"))})


def replay_conflicts(state: DataFrame, folded: DataFrame, observations: DataFrame, decisions: DataFrame, fields: list[str]) -> DataFrame:
    """Apply analyst decisions on conflicts.

    ``decisions``: observation_id, use_new. The newest accepted observation
    overrides the fields it states; an identity stays in conflict while any of its
    conflicts is undecided.
    """
    reviews = folded.filter(F.col("verdict") == "REVIEW").select("fold_key", "observation_id", "observed_at").join(decisions, "observation_id", "left")
    accepted = reviews.filter("use_new").join(observations.select("observation_id", F.struct(*fields, "source_id").alias("v")), "observation_id")
    newest = accepted.groupBy("fold_key").agg(F.max_by("v", F.struct("observed_at", "observation_id")).alias("v"))
    pending = reviews.groupBy("fold_key").agg(F.count(F.when(F.col("use_new").isNull(), 1)).alias("pending"))
    df = state.join(newest, "fold_key", "left").join(pending, "fold_key", "left")
    updated = {f: F.coalesce(F.col(f"v.{f}"), F.col(f)) for f in [*fields, "source_id"]}
    return df.withColumns(updated).withColumn("has_open_conflict", F.coalesce(F.col("pending") > 0, F.lit(False))).drop("v", "pending")


# --- identity matching and lineage ----------------------------------------------------------------------------------

def match_identity(incoming: DataFrame, stored: DataFrame, *, few: int = FEW_PERIODS) -> DataFrame:
    """Stored promotion of each incoming item: exact fingerprint, else campaign fingerprint with a compatible period (newest seen).

    ``incoming``: item_id, fingerprint, source_fingerprint, start_date, end_date
    [, legacy_fingerprint]. ``stored``: promotion_id, fingerprint,
    source_fingerprint, start_date, end_date, last_seen_at. The campaign match
    asks for the newest overlapping period (``intervals``). An item is shuffled once for each
    of its fingerprints, which travel as 16 bytes.
    """
    legacy = ["legacy_fingerprint"] if "legacy_fingerprint" in incoming.columns else []
    known = compact(stored, "fingerprint", "source_fingerprint")
    exact = known.groupBy("fingerprint").agg(F.min("promotion_id").alias("exact_id"))
    df = compact(incoming, "fingerprint", "source_fingerprint", *legacy).select(
        "item_id", "fingerprint", "source_fingerprint", *legacy, F.to_date("start_date").alias("first"), F.to_date("end_date").alias("last"))
    df = df.join(exact, "fingerprint", "left").drop("fingerprint")

    def attach(df: DataFrame, column: str, name: str) -> DataFrame:
        periods = known.filter(F.col("source_fingerprint").isNotNull()).select(
            F.col("source_fingerprint").alias(column), F.to_date("start_date").alias("first"), F.to_date("end_date").alias("last"), F.struct("last_seen_at", "promotion_id").alias(name))
        return with_newest(df, periods, [column], newest=name, few=few, how="left").drop(column)

    df = attach(df, "source_fingerprint", "by_campaign")
    by_legacy = F.lit(None).cast("string")
    if legacy:
        df = attach(df, "legacy_fingerprint", "by_legacy")
        by_legacy = F.col("by_legacy.promotion_id")
    matched = F.coalesce("exact_id", F.col("by_campaign.promotion_id"), by_legacy)
    how = F.when(F.col("exact_id").isNotNull(), "EXACT").when(F.col("by_campaign").isNotNull(), "CAMPAIGN").when(by_legacy.isNotNull(), "LEGACY").otherwise("NEW")
    return df.select("item_id", matched.alias("promotion_id"), how.alias("match"))


def lineage(new: DataFrame, active: DataFrame, *, few: int = FEW_PERIODS) -> DataFrame:
    """Active promotion each new one replaces: same product and retailer, other campaign, overlapping period, newest seen."""
    key = ["product_id", "retailer_id"]
    known = F.col("product_id").isNotNull() & F.col("retailer_id").isNotNull() & F.col("source_fingerprint").isNotNull()
    of = lambda df, *more: compact(df.filter(known), "source_fingerprint").select(
        *key, "source_fingerprint", F.to_date("start_date").alias("first"), F.to_date("end_date").alias("last"), *more)
    pool = of(active.filter(F.col("status") == "ACTIVE"), F.struct("last_seen_at", "promotion_id").alias("newest"))
    found = with_newest(of(new, "item_id"), pool, key, newest="newest", other="source_fingerprint", few=few)
    return found.select("item_id", F.col("newest.promotion_id").alias("supersedes_id"))


def supersede(stored: DataFrame, new: DataFrame, *, few: int = FEW_PERIODS) -> tuple[DataFrame, DataFrame]:
    """(stored promotions with what ``new`` ones replace marked SUPERSEDED, the SUPERSEDED events).

    ``new``: as for ``lineage``, with observation_id and observed_at. All new promotions
    see the stored ones as they were before. One that several replace is superseded
    once, by the earliest of them; each of them still names it.
    """
    pairs = lineage(new, stored, few=few).join(new.select("item_id", "observation_id", "observed_at"), "item_id")
    first = pairs.groupBy(F.col("supersedes_id").alias("promotion_id")).agg(F.min_by(F.struct("item_id", "observation_id", "observed_at"), F.struct("observed_at", "item_id")).alias("by"))
    marked = stored.join(first, "promotion_id", "left").withColumns({
        "status": F.when(F.col("by").isNotNull(), "SUPERSEDED").otherwise(F.col("status")), "superseded_by": F.col("by.item_id")}).drop("by")
    said = first.select("promotion_id", F.col("by.observation_id").alias("observation_id"), F.col("by.observed_at").alias("observed_at"), F.lit("SUPERSEDED").alias("event_type"),
                        F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("previous"),
                        F.to_json(F.struct(F.col("by.item_id").cast("string").alias("superseded_by_promotion_id"))).alias("current"), F.lit(0.0).alias("change_impact"))
    return marked, said.withColumn("fingerprint", event_fingerprint("promotion_id", "observation_id", "event_type", "field", "previous", "current"))


def source_backfill(promotions: DataFrame, observations: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Fill a missing source from the newest observation's document, else from the newest evidence's."""
    missing = promotions.filter(F.col("source_id").isNull())
    docs = documents.select("document_id", "document_source_id")

    def newest(rows: DataFrame, time: str, tie: str, name: str) -> DataFrame:
        mine = rows.join(missing.select("promotion_id"), "promotion_id", "left_semi").join(docs, "document_id").filter(F.col("document_source_id").isNotNull())
        return newest_per_key(mine, "promotion_id", F.col(time).desc(), F.col(tie).desc()).select("promotion_id", F.col("document_source_id").alias(name))

    a, b = newest(observations, "observed_at", "observation_id", "_o"), newest(evidence, "captured_at", "evidence_id", "_e")
    return missing.join(a, "promotion_id", "left").join(b, "promotion_id", "left").withColumn("source_id", F.coalesce("_o", "_e")).drop("_o", "_e")


def merge_field_observations(submissions: DataFrame, stored: DataFrame) -> DataFrame:
    """Outcome of approving field submissions.

    MATCHED (with the promotion), CONFLICT (several candidates, or the stored
    regular price or category disagrees) or NEW. ``submissions``: submission_id,
    fingerprint, source_fingerprint, competitor_id, retailer_id, category,
    promo_price, regular_price, start_date, end_date.
    """
    known, s = compact(stored, "fingerprint", "source_fingerprint"), compact(submissions, "fingerprint", "source_fingerprint")
    exact = known.groupBy("fingerprint").agg(F.min_by(F.struct("promotion_id", "regular_price", "category"), "promotion_id").alias("x"))
    # as one struct, so that missing values are alike and a row is shuffled with a key of few columns
    alike = F.struct("source_fingerprint", "competitor_id", "retailer_id", "category", "promo_price", "start_date", "end_date").alias("alike")
    similar = known.groupBy(alike).agg(F.count(F.lit(1)).alias("candidates"), F.min_by(F.struct("promotion_id", "regular_price", "category"), "promotion_id").alias("y"))
    told = s.select("submission_id", "fingerprint", "regular_price", "category", alike).join(exact, "fingerprint", "left").drop("fingerprint")
    joined = told.join(similar, "alike", "left")
    hit = F.coalesce("x", "y")
    several = F.col("x").isNull() & (F.col("candidates") > 1)
    differs = ~hit["regular_price"].eqNullSafe(F.col("regular_price")) | ~hit["category"].eqNullSafe(F.col("category"))
    outcome = F.when(F.coalesce(several, F.lit(False)), "CONFLICT").when(hit.isNull(), "NEW").when(differs, "CONFLICT").otherwise("MATCHED")
    return joined.select("submission_id", outcome.alias("outcome"), F.when(outcome == "MATCHED", hit["promotion_id"]).alias("promotion_id"))


def price_revisions(before: DataFrame, after: DataFrame, *, key: str, fields: list[str]) -> DataFrame:
    """Row-change log between two snapshots: INSERT, UPDATE or DELETE with the resulting (or removed) row as JSON."""
    a = before.select(key, F.struct(*fields).alias("_a"))
    b = after.select(key, F.struct(*fields).alias("_b"))
    df = a.join(b, key, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    operation = F.when(F.col("_a").isNull(), "INSERT").when(F.col("_b").isNull(), "DELETE").otherwise("UPDATE")
    return df.select(key, operation.alias("operation"), F.to_json(F.coalesce("_b", "_a")).alias("snapshot"))
