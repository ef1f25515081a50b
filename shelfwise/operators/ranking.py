"""Scores, explanations and ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import CHANGE_IMPACT_DAYS
from ..functions import score as S
from ..functions.core import AsOf, days, instant, round_half_up


def recent_impact(change_events: DataFrame, *, as_of: AsOf, window_days: int = CHANGE_IMPACT_DAYS) -> DataFrame:
    """Largest change impact per promotion in the last ``window_days`` (filter reaches the scan, combines map-side)."""
    recent = change_events.filter(F.col("observed_at") >= instant(as_of) - days(window_days))
    return recent.groupBy("promotion_id").agg(F.max("change_impact").alias("change_impact"))


def _parts(df: DataFrame, as_of: AsOf) -> tuple[dict[str, Column], Column]:
    known = F.col("start_date").isNotNull() | F.col("end_date").isNotNull()
    return S.components(as_of), known


def with_score(promotions: DataFrame, change_events: DataFrame, *, as_of: AsOf) -> DataFrame:
    """Adds ``change_impact`` and ``score``. Expects the competitor's ``importance`` on the row (null = unknown)."""
    df = promotions.join(recent_impact(change_events, as_of=as_of), "promotion_id", "left")
    parts, known = _parts(df, as_of)
    return df.withColumn("score", S.total_score(parts, known))


def rescore(promotions: DataFrame, change_events: DataFrame, *, as_of: AsOf) -> DataFrame:
    """Current promotions with the fresh ``score`` and whether it moved by more than 1e-6."""
    current = promotions.filter(F.col("status").isin("ACTIVE", "UNKNOWN"))
    scored = with_score(current, change_events, as_of=as_of)
    moved = F.abs(F.col("score") - F.coalesce(F.col("rank_score"), F.lit(0.0))) > 1e-6
    return scored.withColumn("changed", moved)


def explain_scores(promotions: DataFrame, change_events: DataFrame, *, as_of: AsOf) -> DataFrame:
    """One row per promotion and component: value, weight, points and a note."""
    df = promotions.join(recent_impact(change_events, as_of=as_of), "promotion_id", "left")
    parts, known = _parts(df, as_of)
    seen = F.coalesce(F.col("last_verified_at"), F.col("last_seen_at"))
    age = F.greatest(F.lit(0), F.floor((F.unix_timestamp(instant(as_of).cast("timestamp")) - F.unix_timestamp(seen.cast("timestamp"))) / 86400))
    notes = {
        "strength": F.concat(F.initcap(F.replace(F.col("promotion_type"), F.lit("_"), F.lit(" "))),
                             F.when(F.col("discount_percentage") > 0,
                                    F.concat(F.lit(", "), F.format_number(F.col("discount_percentage"), 0), F.lit("% off"))).otherwise("")),
        "reliability": F.concat(F.lit("Source reliability "), round_half_up(F.coalesce(F.col("source_reliability"), F.lit(0.0)) * 100, 0).cast("int"), F.lit("%")),
        "freshness": F.concat(F.lit("Verified "), age.cast("int"), F.lit(" day(s) ago")),
        "relevance": F.concat(F.initcap(F.coalesce(F.col("category"), F.lit("Other"))),
                              F.when(parts["relevance"] == 1.0, " is a core category").otherwise(" is outside the core categories")),
        "importance": F.concat(F.lit("Competitor importance "), F.coalesce(F.col("importance"), F.lit(0.5))),
        "confidence": F.coalesce(F.concat(F.lit("AI extraction confidence "), round_half_up(F.col("ai_confidence") * 100, 0).cast("int"), F.lit("%")),
                                 F.lit("Reviewed field evidence")),
        "change": F.when(F.coalesce(F.col("change_impact"), F.lit(0.0)) > 0, "A material change was seen in the last 7 days").otherwise("No recent change"),
    }
    rows = F.array(*[
        F.struct(F.lit(key).alias("component"), F.lit(S.LABELS[key]).alias("label"), round_half_up(parts[key], 4).alias("value"),
                 F.lit(weight).alias("weight"), round_half_up(parts[key] * weight, 4).alias("points"), notes[key].alias("note"))
        for key, weight in S.WEIGHTS.items()])
    return df.select("promotion_id", S.total_score(parts, known).alias("score"), F.explode(rows).alias("c")).select(
        "promotion_id", "score", "c.*")


def newest_per_key(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """One row per key, first by ``order``. The rank filter is pushed below the shuffle, so a hot key sends one row per task."""
    keys = [key] if isinstance(key, str) else key
    numbered = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col("_rn") == 1).drop("_rn")


def newest_evidence(evidence: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Newest evidence per promotion: captured, created, id. ``keys`` limits it to the promotions of a report."""
    if keys is not None:
        evidence = evidence.join(keys.select("promotion_id"), "promotion_id", "left_semi")
    return newest_per_key(evidence, "promotion_id", F.col("captured_at").desc(), F.col("created_at").desc(), F.col("evidence_id").desc())


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows with their rank; the sort happens on the ``n`` survivors of each task only."""
    kept = df.orderBy(*order).limit(n)
    return kept.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def change_history(change_events: DataFrame, *, as_of: AsOf, window_days: int = 90, event_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Changes of the window, newest first; ``limit`` is a page size."""
    df = change_events.filter(F.col("observed_at") >= instant(as_of) - days(window_days))
    if event_type:
        df = df.filter(F.col("event_type") == event_type)
    df = df.orderBy(F.col("observed_at").desc(), "promotion_id")
    return df if limit is None else df.limit(limit)


def detail_index(promotions: DataFrame, evidence: DataFrame, change_events: DataFrame) -> DataFrame:
    """Header of every promotion with its evidence count, newest evidence and number of changes."""
    ev = evidence.groupBy("promotion_id").agg(F.count(F.lit(1)).alias("evidence_rows"), F.max("captured_at").alias("newest_evidence"))
    ch = change_events.groupBy("promotion_id").agg(F.count(F.lit(1)).alias("changes"))
    df = promotions.join(ev, "promotion_id", "left").join(ch, "promotion_id", "left")
    return df.select(*promotions.columns, F.coalesce("evidence_rows", F.lit(0)).alias("evidence_rows"), "newest_evidence",
                     F.coalesce("changes", F.lit(0)).cast("bigint").alias("changes"))


def latest_changes(change_events: DataFrame, promotion_ids: DataFrame, *, keep: int = 50) -> DataFrame:
    """The newest ``keep`` changes of each requested promotion."""
    wanted = change_events.join(promotion_ids.select("promotion_id"), "promotion_id", "left_semi")
    order = W.partitionBy("promotion_id").orderBy(F.col("observed_at").desc(), "event_type", "field_name")
    return wanted.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= keep)
