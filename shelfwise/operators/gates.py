"""Eligibility: one gate definition drives the live filter, the explanation and the counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import RECENCY_DAYS, UNDATED_RECENCY_DAYS, NOT_LISTED_GRACE_DAYS, STALE_SOURCE_DAYS
from ..functions.core import AsOf, col, count_if, days, instant

# Gate key -> (what is wrong, what to do).
GATE_TEXT = {
    "active": ("Not currently active", "Nothing to fix: it returns if it is seen again."),
    "verified": ("Not verified recently", "Check that its source is being scanned successfully."),
    "evidence": ("No stored evidence text", "Re-run a scan; a verbatim quote is required."),
    "source": ("Source is not approved and active", "Approve or resume the website."),
    "conflict": ("Two sources disagree", "Decide the open conflict."),
    "identity": ("No competitor or brand matched", "Confirm the match or add the entity."),
    "geography": ("Validity area not stated", "Allow unstated geography to show it."),
}


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def row_gates(as_of: AsOf, *, recency_days: int = RECENCY_DAYS, require_identity: bool = True,
              require_geography: bool = False, raw: bool = False) -> dict[str, Column]:
    """Gates that need only the promotion row. These push down to the scan."""
    now = instant(as_of)
    dated = (F.col("status") == "ACTIVE") & (F.col("start_date").isNull() | (F.col("start_date") <= now)) & (
        F.col("end_date").isNull() | (F.col("end_date") >= now))
    undated = (F.col("status") == "UNKNOWN") & F.col("start_date").isNull() & F.col("end_date").isNull()
    gates = {
        "active": dated | undated,
        "verified": F.col("last_verified_at") >= now - days(recency_days),
        "conflict": ~F.col("has_open_conflict"),
    }
    if require_identity:
        gates["identity"] = F.col("competitor_id").isNotNull() | F.col("brand").isNotNull()
    if require_geography:
        gates["geography"] = ~F.col("geography_region").isin("UNKNOWN", "UNMAPPED")
    return gates if raw else {key: _true(gate) for key, gate in gates.items()}


def evidence_flags(evidence: DataFrame) -> DataFrame:
    """Per promotion: is there readable evidence, is there approved field evidence (combines map-side)."""
    return evidence.groupBy("promotion_id").agg(
        F.max(F.length(F.trim(F.col("evidence_text"))) > 0).alias("has_evidence"),
        F.max(F.col("evidence_type") == "APPROVED_FIELD").alias("has_field_evidence"))


def approved_sources(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("is_active") & (F.col("approval_status") == "APPROVED")).select(
        F.col("source_id").alias("approved_source_id")).distinct()


def _join_flags(promotions: DataFrame, flags: DataFrame, sources: DataFrame) -> DataFrame:
    ok = approved_sources(sources)
    joined = promotions.join(flags, "promotion_id", "left").join(
        ok, F.col("source_id") == F.col("approved_source_id"), "left")
    return joined.withColumns({
        "gate_evidence": _true(F.col("has_evidence")),
        "gate_source": _true(F.col("has_field_evidence")) | F.col("approved_source_id").isNotNull(),
    }).drop("has_evidence", "approved_source_id")


def with_gates(promotions: DataFrame, evidence: DataFrame, sources: DataFrame, *, as_of: AsOf,
               recency_days: int = RECENCY_DAYS, require_identity: bool = True, require_geography: bool = False) -> DataFrame:
    """Every promotion with one boolean ``gate_*`` column per rule and the conjunction ``is_live``."""
    gates = row_gates(as_of, recency_days=recency_days, require_identity=require_identity, require_geography=require_geography)
    df = _join_flags(promotions, evidence_flags(evidence), sources)
    df = df.withColumns({f"gate_{key}": gate for key, gate in gates.items()})
    names = [f"gate_{key}" for key in GATE_TEXT if f"gate_{key}" in df.columns]
    return df.withColumn("is_live", reduce(lambda a, b: a & b, [F.col(n) for n in names])).drop("has_field_evidence")


def live(promotions: DataFrame, evidence: DataFrame, sources: DataFrame, *, as_of: AsOf, recency_days: int = RECENCY_DAYS,
         require_identity: bool = True, require_geography: bool = False) -> DataFrame:
    """Only promotions that pass every gate. Adds ``has_field_evidence``.

    The row gates filter first, at the scan. Evidence is reduced to two flags per
    promotion before the join; with selective row gates Spark's runtime bloom
    filter drops evidence of other promotions ahead of that shuffle.
    """
    gates = row_gates(as_of, recency_days=recency_days, require_identity=require_identity, require_geography=require_geography, raw=True)
    candidates = promotions
    for gate in gates.values():  # plain comparisons, one filter each, so the ones on stored columns reach the scan
        candidates = candidates.filter(gate)
    useful = evidence.filter((F.length(F.trim(F.col("evidence_text"))) > 0) | (F.col("evidence_type") == "APPROVED_FIELD"))
    df = _join_flags(candidates, evidence_flags(useful), sources)
    return df.filter(F.col("gate_evidence") & F.col("gate_source")).drop("gate_evidence", "gate_source").withColumn(
        "has_field_evidence", _true(F.col("has_field_evidence")))


def hidden_reasons(gated: DataFrame) -> DataFrame:
    """One row per promotion and failed gate."""
    names = [key for key in GATE_TEXT if f"gate_{key}" in gated.columns]
    failed = F.array_compact(F.array(*[
        F.when(~F.col(f"gate_{key}"), F.struct(F.lit(key).alias("gate"), F.lit(GATE_TEXT[key][0]).alias("label"),
                                              F.lit(GATE_TEXT[key][1]).alias("fix"))) for key in names]))
    return gated.select("promotion_id", F.explode(failed).alias("r")).select("promotion_id", "r.gate", "r.label", "r.fix")


def gate_failure_counts(gated: DataFrame) -> DataFrame:
    """Per gate: rows failing it (a promotion can fail several), with total, shown and hidden."""
    names = [key for key in GATE_TEXT if f"gate_{key}" in gated.columns]
    one = gated.agg(F.count(F.lit(1)).alias("total"), count_if(F.col("is_live")).alias("shown"),
                    *[count_if(~F.col(f"gate_{key}")).alias(key) for key in names])
    pairs = F.array(*[F.struct(F.lit(key).alias("gate"), F.col(key).alias("failures")) for key in names])
    return one.select("total", "shown", (F.col("total") - F.col("shown")).alias("hidden"), F.explode(pairs).alias("g")).select(
        "g.gate", "g.failures", "total", "shown", "hidden")


def strictly_valid(as_of: AsOf, *, undated_days: int = UNDATED_RECENCY_DAYS, max_days: int = RECENCY_DAYS) -> Column:
    """Stricter than live: undated offers must have been verified within ``undated_days``."""
    now = instant(as_of)
    verified = F.coalesce(F.col("last_verified_at"), F.col("last_seen_at"))
    undated = F.col("start_date").isNull() & F.col("end_date").isNull()
    window = (F.col("start_date").isNull() | (F.col("start_date") <= now)) & (F.col("end_date").isNull() | (F.col("end_date") >= now))
    fresh = F.when(undated, verified >= now - days(undated_days)).otherwise(verified >= now - days(max_days))
    return _true(F.col("status").isin("ACTIVE", "UNKNOWN") & ~F.coalesce(F.col("has_open_conflict"), F.lit(False)) & window & fresh)


def validity_filter(kind: str | None, as_of: AsOf) -> Column:
    """STATED_DATES, ONGOING or EXPIRING_SOON; everything when ``kind`` is None."""
    stated = F.col("start_date").isNotNull() | F.col("end_date").isNotNull()
    if kind == "STATED_DATES":
        return stated
    if kind == "ONGOING":
        return ~stated
    if kind == "EXPIRING_SOON":
        return _true(F.col("end_date") <= instant(as_of) + days(7))
    return F.lit(True)


def validity_status(as_of: AsOf) -> Column:
    return (F.when(F.col("end_date") <= instant(as_of) + days(7), "EXPIRING_SOON")
            .when(F.col("end_date").isNotNull() | F.col("start_date").isNotNull(), "ACTIVE").otherwise("ONGOING"))


def advance_lifecycle(promotions: DataFrame, sources: DataFrame, *, as_of: AsOf,
                      grace_days: int = NOT_LISTED_GRACE_DAYS) -> DataFrame:
    """Adds ``new_status``: one pass in the order expire, activate, demote, unlist.

    A source that failed or was never processed proves nothing, so only a later
    successful run can turn a promotion NOT_LISTED.
    """
    now, grace = instant(as_of), days(grace_days)
    seen = sources.select(F.col("source_id").alias("sk"), F.col("last_processed_at").alias("source_processed_at"))
    df = promotions.join(seen, F.col("source_id") == F.col("sk"), "left").drop("sk")
    status, start, end = F.col("status"), F.col("start_date"), F.col("end_date")
    expired = status.isin("ACTIVE", "UNKNOWN", "UPCOMING") & (end < now)
    step1 = F.when(expired, "EXPIRED").otherwise(status)
    step2 = F.when((step1 == "UPCOMING") & (start <= now) & (end.isNull() | (end >= now)), "ACTIVE").otherwise(step1)
    step3 = F.when((step2 == "ACTIVE") & (start > now), "UPCOMING").otherwise(step2)
    gone = F.when(F.col("source_id").isNull(), F.col("last_verified_at") < now - grace).otherwise(
        F.col("source_processed_at") > F.col("last_verified_at") + grace)
    final = F.when(step3.isin("ACTIVE", "UNKNOWN") & end.isNull() & gone, "NOT_LISTED").otherwise(step3)
    return df.withColumn("new_status", final).drop("source_processed_at")


def transition_counts(advanced: DataFrame) -> DataFrame:
    moved = advanced.filter(F.col("status") != F.col("new_status"))
    return moved.groupBy("status", "new_status").agg(F.count(F.lit(1)).alias("moved"),
                                                     count_if(F.col("new_status") != "UPCOMING").alias("counted"))


def source_health(as_of: AsOf) -> Column:
    """Health class of a source row."""
    error, success = F.col("last_error_at"), F.col("last_success_at")
    return (
        F.when(F.col("approval_status") == "CANDIDATE", "AWAITING_APPROVAL")
        .when(F.col("approval_status") == "REJECTED", "REJECTED")
        .when(~F.col("is_active"), "DISABLED")
        .when(F.col("last_crawled_at").isNull(), "NEVER_SCANNED")
        .when(error.isNotNull() & (success.isNull() | (error > success)), "FAILING")
        .when(success < instant(as_of) - days(STALE_SOURCE_DAYS), "STALE")
        .otherwise("OK"))


def due_sources(sources: DataFrame, *, as_of: AsOf) -> DataFrame:
    minutes = F.coalesce(F.when(F.col("crawl_frequency_minutes") > 0, F.col("crawl_frequency_minutes")), F.lit(1440))
    due = F.col("last_crawled_at").isNull() | (
        F.col("last_crawled_at") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int")) <= instant(as_of))
    ready = F.col("is_active") & (F.col("approval_status") == "APPROVED") & F.col("adapter_key").isNotNull()
    return sources.filter(ready & due).orderBy("priority", "name", "source_id")
