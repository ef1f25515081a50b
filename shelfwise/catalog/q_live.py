"""Eligibility, ranking and lookup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.core import count_if, round_half_up
from ..functions.dates import lifecycle
from ..functions.geo import shown_channel
from ..functions.price import comparable_offer
from ..operators import gates as G, ranking as R, search as Q
from ..sources import views as V
from ..sources.tables import Tables
from .oracle import AS_OF, r
from .registry import query

GATE_COLUMNS = ["promotion_id", "source_id", "status", "start_date", "end_date", "last_verified_at", "last_seen_at",
                "has_open_conflict", "competitor_id", "brand"]


def live(t: Tables, *columns: str) -> DataFrame:
    wanted = list(dict.fromkeys(GATE_COLUMNS + list(columns)))
    return G.live(V.promotions(t, *wanted), V.evidence(t), V.sources(t), as_of=V.AS_OF)


def gated(t: Tables) -> DataFrame:
    return G.with_gates(V.promotions(t, *GATE_COLUMNS), V.evidence(t), V.sources(t), as_of=V.AS_OF)


SCORE_COLUMNS = ["promotion_type", "discount_percentage", "source_reliability", "category", "importance", "ai_confidence", "rank_score"]
_STRENGTH = """CASE WHEN promotion_type='BUY_X_GET_Y' THEN CASE WHEN d>=50 THEN 1.0 WHEN d>=33 THEN 0.9 ELSE 0.75 END
 WHEN d>=50 THEN 0.95 WHEN d>=40 THEN 0.85 WHEN d>=30 THEN 0.75 WHEN d>=20 THEN 0.6 WHEN d>=10 THEN 0.4
 WHEN promotion_type='MEMBER_PRICE' THEN 0.5 ELSE 0.3 END"""
_FRESH = f"""CASE WHEN last_verified_at>={AS_OF}-INTERVAL 1 DAY THEN 1.0 WHEN last_verified_at>={AS_OF}-INTERVAL 7 DAY THEN 0.95
 WHEN last_verified_at>={AS_OF}-INTERVAL 30 DAY THEN 0.85 WHEN last_verified_at>={AS_OF}-INTERVAL 60 DAY THEN 0.7
 WHEN last_verified_at>={AS_OF}-INTERVAL 90 DAY THEN 0.5 ELSE 0.0 END"""


def parts_sql(source: str) -> str:
    """CTE body that adds the seven component values and the score to ``source``."""
    base = ("0.0::DOUBLE+c_strength*0.25::DOUBLE+c_reliability*0.15::DOUBLE+c_freshness*0.10::DOUBLE+c_relevance*0.15::DOUBLE"
            "+c_importance*0.10::DOUBLE+c_confidence*0.10::DOUBLE+c_change*0.15::DOUBLE")
    penalised = f"least(1.0::DOUBLE,greatest(0.0::DOUBLE,({base})*(CASE WHEN start_date IS NOT NULL OR end_date IS NOT NULL THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END)))"
    return f"""SELECT *, {r(penalised, 4)} AS score FROM (
 SELECT *, ({_STRENGTH})::DOUBLE AS c_strength, least(1.0::DOUBLE,greatest(0.0::DOUBLE,source_reliability)) AS c_reliability,
  ({_FRESH})::DOUBLE AS c_freshness, CASE WHEN category IN ('BISCUIT','CRACKER','COOKIE','WAFER') THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS c_relevance,
  CASE WHEN importance IS NULL THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE,greatest(0.0::DOUBLE,importance)) END AS c_importance,
  least(1.0::DOUBLE,greatest(0.0::DOUBLE,ai_confidence)) AS c_confidence, least(1.0::DOUBLE,coalesce(impact,0.0::DOUBLE)) AS c_change
 FROM (SELECT x.*, greatest(0,coalesce(discount_percentage,0)) AS d, i.impact FROM {source} x LEFT JOIN
  (SELECT promotion_id, max(change_impact) AS impact FROM change_events WHERE observed_at>={AS_OF}-INTERVAL 7 DAY GROUP BY 1) i
  ON i.promotion_id=x.promotion_id))"""


def scored_live(t: Tables, *columns: str) -> DataFrame:
    return R.with_score(live(t, *SCORE_COLUMNS, *columns), V.change_events(t), as_of=V.AS_OF)


@query("top10_live", f"""+ scored AS ({parts_sql('live')}), top AS (SELECT * FROM scored ORDER BY score DESC, last_verified_at DESC, promotion_id LIMIT 10)
SELECT row_number() OVER (ORDER BY score DESC, last_verified_at DESC, t.promotion_id)::INTEGER AS rank, t.promotion_id, product_name, competitor, retailer, score,
 e.source_url, e.evidence_text FROM top t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY promotion_id ORDER BY captured_at DESC, created_at DESC, evidence_id DESC) rn
 FROM evidence) e ON e.promotion_id=t.promotion_id AND rn=1""", "live change_events evidence")
def top10_live(t: Tables) -> DataFrame:
    scored = scored_live(t, "product_name", "competitor", "retailer")
    best = R.top(scored, 10, F.col("score").desc(), F.col("last_verified_at").desc(), F.col("promotion_id"))
    newest = R.newest_evidence(V.evidence(t), best).select("promotion_id", "source_url", "evidence_text")
    return best.join(newest, "promotion_id", "left").select(
        "rank", "promotion_id", "product_name", "competitor", "retailer", "score", "source_url", "evidence_text")


@query("live_score_breakdown", f"""+ scored AS ({parts_sql('live')})
SELECT promotion_id, score, k AS component, {r('v', 4)} AS value, w AS weight, {r('(v*w)', 4)} AS points FROM (
 SELECT promotion_id, score, unnest(['strength','reliability','freshness','relevance','importance','confidence','change']) AS k,
  unnest([c_strength,c_reliability,c_freshness,c_relevance,c_importance,c_confidence,c_change]) AS v,
  unnest([0.25::DOUBLE,0.15::DOUBLE,0.10::DOUBLE,0.15::DOUBLE,0.10::DOUBLE,0.10::DOUBLE,0.15::DOUBLE]) AS w FROM scored)""", "live change_events")
def live_score_breakdown(t: Tables) -> DataFrame:
    rows = R.explain_scores(live(t, *SCORE_COLUMNS), V.change_events(t), as_of=V.AS_OF)
    return rows.drop("label", "note")


@query("rescore_changed", f"""+ cur AS (SELECT * FROM promotions WHERE status IN ('ACTIVE','UNKNOWN')), scored AS ({parts_sql('cur')})
SELECT promotion_id, score, abs(score-rank_score)>1e-6 AS changed FROM scored""", "promotions change_events")
def rescore_changed(t: Tables) -> DataFrame:
    p = V.promotions(t, "promotion_id", "status", "start_date", "end_date", "last_verified_at", "last_seen_at", *SCORE_COLUMNS)
    return R.rescore(p, V.change_events(t), as_of=V.AS_OF).select("promotion_id", "score", "changed")


@query("gate_failures", """+ n AS (SELECT count(*) AS total, count(*) FILTER (g_active AND g_verified AND g_evidence AND g_source AND g_conflict AND g_identity) AS shown FROM gates),
f AS (SELECT 'active' AS gate, count(*) FILTER (NOT g_active) AS failures FROM gates UNION ALL SELECT 'verified', count(*) FILTER (NOT g_verified) FROM gates
 UNION ALL SELECT 'evidence', count(*) FILTER (NOT g_evidence) FROM gates UNION ALL SELECT 'source', count(*) FILTER (NOT g_source) FROM gates
 UNION ALL SELECT 'conflict', count(*) FILTER (NOT g_conflict) FROM gates UNION ALL SELECT 'identity', count(*) FILTER (NOT g_identity) FROM gates)
SELECT gate, failures, total, shown, total-shown AS hidden FROM f, n""", "gates")
def gate_failures(t: Tables) -> DataFrame:
    return G.gate_failure_counts(gated(t))


@query("hidden_reasons", """SELECT promotion_id, gate FROM (SELECT promotion_id, unnest([CASE WHEN NOT g_active THEN 'active' END,
 CASE WHEN NOT g_verified THEN 'verified' END, CASE WHEN NOT g_evidence THEN 'evidence' END, CASE WHEN NOT g_source THEN 'source' END,
 CASE WHEN NOT g_conflict THEN 'conflict' END, CASE WHEN NOT g_identity THEN 'identity' END]) AS gate FROM gates) WHERE gate IS NOT NULL""", "gates")
def hidden_reasons(t: Tables) -> DataFrame:
    return G.hidden_reasons(gated(t)).select("promotion_id", "gate")


@query("dashboard_filtered", """SELECT promotion_id, product_name, category, competitor FROM live
WHERE contains(lower(category),'cra') OR (contains(lower(product_name),'ring') AND geography_region='JAWA')""", "live")
def dashboard_filtered(t: Tables) -> DataFrame:
    df = live(t, "product_name", "category", "competitor", "retailer", "channel", "geography", "geography_region", "promotion_type")
    crackers = Q.dashboard_filter(df, category="cra")
    rings = Q.dashboard_filter(df, q="RING", region="jawa").filter(~Q.contains("category", "cra"))
    by_name = rings.filter(Q.contains("product_name", "ring"))
    return crackers.unionByName(by_name).select("promotion_id", "product_name", "category", "competitor")


@query("channel_filtered", """SELECT 'Modern Trade' AS target, promotion_id FROM live WHERE channel='Modern Trade' OR (channel IS NULL AND retailer_channel_type IN ('MINIMARKET','SUPERMARKET'))
UNION ALL SELECT 'E-commerce', promotion_id FROM live WHERE channel='E-commerce' OR (channel IS NULL AND retailer_channel_type='ECOMMERCE')
UNION ALL SELECT 'nowhere', promotion_id FROM live WHERE channel IS NULL AND retailer_channel_type IS NULL""", "live")
def channel_filtered(t: Tables) -> DataFrame:
    df = live(t, "channel", "retailer_channel_type")
    picked = F.array_compact(F.array(*[F.when(Q.channel_condition(c), F.lit(c)) for c in ("Modern Trade", "E-commerce", "nowhere")]))
    return df.select("promotion_id", F.explode(picked).alias("target"))


_LOOKUP = """(contains(lower(product_name),'{0}') OR contains(lower(promotion_type),'{0}') OR contains(lower(category),'{0}')
 OR contains(lower(coalesce(brand,'')),'{0}') OR contains(lower(coalesce(competitor,'')),'{0}') OR contains(lower(retailer),'{0}'))"""
LOOKUP_COLUMNS = ["product_name", "promotion_type", "category", "competitor", "retailer", "channel", "retailer_channel_type", "rank_score"]


@query("lookup_terms", f"""+ hits AS (SELECT *, count(*) OVER () AS total FROM live WHERE {_LOOKUP.format('bolt')} AND {_LOOKUP.format('brand#1')})
SELECT promotion_id, product_name, total FROM hits ORDER BY last_verified_at DESC, rank_score DESC, promotion_id LIMIT 25 OFFSET 5""", "live")
def lookup_terms(t: Tables) -> DataFrame:
    hits = Q.lookup(live(t, *LOOKUP_COLUMNS), "bolt Brand#1")
    total = hits.agg(F.count(F.lit(1))).scalar()
    order = [F.col("last_verified_at").desc(), F.col("rank_score").desc(), F.col("promotion_id")]
    return Q.page(hits, limit=25, offset=5, order=order).select("promotion_id", "product_name").withColumn("total", total)


@query("lookup_by_source", """SELECT l.promotion_id, coalesce(document_source_id, l.source_id) AS resolved_source_id,
 CASE WHEN e.evidence_type='APPROVED_FIELD' THEN 'Approved field observation' ELSE s.name END AS source_name, e.source_url,
 coalesce(CASE l.channel WHEN 'Modern Trade' THEN 'Modern Trade' WHEN 'E-commerce' THEN 'E-commerce' END, CASE retailer_channel_type WHEN 'MINIMARKET' THEN 'Modern Trade'
  WHEN 'SUPERMARKET' THEN 'Modern Trade' WHEN 'ECOMMERCE' THEN 'E-commerce' WHEN 'WHOLESALE' THEN 'Wholesale' END, 'N/A') AS shown_channel
FROM live l LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY promotion_id ORDER BY captured_at DESC, created_at DESC, evidence_id DESC) rn FROM evidence) e
 ON e.promotion_id=l.promotion_id AND rn=1 LEFT JOIN crawl_documents d ON d.document_id=e.document_id
 LEFT JOIN sources s ON s.source_id=coalesce(document_source_id, l.source_id) WHERE contains(lower(retailer),'retailer_1')""", "live evidence crawl_documents sources")
def lookup_by_source(t: Tables) -> DataFrame:
    df = live(t, *LOOKUP_COLUMNS).filter(Q.contains("retailer", "retailer_1"))
    found = Q.with_evidence_source(df, V.evidence(t), V.crawl_documents(t))
    names = V.sources(t).select(F.col("source_id").alias("resolved_source_id"), F.col("name").alias("registered_name"))
    shown = F.when(F.col("evidence_type") == "APPROVED_FIELD", "Approved field observation").otherwise(F.col("registered_name"))
    return found.join(names, "resolved_source_id", "left").select(
        "promotion_id", "resolved_source_id", shown.alias("source_name"), "source_url",
        shown_channel("channel", "retailer_channel_type").alias("shown_channel"))


@query("lookup_from_source", """SELECT l.promotion_id, e.source_url FROM live l LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY promotion_id ORDER BY captured_at DESC, created_at DESC, evidence_id DESC) rn FROM evidence) e
 ON e.promotion_id=l.promotion_id AND rn=1 LEFT JOIN crawl_documents d ON d.document_id=e.document_id WHERE coalesce(document_source_id, l.source_id)=7""", "live evidence crawl_documents")
def lookup_from_source(t: Tables) -> DataFrame:
    return Q.from_source(Q.with_evidence_source(live(t, *LOOKUP_COLUMNS), V.evidence(t), V.crawl_documents(t)), 7).select("promotion_id", "source_url")


@query("strict_valid", f"""SELECT promotion_id FROM promotions WHERE status IN ('ACTIVE','UNKNOWN') AND NOT has_open_conflict
 AND (start_date IS NULL OR start_date<={AS_OF}) AND (end_date IS NULL OR end_date>={AS_OF})
 AND last_verified_at>={AS_OF}-(CASE WHEN start_date IS NULL AND end_date IS NULL THEN INTERVAL 14 DAY ELSE INTERVAL 90 DAY END)""", "promotions")
def strict_valid(t: Tables) -> DataFrame:
    p = V.promotions(t, "promotion_id", "status", "has_open_conflict", "start_date", "end_date", "last_verified_at", "last_seen_at")
    return p.filter(G.strictly_valid(V.AS_OF)).select("promotion_id")


@query("comparable_offers", """SELECT promotion_type, count(*) AS offers, count(*) FILTER (promotion_type<>'MEMBER_PRICE' AND coalesce(minimum_purchase_amount,0)=0
 AND (coalesce(minimum_purchase_quantity,0)=0 OR promotion_type='BUY_X_GET_Y')) AS comparable FROM promotions GROUP BY 1""", "promotions")
def comparable_offers(t: Tables) -> DataFrame:
    p = V.promotions(t, "promotion_type", "currency", "minimum_purchase_amount", "minimum_purchase_quantity")
    return p.groupBy("promotion_type").agg(F.count(F.lit(1)).alias("offers"), count_if(comparable_offer()).alias("comparable"))


@query("validity_classes", f"""SELECT validity_status, count(*) AS offers, count(*) FILTER (start_date IS NOT NULL OR end_date IS NOT NULL) AS stated,
 count(*) FILTER (end_date<={AS_OF}+INTERVAL 7 DAY) AS expiring, coalesce(CAST(sum(CASE WHEN end_date IS NOT NULL THEN greatest(0, date_diff('day', CAST({AS_OF} AS DATE), CAST(end_date AS DATE))) END) AS BIGINT),0) AS days_left FROM (
 SELECT *, CASE WHEN end_date<={AS_OF}+INTERVAL 7 DAY THEN 'EXPIRING_SOON' WHEN start_date IS NOT NULL OR end_date IS NOT NULL THEN 'ACTIVE' ELSE 'ONGOING' END AS validity_status FROM live) GROUP BY 1""", "live")
def validity_classes(t: Tables) -> DataFrame:
    from ..functions.dates import days_left
    df = live(t).withColumn("validity_status", G.validity_status(V.AS_OF))
    return df.groupBy("validity_status").agg(
        F.count(F.lit(1)).alias("offers"), count_if(G.validity_filter("STATED_DATES", V.AS_OF)).alias("stated"),
        count_if(G.validity_filter("EXPIRING_SOON", V.AS_OF)).alias("expiring"),
        F.coalesce(F.sum(F.when(F.col("end_date").isNotNull(), days_left("end_date", V.AS_OF))), F.lit(0)).alias("days_left"))


@query("lifecycle_class", f"""SELECT CASE WHEN start_date IS NULL AND end_date IS NULL THEN 'UNKNOWN' WHEN TIMESTAMP '2000-06-01'<start_date THEN 'UPCOMING'
 WHEN TIMESTAMP '2000-06-01'>end_date THEN 'EXPIRED' ELSE 'ACTIVE' END AS lifecycle, count(*) AS promotions FROM promotions GROUP BY 1""", "promotions")
def lifecycle_class(t: Tables) -> DataFrame:
    p = V.promotions(t, "start_date", "end_date").select(lifecycle("start_date", "end_date", "2000-06-01 00:00:00").alias("lifecycle"))
    return p.groupBy("lifecycle").agg(F.count(F.lit(1)).alias("promotions"))


@query("lifecycle_sweep", f"""+ before AS (SELECT p.*, s.last_processed_at AS done, CASE WHEN start_date IS NULL AND end_date IS NULL THEN 'UNKNOWN' WHEN TIMESTAMP '2000-10-01'<start_date THEN 'UPCOMING'
 WHEN TIMESTAMP '2000-10-01'>end_date THEN 'EXPIRED' ELSE 'ACTIVE' END AS old FROM promo_base p LEFT JOIN sources s ON s.source_id=p.source_id),
a AS (SELECT *, CASE WHEN old IN ('ACTIVE','UNKNOWN','UPCOMING') AND end_date<{AS_OF} THEN 'EXPIRED' WHEN old='UPCOMING' AND start_date<={AS_OF} THEN 'ACTIVE'
 WHEN old='ACTIVE' AND start_date>{AS_OF} THEN 'UPCOMING' ELSE old END AS mid FROM before),
b AS (SELECT old, CASE WHEN mid IN ('ACTIVE','UNKNOWN') AND end_date IS NULL AND done>last_verified_at+INTERVAL 14 DAY THEN 'NOT_LISTED' ELSE mid END AS new FROM a)
SELECT old AS status, new AS new_status, count(*) AS moved, count(*) FILTER (new<>'UPCOMING') AS counted FROM b WHERE old<>new GROUP BY 1,2""", "promo_base sources")
def lifecycle_sweep(t: Tables) -> DataFrame:
    p = V.promotions(t, "promotion_id", "source_id", "start_date", "end_date", "last_verified_at")
    p = p.withColumn("status", lifecycle("start_date", "end_date", "2000-10-01 00:00:00"))
    return G.transition_counts(G.advance_lifecycle(p, V.sources(t), as_of=V.AS_OF))


_HEALTH = f"""CASE WHEN approval_status='CANDIDATE' THEN 'AWAITING_APPROVAL' WHEN approval_status='REJECTED' THEN 'REJECTED' WHEN NOT is_active THEN 'DISABLED'
 WHEN last_crawled_at IS NULL THEN 'NEVER_SCANNED' WHEN last_error_at IS NOT NULL AND (last_success_at IS NULL OR last_error_at>last_success_at) THEN 'FAILING'
 WHEN last_success_at<{AS_OF}-INTERVAL 3 DAY THEN 'STALE' ELSE 'OK' END"""


@query("source_health", f"SELECT source_id, name, domain, {_HEALTH} AS health, crawl_frequency_minutes, last_processed_at FROM sources WHERE approval_status='APPROVED'", "sources")
def source_health(t: Tables) -> DataFrame:
    return V.sources(t).filter(F.col("approval_status") == "APPROVED").select(
        "source_id", "name", "domain", G.source_health(V.AS_OF).alias("health"), "crawl_frequency_minutes", "last_processed_at").orderBy("name")


@query("due_sources", f"""SELECT source_id, name, priority FROM sources WHERE is_active AND approval_status='APPROVED' AND adapter_key IS NOT NULL
 AND (last_crawled_at IS NULL OR last_crawled_at+to_minutes(crawl_frequency_minutes)<={AS_OF})""", "sources")
def due_sources(t: Tables) -> DataFrame:
    return G.due_sources(V.sources(t), as_of=V.AS_OF).select("source_id", "name", "priority")


@query("health_histogram", f"SELECT {_HEALTH} AS health, count(*) AS sources FROM sources WHERE approval_status='APPROVED' AND is_active GROUP BY 1", "sources")
def health_histogram(t: Tables) -> DataFrame:
    ready = V.sources(t).filter((F.col("approval_status") == "APPROVED") & F.col("is_active"))
    return ready.groupBy(G.source_health(V.AS_OF).alias("health")).agg(F.count(F.lit(1)).alias("sources"))


@query("source_readiness", f"""+ h AS (SELECT *, {_HEALTH} AS health FROM sources), bad AS (SELECT name FROM h WHERE approval_status='APPROVED' AND is_active AND health IN ('FAILING','STALE') ORDER BY name LIMIT 5)
SELECT (SELECT count(*) FROM h WHERE approval_status='APPROVED' AND is_active) AS approved_active, (SELECT count(*) FROM h WHERE approval_status='CANDIDATE') AS candidates,
 (SELECT count(*) FROM h WHERE approval_status='APPROVED' AND is_active AND health IN ('FAILING','STALE')) AS unhealthy,
 (SELECT string_agg(name, ', ' ORDER BY name) FROM bad) AS first_unhealthy""", "sources")
def source_readiness(t: Tables) -> DataFrame:
    from ..operators.reports import source_readiness as readiness
    return readiness(V.sources(t), as_of=V.AS_OF)
