"""Observation fold, change detection, arbitration, identity and lineage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.core import count_if, round_half_up
from ..functions.dates import periods_compatible
from ..functions.identity import compact, identity_fingerprint, source_identity_fingerprint
from ..operators import canonical as K, ranking as R
from ..sources import views as V
from ..sources.staging import stage
from ..sources.tables import Tables
from .oracle import PID, r
from .registry import query

FIELDS = ["regular_price", "discount_percentage", "promotion_type", "end_date"]
_OBS = f"""obs AS (SELECT l_partkey AS k, {PID} AS id, l_orderkey AS document_id, l_shipdate AS seen, l_suppkey AS src, CASE WHEN l_tax<>0.04::DOUBLE THEN {r('(l_extendedprice/l_quantity)', 2)} END AS reg, CASE WHEN l_linenumber<>2 THEN {r('(l_discount*500.0::DOUBLE)', 1)} END AS dis,
 CASE l_returnflag WHEN 'R' THEN 'BUY_X_GET_Y' WHEN 'A' THEN 'MEMBER_PRICE' ELSE 'DISCOUNT' END AS mech, CASE WHEN l_linestatus='O' THEN CAST(l_shipdate AS DATE) END AS fin, 0.6::DOUBLE+l_discount*4.0::DOUBLE AS conf,
 row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, {PID}) AS rn FROM lineitem)"""
_MAT = """coalesce(abs(f.reg-o.reg)/abs(f.reg)>0.01, false) OR coalesce(abs(f.dis-o.dis)>=1.0, false) OR o.mech<>f.mech OR (o.fin IS NOT NULL AND o.fin IS DISTINCT FROM f.fin)"""
_VERDICT = f"""CASE WHEN NOT ({_MAT}) OR f.src=o.src OR o.seen-f.ver>INTERVAL 7 DAY OR o.rel-f.rel>=0.15 THEN 'APPLY' WHEN o.rel-f.rel<=-0.15 THEN 'KEEP' ELSE 'REVIEW' END"""
_CHG = """(CASE WHEN o.reg IS NOT NULL AND o.reg IS DISTINCT FROM f.reg THEN 1 ELSE 0 END + CASE WHEN o.dis IS NOT NULL AND o.dis IS DISTINCT FROM f.dis THEN 1 ELSE 0 END + CASE WHEN o.mech<>f.mech THEN 1 ELSE 0 END + CASE WHEN o.fin IS NOT NULL AND o.fin IS DISTINCT FROM f.fin THEN 1 ELSE 0 END)"""
_FOLD = f"""{_OBS}, ox AS (SELECT obs.*, coalesce(reliability_score,0.85::DOUBLE) AS rel FROM obs LEFT JOIN sources s ON s.source_id=obs.src),
f AS (SELECT k, rn, id, seen, reg, dis, mech, fin, src, seen AS ver, rel, conf, 'APPLY' AS verdict, 0 AS chg, src AS osrc, rel AS orel FROM ox WHERE rn=1
 UNION ALL SELECT k, rn, id, seen, CASE WHEN v='APPLY' THEN coalesce(nreg,reg) ELSE reg END, CASE WHEN v='APPLY' THEN coalesce(ndis,dis) ELSE dis END, CASE WHEN v='APPLY' THEN nmech ELSE mech END, CASE WHEN v='APPLY' THEN coalesce(nfin,fin) ELSE fin END,
  CASE WHEN v='APPLY' THEN nsrc ELSE src END, CASE WHEN v='APPLY' THEN seen ELSE ver END, CASE WHEN v='APPLY' THEN nrel ELSE rel END, conf, v, CASE WHEN v='APPLY' THEN c ELSE 0 END, nsrc, nrel FROM (
  SELECT o.k, o.rn, o.id, o.seen, f.reg, f.dis, f.mech, f.fin, f.src, f.ver, f.rel, o.conf, o.reg AS nreg, o.dis AS ndis, o.mech AS nmech, o.fin AS nfin, o.src AS nsrc, o.rel AS nrel, {_VERDICT} AS v, {_CHG} AS c FROM f JOIN ox o ON o.k=f.k AND o.rn=f.rn+1))"""


def folded(t: Tables) -> DataFrame:
    return K.fold_observations(V.observations(t), V.sources(t), FIELDS)


@query("canonical_fold", f"""+ /*recursive*/ {_FOLD}, l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rn DESC) rd FROM f)
SELECT l.k AS fold_key, l.reg AS regular_price, l.dis AS discount_percentage, l.mech AS promotion_type, CAST(l.fin AS VARCHAR) AS end_date, l.src AS source_id, l.ver AS last_verified_at, g.first_seen_at, g.last_seen_at, g.observations, g.source_reliability, g.ai_confidence, g.has_open_conflict
FROM l JOIN (SELECT k, min(seen) AS first_seen_at, max(seen) AS last_seen_at, count(*) AS observations, max(orel) FILTER (verdict='APPLY') AS source_reliability, max(conf) FILTER (verdict='APPLY') AS ai_confidence, bool_or(verdict='REVIEW') AS has_open_conflict FROM f GROUP BY 1) g ON g.k=l.k WHERE rd=1""", "sources")
def canonical_fold(t: Tables) -> DataFrame:
    return K.canonical_state(folded(t), FIELDS).withColumn("end_date", F.col("end_date").cast("string"))


@query("arbitration_verdicts", f"+ /*recursive*/ {_FOLD} SELECT id AS observation_id, verdict, CAST(chg AS BIGINT) AS changes FROM f", "sources")
def arbitration_verdicts(t: Tables) -> DataFrame:
    return folded(t).select("observation_id", "verdict", F.size("changed").cast("bigint").alias("changes"))


@query("change_feed", f"""+ /*recursive*/ {_FOLD} SELECT CASE WHEN rn=1 THEN 'CREATED' WHEN verdict<>'APPLY' THEN 'HELD' WHEN chg>0 THEN 'CHANGED' ELSE 'OBSERVED' END AS event_type, count(*) AS observations, CAST(sum(chg) AS BIGINT) AS changed_fields FROM f GROUP BY 1""", "sources")
def change_feed(t: Tables) -> DataFrame:
    kind = (F.when(F.col("created"), "CREATED").when(F.col("verdict") != "APPLY", "HELD").when(F.size("changed") > 0, "CHANGED").otherwise("OBSERVED"))
    return folded(t).groupBy(kind.alias("event_type")).agg(F.count(F.lit(1)).alias("observations"), F.sum(F.size("changed")).alias("changed_fields"))


@query("change_event_log", f"""+ /*recursive*/ {_FOLD} SELECT id AS observation_id, CASE WHEN rn=1 THEN 'CREATED' ELSE 'CHANGED' END AS kind, CAST(CASE WHEN rn=1 THEN 1 ELSE chg END AS BIGINT) AS events FROM f WHERE seen>=TIMESTAMP '1998-01-01' AND (rn=1 OR chg>0)""", "sources")
def change_event_log(t: Tables) -> DataFrame:
    """All sightings are fed twice into a log that holds the events before 1998: only later ones are new, each once."""
    rows = K.change_rows(folded(t)).select("fingerprint", "observation_id", "observed_at", "event_type")  # all that the log below reads
    events = stage(compact(rows, "fingerprint"), "events")
    known = events.filter(F.col("observed_at") < F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
    fresh = K.new_events(events.unionByName(events), known)
    kind = F.when(F.col("event_type") == "CREATED", "CREATED").otherwise("CHANGED")
    return fresh.groupBy("observation_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("events"))


_GIFT = "l_returnflag='R'"
_PRICE = r("(l_extendedprice/l_quantity)", 2)
#: Tracked field: its SQL over lineitem.
_FULL = {
    "regular_price": f"CASE WHEN l_tax<>0.04::DOUBLE THEN {_PRICE} END", "promo_price": f"CASE WHEN l_returnflag NOT IN ('R','A') AND l_tax<>0.02::DOUBLE THEN {r(f'({_PRICE}*(1.0::DOUBLE-l_discount))', 2)} END",
    "discount_percentage": f"CASE WHEN l_linenumber<>2 THEN {r('(l_discount*500.0::DOUBLE)', 1)} END", "promotion_type": "CASE l_returnflag WHEN 'R' THEN 'BUY_X_GET_Y' WHEN 'A' THEN 'MEMBER_PRICE' ELSE 'DISCOUNT' END",
    "buy_quantity": f"CASE WHEN {_GIFT} THEN CAST(2+l_linenumber%2 AS INTEGER) END", "free_quantity": f"CASE WHEN {_GIFT} THEN 1 END", "bundle_quantity": "CASE WHEN CAST(l_quantity AS INTEGER)%10=0 THEN CAST(l_quantity AS INTEGER)//10 END",
    "cashback_amount": "CASE WHEN CAST(l_quantity AS INTEGER)%7=0 THEN l_linenumber*1000.0::DOUBLE END", "voucher_amount": "CASE WHEN CAST(l_quantity AS INTEGER)%11=0 THEN l_linenumber*500.0::DOUBLE END",
    "minimum_purchase_amount": "CASE WHEN l_tax=0.06::DOUBLE THEN l_linenumber*10000.0::DOUBLE END", "minimum_purchase_quantity": "CASE WHEN l_tax=0.07::DOUBLE THEN CAST(l_linenumber AS INTEGER) END",
    "gift_description": "CASE WHEN CAST(l_quantity AS INTEGER)%13=0 THEN concat('gift ',l_linenumber) END", "channel": "CASE l_suppkey%3 WHEN 0 THEN 'ONLINE' WHEN 1 THEN 'IN_STORE' END",
    "geography": "CASE WHEN l_suppkey%4<>0 THEN concat('area ',l_suppkey%4) END", "start_date": "CASE WHEN l_linenumber<>5 THEN CAST(date_trunc('month',l_shipdate) AS DATE) END",
    "end_date": "CASE WHEN l_linestatus='O' THEN CAST(l_shipdate AS DATE) END"}


def _full_fold(key: str) -> str:
    """The fold over all tracked fields in SQL: one row per observation in order, values after it, changes that were made or held back."""
    fields = list(_FULL)
    new = {f: f"o.{f} IS NOT NULL AND o.{f} IS DISTINCT FROM f.{f}" for f in fields}
    matters = {f: f"coalesce({new[f]}" + (f" AND (f.{f}=0 OR abs(f.{f}-o.{f})/abs(f.{f})>0.01)" if f in K.RELATIVE else f" AND abs(f.{f}-o.{f})>=1.0" if f == "discount_percentage" else "") + ", false)"
               for f in fields if f in K.EXACT + K.RELATIVE + ["discount_percentage"]}
    listed = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, c in matters.items()) + "], lambda x: x IS NOT NULL)"
    count = "+".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in new.values())
    verdict = f"CASE WHEN len({listed})=0 OR f.src=o.src OR o.seen-f.ver>INTERVAL 7 DAY OR o.rel-f.rel>=0.15 THEN 'APPLY' WHEN o.rel-f.rel<=-0.15 THEN 'KEEP' ELSE 'REVIEW' END"
    raw = ", ".join(f"{sql} AS {f}" for f, sql in _FULL.items())
    after = ", ".join(f"CASE WHEN v='APPLY' THEN coalesce(n_{f}, {f}) ELSE {f} END" for f in fields)
    return f"""obs AS (SELECT {key} AS k, {PID} AS id, l_shipdate AS seen, l_suppkey AS src, {raw}, row_number() OVER (PARTITION BY {key} ORDER BY l_shipdate, {PID}) AS rn FROM lineitem),
ox AS (SELECT obs.*, coalesce(reliability_score,0.85::DOUBLE) AS rel FROM obs LEFT JOIN sources s ON s.source_id=obs.src),
f AS (SELECT k, rn, id, {', '.join(fields)}, src, seen AS ver, rel, 'APPLY' AS verdict, 0 AS chg, CAST([] AS VARCHAR[]) AS back FROM ox WHERE rn=1
 UNION ALL SELECT k, rn, id, {after}, CASE WHEN v='APPLY' THEN nsrc ELSE src END, CASE WHEN v='APPLY' THEN seen ELSE ver END, CASE WHEN v='APPLY' THEN nrel ELSE rel END, v, CASE WHEN v='APPLY' THEN c ELSE 0 END, CASE WHEN v='APPLY' THEN CAST([] AS VARCHAR[]) ELSE l END FROM (
  SELECT o.k, o.rn, o.id, o.seen, {', '.join(f'f.{f}, o.{f} AS n_{f}' for f in fields)}, f.src, f.ver, f.rel, o.src AS nsrc, o.rel AS nrel, {verdict} AS v, {count} AS c, {listed} AS l FROM f JOIN ox o ON o.k=f.k AND o.rn=f.rn+1))"""


_CROWD = "CASE WHEN l_orderkey%10=0 THEN -1 ELSE l_partkey END"


@query("fold_hot_identity", f"+ /*recursive*/ {_full_fold(_CROWD)} SELECT id AS observation_id, verdict, CAST(chg AS BIGINT) AS changes, array_to_string(back, ',') AS held_back, CAST(src AS BIGINT) AS state_source_id, regular_price, promo_price, discount_percentage, CAST(buy_quantity AS VARCHAR) AS buy_quantity, cashback_amount, channel, geography, CAST(start_date AS VARCHAR) AS start_date FROM f", "sources")
def fold_hot_identity(t: Tables) -> DataFrame:
    """A tenth of all sightings belong to one identity; its history folds in pieces."""
    rows = K.fold_observations(V.full_observations(t, crowd=True), V.sources(t), K.TRACKED, piece_rows=500)
    state = lambda *names: [F.col(f"state_{n}").alias(n) for n in names]
    return rows.select("observation_id", "verdict", F.size("changed").cast("bigint").alias("changes"), F.array_join(F.transform("held_back", lambda c: c["field"]), ",").alias("held_back"),
                       F.col("state_source_id").cast("bigint").alias("state_source_id"), *state("regular_price", "promo_price", "discount_percentage", "cashback_amount", "channel", "geography"), F.col("state_buy_quantity").cast("string").alias("buy_quantity"),
                       F.col("state_start_date").cast("string").alias("start_date"))


_VALUE = "CASE field " + " ".join(f"WHEN '{f}' THEN CAST({{0}}.{f} AS VARCHAR)" for f in _FULL) + " END"


@query("conflict_reviews", f"""+ /*recursive*/ {_full_fold('l_partkey')} SELECT x.id AS observation_id, field, concat('Two sources of like reliability differ on ', array_to_string(back, ', ')) AS reason, CAST(x.src AS BIGINT) AS current_source_id, CAST(new_src AS BIGINT) AS new_source_id,
 {_VALUE.format('x')} AS current_value, {_VALUE.format('y')} AS new_value FROM (SELECT f.*, o.src AS new_src, unnest(back) AS field FROM f JOIN obs o ON o.id=f.id WHERE verdict='REVIEW') x JOIN obs y ON y.id=x.id""", "sources")
def conflict_reviews(t: Tables) -> DataFrame:
    rows = K.fold_observations(V.full_observations(t), V.sources(t), K.TRACKED)
    return K.conflict_reviews(rows).select("observation_id", "field", "reason", F.col("current_source_id").cast("bigint").alias("current_source_id"),
                                           F.col("new_source_id").cast("bigint").alias("new_source_id"), "current_value", "new_value")


_LAG = f"""{_OBS}, b AS (SELECT *, last_value(reg IGNORE NULLS) OVER w AS preg, last_value(dis IGNORE NULLS) OVER w AS pdis, lag(mech) OVER (PARTITION BY k ORDER BY rn) AS pmech, last_value(fin IGNORE NULLS) OVER w AS pfin FROM obs WINDOW w AS (PARTITION BY k ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT id, k, 'regular_price' AS field, 'PRICE_OR_VALUE_CHANGED' AS event_type, coalesce(abs(preg-reg)/abs(preg)>0.01,false) AS material FROM b WHERE rn>1 AND reg IS NOT NULL AND reg IS DISTINCT FROM preg UNION ALL
 SELECT id, k, 'discount_percentage', 'PRICE_OR_VALUE_CHANGED', coalesce(abs(pdis-dis)>=1.0,false) FROM b WHERE rn>1 AND dis IS NOT NULL AND dis IS DISTINCT FROM pdis UNION ALL
 SELECT id, k, 'promotion_type', 'MECHANIC_CHANGED', true FROM b WHERE rn>1 AND mech<>pmech UNION ALL SELECT id, k, 'end_date', 'DATES_CHANGED', true FROM b WHERE rn>1 AND fin IS NOT NULL AND fin IS DISTINCT FROM pfin)"""


@query("field_changes", f"WITH {_LAG} SELECT id AS observation_id, field, event_type FROM c")
def field_changes(t: Tables) -> DataFrame:
    return K.lag_changes(V.observations(t), FIELDS).select("observation_id", "field", "event_type")


@query("material_changes", f"WITH {_LAG} SELECT field, count(*) AS changes, count(*) FILTER (material) AS material FROM c GROUP BY 1")
def material_changes(t: Tables) -> DataFrame:
    return K.lag_changes(V.observations(t), FIELDS).groupBy("field").agg(F.count(F.lit(1)).alias("changes"), count_if(F.col("material")).alias("material"))


@query("change_impact", f"""WITH {_LAG} SELECT id AS observation_id, {r("least(1.0::DOUBLE, sum(CASE event_type WHEN 'PRICE_OR_VALUE_CHANGED' THEN 0.40::DOUBLE WHEN 'MECHANIC_CHANGED' THEN 0.35::DOUBLE ELSE 0.20::DOUBLE END))", 4)} AS impact FROM c GROUP BY 1""")
def change_impact(t: Tables) -> DataFrame:
    return K.change_impact(K.lag_changes(V.observations(t), FIELDS), ["observation_id"])


@query("latest_observation", f"WITH {_OBS} SELECT k AS fold_key, id AS observation_id, seen AS observed_at FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rn DESC) rd FROM obs) WHERE rd=1")
def latest_observation(t: Tables) -> DataFrame:
    return R.newest_per_key(V.observations(t), "fold_key", F.col("observed_at").desc(), F.col("observation_id").desc()).select("fold_key", "observation_id", "observed_at")


@query("conflict_replay", f"""+ /*recursive*/ {_FOLD}, l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rn DESC) rd FROM f), rv AS (SELECT f.k, f.rn, o.reg AS nreg, o.mech AS nmech, CASE WHEN o.src%3=0 THEN true WHEN o.src%3=1 THEN false END AS use_new FROM f JOIN obs o ON o.id=f.id WHERE f.verdict='REVIEW'),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rn DESC) x FROM rv WHERE use_new) WHERE x=1), p AS (SELECT k, count(*) FILTER (use_new IS NULL) AS pending FROM rv GROUP BY 1)
SELECT l.k AS fold_key, coalesce(nreg, l.reg) AS regular_price, coalesce(nmech, l.mech) AS promotion_type, coalesce(pending>0,false) AS has_open_conflict FROM l LEFT JOIN w ON w.k=l.k LEFT JOIN p ON p.k=l.k WHERE rd=1""", "sources")
def conflict_replay(t: Tables) -> DataFrame:
    rows = stage(folded(t), "fold")
    obs = V.observations(t)
    verdicts = obs.filter(F.col("source_id") % 3 != 2).select("observation_id", (F.col("source_id") % 3 == 0).alias("use_new"))
    return K.replay_conflicts(K.canonical_state(rows, FIELDS), rows, obs, verdicts, FIELDS).select(
        "fold_key", "regular_price", "promotion_type", "has_open_conflict")


IDENTITY = ["promotion_id", "product_id", "product_name", "brand", "competitor", "competitor_id", "retailer", "retailer_id", "pack_size", "promotion_type",
            "buy_quantity", "free_quantity", "promo_price", "channel", "geography", "geography_region", "start_date", "end_date", "last_seen_at", "status",
            "regular_price", "category"]


def identified(t: Tables) -> DataFrame:
    from ..functions.geo import geography_key
    p = V.promotions(t, *IDENTITY).withColumn("_geo", geography_key("geography", F.col("geography_region")))
    day = lambda c: F.to_date(c)
    return p.withColumns({
        "fingerprint": identity_fingerprint({"competitor_id": "competitor_id", "product_id": "product_id", "retailer_id": "retailer_id", "product_name": "product_name",
                                             "pack_size": "pack_size", "promotion_type": "promotion_type", "buy_quantity": "buy_quantity", "free_quantity": "free_quantity",
                                             "promo_price": "promo_price", "channel": "channel", "geography": "_geo", "start_date": day("start_date"), "end_date": day("end_date")}),
        "source_fingerprint": source_identity_fingerprint({"retailer": "retailer", "brand": "brand", "competitor": "competitor", "product_name": "product_name",
                                                           "pack_size": "pack_size", "promotion_type": "promotion_type", "channel": "channel", "geography": "_geo"})})


def identities(t: Tables, *columns: str) -> DataFrame:
    """``identified`` with its dates and times and the columns asked for, staged: both sides of a match read it. Fingerprints are kept as 16 bytes."""
    kept = ["promotion_id", "source_fingerprint", "start_date", "end_date", "last_seen_at", *columns]
    return stage(compact(identified(t), "fingerprint", "source_fingerprint").select(*kept), "identified")


_TOKEN = "CASE WHEN geography_region IN ('STORE_SPECIFIC','UNMAPPED','MULTI_REGION') THEN concat(geography_region,':',lower(geography)) WHEN geography_region='UNKNOWN' THEN NULL ELSE geography_region END"
_SRC_KEY = f"retailer, brand, competitor, product_name, pack_size, promotion_type, channel, {_TOKEN}"
_SFP = f"md5(concat_ws('|', coalesce(retailer,'~'), coalesce(brand,'~'), coalesce(competitor,'~'), product_name, pack_size, promotion_type, coalesce(channel,'~'), coalesce({_TOKEN},'~')))"


@query("identity_classes", f"""+ g AS (SELECT count(*) AS n FROM promotions GROUP BY competitor_id, product_id, retailer_id, product_name, pack_size, promotion_type, promo_price, channel, {_TOKEN}, CAST(start_date AS DATE), CAST(end_date AS DATE))
SELECT n AS class_size, count(*) AS classes FROM g GROUP BY 1""", "promotions")
def identity_classes(t: Tables) -> DataFrame:
    sizes = identified(t).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("class_size"))
    return sizes.groupBy("class_size").agg(F.count(F.lit(1)).alias("classes"))


@query("source_identity_classes", f"+ g AS (SELECT count(*) AS n FROM promotions GROUP BY {_SRC_KEY}) SELECT n AS class_size, count(*) AS classes FROM g GROUP BY 1", "promotions")
def source_identity_classes(t: Tables) -> DataFrame:
    sizes = identified(t).groupBy("source_fingerprint").agg(F.count(F.lit(1)).alias("class_size"))
    return sizes.groupBy("class_size").agg(F.count(F.lit(1)).alias("classes"))


@query("period_overlap", """SELECT promotion_id, start_date IS NULL OR (greatest(CAST(start_date AS DATE), DATE '1998-03-01') <= least(coalesce(CAST(end_date AS DATE), CAST(start_date AS DATE)), DATE '1998-06-30')) AS compatible FROM promotions""", "promotions")
def period_overlap(t: Tables) -> DataFrame:
    p = V.promotions(t, "promotion_id", "start_date", "end_date")
    return p.select("promotion_id", periods_compatible("start_date", "end_date", F.lit("1998-03-01"), F.lit("1998-06-30")).alias("compatible"))


@query("identity_match", f"""+ p AS (SELECT *, {_SFP} AS sfp, CAST(start_date AS DATE) AS sd, CAST(end_date AS DATE) AS ed FROM promotions), st AS (SELECT * FROM p WHERE last_seen_at<TIMESTAMP '1998-07-01'), inc AS (SELECT * FROM p WHERE last_seen_at>=TIMESTAMP '1998-07-01'),
x AS (SELECT i.promotion_id AS item_id, min(s.promotion_id) AS exact_id FROM inc i JOIN st s ON s.sfp=i.sfp AND s.competitor_id IS NOT DISTINCT FROM i.competitor_id AND s.product_id=i.product_id AND s.promo_price IS NOT DISTINCT FROM i.promo_price AND s.sd IS NOT DISTINCT FROM i.sd AND s.ed IS NOT DISTINCT FROM i.ed GROUP BY 1),
c AS (SELECT item_id, promotion_id FROM (SELECT i.promotion_id AS item_id, s.promotion_id, row_number() OVER (PARTITION BY i.promotion_id ORDER BY s.last_seen_at DESC, s.promotion_id DESC) rn FROM inc i JOIN st s ON s.sfp=i.sfp
 WHERE i.sd IS NULL OR s.sd IS NULL OR greatest(i.sd,s.sd)<=least(coalesce(i.ed,i.sd),coalesce(s.ed,s.sd))) WHERE rn=1)
SELECT i.promotion_id AS item_id, coalesce(x.exact_id, c.promotion_id) AS promotion_id, CASE WHEN x.exact_id IS NOT NULL THEN 'EXACT' WHEN c.promotion_id IS NOT NULL THEN 'CAMPAIGN' ELSE 'NEW' END AS match FROM inc i LEFT JOIN x ON x.item_id=i.promotion_id LEFT JOIN c ON c.item_id=i.promotion_id""", "promotions")
def identity_match(t: Tables) -> DataFrame:
    p = identities(t, "fingerprint")
    cut = F.lit("1998-07-01 00:00:00").cast("timestamp_ntz")
    return K.match_identity(p.filter(F.col("last_seen_at") >= cut).withColumnRenamed("promotion_id", "item_id"), p.filter(F.col("last_seen_at") < cut))


@query("lineage", f"""+ p AS (SELECT *, {_SFP} AS sfp, CAST(start_date AS DATE) AS sd, CAST(end_date AS DATE) AS ed FROM promotions)
SELECT item_id, supersedes_id FROM (SELECT a.promotion_id AS item_id, b.promotion_id AS supersedes_id, row_number() OVER (PARTITION BY a.promotion_id ORDER BY b.last_seen_at DESC, b.promotion_id DESC) rn FROM p a JOIN p b ON a.product_id=b.product_id AND a.retailer_id=b.retailer_id AND a.sfp<>b.sfp AND b.status='ACTIVE'
 AND (a.sd IS NULL OR b.sd IS NULL OR greatest(a.sd,b.sd)<=least(coalesce(a.ed,a.sd),coalesce(b.ed,b.sd)))) WHERE rn=1""", "promotions")
def lineage(t: Tables) -> DataFrame:
    p = identities(t, "product_id", "retailer_id", "status")
    return K.lineage(p.withColumnRenamed("promotion_id", "item_id"), p)


_SUPERSEDED = f"""+ p AS (SELECT *, {_SFP} AS sfp, CAST(start_date AS DATE) AS sd, CAST(end_date AS DATE) AS ed FROM promotions), st AS (SELECT * FROM p WHERE last_seen_at<TIMESTAMP '2000-07-01'), inc AS (SELECT * FROM p WHERE last_seen_at>=TIMESTAMP '2000-07-01'),
pr AS (SELECT * FROM (SELECT a.promotion_id AS item_id, a.last_seen_at AS at_, b.promotion_id AS old_id, row_number() OVER (PARTITION BY a.promotion_id ORDER BY b.last_seen_at DESC, b.promotion_id DESC) rn FROM inc a JOIN st b ON {{}} AND a.sfp<>b.sfp AND b.status='ACTIVE'
 AND (a.sd IS NULL OR b.sd IS NULL OR greatest(a.sd,b.sd)<=least(coalesce(a.ed,a.sd),coalesce(b.ed,b.sd)))) WHERE rn=1),
fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY at_, item_id) x FROM pr) WHERE x=1)"""


def replaced(t: Tables, **crowd) -> tuple[DataFrame, DataFrame]:
    p = identities(t, "product_id", "retailer_id", "status").withColumns(crowd)
    cut = F.lit("2000-07-01 00:00:00").cast("timestamp_ntz")
    new = p.filter(F.col("last_seen_at") >= cut).withColumn("item_id", F.col("promotion_id")).withColumnsRenamed({"promotion_id": "observation_id"}).withColumn("observed_at", F.col("last_seen_at"))
    return K.supersede(p.filter(F.col("last_seen_at") < cut), new)


@query("superseded_promotions", _SUPERSEDED.format("a.product_id=b.product_id AND a.retailer_id=b.retailer_id") + """ SELECT st.promotion_id, CASE WHEN old_id IS NOT NULL THEN 'SUPERSEDED' ELSE status END AS status, item_id AS superseded_by FROM st LEFT JOIN fi ON old_id=promotion_id""", "promotions")
def superseded_promotions(t: Tables) -> DataFrame:
    """What promotions first seen in the last half year replace."""
    return replaced(t)[0].select("promotion_id", "status", "superseded_by")


@query("supersession_events", _SUPERSEDED.format("b.retailer_id=a.retailer_id") + """ SELECT old_id AS promotion_id, item_id AS observation_id, at_ AS observed_at, 'SUPERSEDED' AS event_type, concat('{"superseded_by_promotion_id":"', item_id, '"}') AS new_value FROM fi""", "promotions")
def supersession_events(t: Tables) -> DataFrame:
    """The events where all products of a retailer count as one: crowded keys, which go by the tree of periods."""
    events = replaced(t, product_id=F.lit(1).cast("bigint"))[1]
    fresh = K.new_events(events.unionByName(events), events.filter(F.col("promotion_id").isNull()))
    return fresh.select("promotion_id", "observation_id", "observed_at", "event_type", F.col("current").alias("new_value"))


@query("source_backfill", f"""+ m AS (SELECT promotion_id FROM promo_base WHERE promotion_type='MEMBER_PRICE'), o AS (SELECT {PID} AS promotion_id, document_source_id FROM lineitem JOIN crawl_documents d ON d.document_id=l_orderkey WHERE l_linestatus='O' AND l_linenumber<4 AND document_source_id IS NOT NULL),
e AS (SELECT promotion_id, document_source_id, row_number() OVER (PARTITION BY promotion_id ORDER BY captured_at DESC, evidence_id DESC) rn FROM evidence JOIN crawl_documents d ON d.document_id=evidence.document_id WHERE document_source_id IS NOT NULL)
SELECT m.promotion_id, CAST(coalesce(o.document_source_id, e.document_source_id, -1) AS BIGINT) AS source_id FROM m LEFT JOIN o ON o.promotion_id=m.promotion_id LEFT JOIN e ON e.promotion_id=m.promotion_id AND rn=1""", "promo_base crawl_documents evidence")
def source_backfill(t: Tables) -> DataFrame:
    p = V.promotions(t, "promotion_id", "source_id", "promotion_type")
    p = p.withColumn("source_id", F.when(F.col("promotion_type") != "MEMBER_PRICE", F.col("source_id")))
    # Every sighting is read; some have lost their document, and evidence stands in for those.
    document = F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") < 4), F.col("l_orderkey"))
    obs = t.lineitem.select(V.promotion_key().alias("promotion_id"), V.promotion_key().alias("observation_id"), document.alias("document_id"), F.col("l_shipdate").alias("observed_at"))
    out = K.source_backfill(p, obs, V.evidence(t), V.crawl_documents(t))
    return out.select("promotion_id", F.coalesce("source_id", F.lit(-1)).alias("source_id"))


@query("field_observation_merge", f"""+ p AS (SELECT *, {_SFP} AS sfp, CAST(start_date AS DATE) AS sd, CAST(end_date AS DATE) AS ed FROM promotions), st AS (SELECT * FROM p WHERE last_seen_at<TIMESTAMP '2000-01-01'), inc AS (SELECT * FROM p WHERE last_seen_at>=TIMESTAMP '2000-01-01'),
x AS (SELECT i.promotion_id AS sid, min(s.promotion_id) AS hit FROM inc i JOIN st s ON s.sfp=i.sfp AND s.competitor_id IS NOT DISTINCT FROM i.competitor_id AND s.product_id=i.product_id AND s.promo_price IS NOT DISTINCT FROM i.promo_price AND s.sd IS NOT DISTINCT FROM i.sd AND s.ed IS NOT DISTINCT FROM i.ed GROUP BY 1),
y AS (SELECT i.promotion_id AS sid, min(s.promotion_id) AS hit, count(*) AS n FROM inc i JOIN st s ON s.sfp=i.sfp AND s.competitor_id IS NOT DISTINCT FROM i.competitor_id AND s.retailer_id=i.retailer_id AND s.category=i.category AND s.promo_price IS NOT DISTINCT FROM i.promo_price AND s.start_date IS NOT DISTINCT FROM i.start_date AND s.end_date IS NOT DISTINCT FROM i.end_date GROUP BY 1),
z AS (SELECT i.promotion_id AS sid, i.regular_price AS rp, x.hit AS xh, coalesce(x.hit,y.hit) AS hit, coalesce(y.n,0) AS n FROM inc i LEFT JOIN x ON x.sid=i.promotion_id LEFT JOIN y ON y.sid=i.promotion_id)
SELECT z.sid AS submission_id, CASE WHEN xh IS NULL AND n>1 THEN 'CONFLICT' WHEN hit IS NULL THEN 'NEW' WHEN s.regular_price<>rp THEN 'CONFLICT' ELSE 'MATCHED' END AS outcome FROM z LEFT JOIN st s ON s.promotion_id=z.hit""", "promotions")
def field_observation_merge(t: Tables) -> DataFrame:
    p = identities(t, "fingerprint", "competitor_id", "retailer_id", "category", "promo_price", "regular_price")
    cut = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    return K.merge_field_observations(p.filter(F.col("last_seen_at") >= cut).withColumnRenamed("promotion_id", "submission_id"),
                                      p.filter(F.col("last_seen_at") < cut)).select("submission_id", "outcome")


@query("price_revisions", f"""+ b AS (SELECT own_id, regular_price, promo_price FROM own_products WHERE category<>'WAFER'), a AS (SELECT own_id, CASE WHEN promo_type='DISCOUNT' THEN {r('(regular_price*1.1::DOUBLE)', 2)} ELSE regular_price END AS regular_price, promo_price FROM own_products WHERE category<>'SNACK')
SELECT coalesce(a.own_id,b.own_id) AS own_id, CASE WHEN b.own_id IS NULL THEN 'INSERT' WHEN a.own_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation FROM b FULL JOIN a ON a.own_id=b.own_id
WHERE b.own_id IS NULL OR a.own_id IS NULL OR a.regular_price IS DISTINCT FROM b.regular_price OR a.promo_price IS DISTINCT FROM b.promo_price""", "own_products")
def price_revisions(t: Tables) -> DataFrame:
    own = V.own_products(t).select("own_id", "category", "promo_type", "regular_price", "promo_price")
    raised = own.withColumn("regular_price", F.when(F.col("promo_type") == "DISCOUNT", round_half_up(F.col("regular_price") * 1.1, 2)).otherwise(F.col("regular_price")))
    return K.price_revisions(own.filter("category <> 'WAFER'"), raised.filter("category <> 'SNACK'"), key="own_id", fields=["regular_price", "promo_price"]).select("own_id", "operation")


