"""Runs, alerts, page confirmation, retention and import queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from .. import config
from ..functions.core import round_half_up
from ..operators import matching as M, monitoring as MON
from ..session import ensure_checkpoint_dir
from ..sources import imports as IMP, views as V
from ..sources.staging import stage
from ..sources.tables import Tables
from .oracle import AS_OF, PID, r
from .q_compare import decisions, offers, own
from .q_live import _HEALTH, live
from .registry import query


def runs(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("COMPLETED")
    summary = F.to_json(F.struct(F.col("o_custkey").alias("documents"), (F.col("o_custkey") % 7).alias("rejected")))
    return t.orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), status.alias("status"), summary.alias("summary"))


_RUNS = "runs AS (SELECT o_orderkey AS run_id, o_orderdate AS started_at, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'P' THEN 'PARTIAL' ELSE 'COMPLETED' END AS status, o_custkey AS documents, o_custkey%7 AS rejected FROM orders)"


@query("recent_runs", f"WITH {_RUNS} SELECT run_id, started_at, status FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 8")
def recent_runs(t: Tables) -> DataFrame:
    return MON.recent_runs(runs(t)).select("run_id", "started_at", "status")


@query("latest_run", f"WITH {_RUNS} SELECT run_id, started_at, status, CASE status WHEN 'FAILED' THEN 'FAIL' WHEN 'PARTIAL' THEN 'WARN' ELSE 'PASS' END AS level, documents, rejected FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1")
def latest_run(t: Tables) -> DataFrame:
    return MON.latest_run(runs(t), as_of=V.AS_OF)


@query("source_processed", "SELECT o_orderkey AS run_id, l_suppkey AS source_id, bool_and(l_tax<0.08) AS processed, count(*) AS pages, max(l_shipdate) AS finished_at FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1,2")
def source_processed(t: Tables) -> DataFrame:
    pages = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("source_id"), (F.col("l_tax") < 0.08).alias("ok"), F.col("l_shipdate").alias("finished_at"))
    return MON.processed_sources(pages)


@query("unchanged_reconfirm", f"""+ ids AS (SELECT promotion_id FROM (SELECT {PID} AS promotion_id, l_orderkey AS d FROM lineitem UNION SELECT promotion_id, document_id FROM evidence) WHERE d IN (SELECT o_orderkey FROM orders WHERE o_orderpriority='1-URGENT'))
SELECT promotion_id, CASE WHEN end_date<{AS_OF} THEN 'EXPIRED' ELSE status END AS status, CASE WHEN status IN ('ACTIVE','UNKNOWN') AND (end_date IS NULL OR end_date>={AS_OF}) THEN {AS_OF} ELSE last_verified_at END AS last_verified_at FROM promotions WHERE promotion_id IN (SELECT promotion_id FROM ids)""", "promotions evidence")
def unchanged_reconfirm(t: Tables) -> DataFrame:
    p = V.promotions(t, "promotion_id", "status", "end_date", "last_seen_at", "last_verified_at")
    obs = t.lineitem.select(V.promotion_key().alias("promotion_id"), F.col("l_orderkey").alias("document_id"))
    same = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("document_id"))
    return MON.reconfirm(p, obs, V.evidence(t), same, as_of=V.AS_OF).select("promotion_id", "status", "last_verified_at")


def alert_history(t: Tables) -> DataFrame:
    """Alerts announced earlier: one per supplier and one per recent deep discount."""
    old = V.sources(t).select(F.concat(F.lit("old:"), "source_id").alias("fingerprint"), F.when(F.col("source_id") % 2 == 0, "SOURCE_FAILING").otherwise("SOURCE_STALE").alias("kind"),
                              F.col("source_id").cast("string").alias("subject_id"), F.when(F.col("source_id") % 3 == 0, F.lit(V.AS_OF).cast("timestamp_ntz")).alias("resolved_at"),
                              (F.lit(V.AS_OF).cast("timestamp_ntz") - F.make_dt_interval((F.col("source_id") % 400).cast("int"))).alias("created_at"))
    shocks = t.lineitem.filter("l_linestatus = 'F'").select(F.concat(F.lit("seen:"), V.promotion_key()).alias("fingerprint"), F.lit("PRICE_SHOCK").alias("kind"),
                                                           V.promotion_key().alias("subject_id"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"), F.col("l_shipdate").cast("timestamp_ntz").alias("created_at"))
    return old.unionByName(shocks)


@query("operational_alerts", f"""+ {_RUNS}, h AS (SELECT *, {_HEALTH} AS health, coalesce(strftime(last_success_at,'%Y-%m-%d %H:%M UTC'),'never') AS ep FROM sources WHERE approval_status='APPROVED'), l AS (SELECT * FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1)
SELECT 'SCAN_FAILED' AS kind, concat('scan-failed:',run_id) AS fingerprint, CAST(run_id AS VARCHAR) AS subject_id FROM l WHERE status='FAILED' UNION ALL SELECT concat('SOURCE_',health), concat('source-',lower(health),':',source_id,':',ep), CAST(source_id AS VARCHAR) FROM h WHERE health IN ('FAILING','STALE')
UNION ALL SELECT 'SOURCE_RECOVERED', concat('source-recovered:',source_id,':',ep), CAST(source_id AS VARCHAR) FROM h WHERE health='OK' AND source_id%3<>0""", "sources")
def operational_alerts(t: Tables) -> DataFrame:
    return MON.operational_alerts(runs(t), V.sources(t), alert_history(t), as_of=V.AS_OF).select("kind", "fingerprint", "subject_id")


@query("alerts_resolved", f"+ h AS (SELECT source_id, {_HEALTH} AS health FROM sources WHERE approval_status='APPROVED') SELECT CAST(source_id AS VARCHAR) AS subject_id FROM h WHERE health='OK' AND source_id%3<>0", "sources")
def alerts_resolved(t: Tables) -> DataFrame:
    before = alert_history(t).filter(F.col("resolved_at").isNull())
    return MON.resolve_alerts(before, V.sources(t), as_of=V.AS_OF).filter(F.col("resolved_at").isNotNull()).select("subject_id")


@query("commercial_alerts", f"""+ d AS (SELECT * FROM live WHERE discount_percentage>=20 AND promotion_id NOT IN (SELECT {PID} FROM lineitem WHERE l_linestatus='F')), b AS (SELECT * FROM live WHERE promotion_type='BUY_X_GET_Y'),
t AS (SELECT * FROM matches WHERE gap<=-15.0)
SELECT 'PRICE_SHOCK' AS kind, concat('price-shock:',promotion_id,':',CAST({r('discount_percentage', 0)} AS INTEGER)) AS fingerprint FROM d UNION ALL SELECT 'DISRUPTIVE_PROMO', concat('disruptive-promo:',promotion_id,':bogo:',buy_quantity,'x',free_quantity) FROM b
UNION ALL SELECT 'COMPETITOR_UNDERCUT', concat('competitor-undercut:',own_id,':',promotion_id,':',CAST(abs({r('gap', 0)}) AS INTEGER)) FROM t""", "live matches")
def commercial_alerts(t: Tables) -> DataFrame:
    shown = live(t, "discount_percentage", "promotion_type", "buy_quantity", "free_quantity", "product_name", "competitor")
    undercuts = M.undercut_offers(M.scope_own(own(t)), M.scope_offers(offers(t)), decisions(t), gap=config.ALERT_UNDERCUT_GAP)
    return MON.commercial_alerts(shown, undercuts, alert_history(t)).select("kind", "fingerprint")


@query("alert_episodes", """WITH c AS (SELECT user_id AS source_id, ts, event_type<>'error' AS ok FROM events), x AS (SELECT *, max(CASE WHEN ok THEN ts END) OVER (PARTITION BY source_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ls,
 min(CASE WHEN ok THEN ts END) OVER (PARTITION BY source_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ns FROM c)
SELECT source_id, ls AS last_success, min(ts) AS opened_at, count(*) AS failures, min(ns) AS resolved_at FROM x WHERE NOT ok GROUP BY 1,2""")
def alert_episodes(t: Tables) -> DataFrame:
    return MON.alert_episodes(t.events.select(F.col("user_id").alias("source_id"), "ts", (F.col("event_type") != "error").alias("ok")))


def stored_pages(t: Tables) -> DataFrame:
    """Documents as versions of pages: (source, language) is the page, identical texts share a stored file."""
    return t.documents.select(F.col("doc_id").alias("document_id"), F.col("source").alias("source_id"), F.col("lang").alias("url"), "text",
                              F.sha2("text", 256).alias("raw_uri"), F.col("n_chars").alias("raw_size"),
                              (F.lit(V.AS_OF).cast("timestamp_ntz") - F.make_dt_interval((F.col("n_chars") % 200).cast("int"))).alias("retrieved_at"))


_PAGES = f"""d AS (SELECT doc_id, source, lang, text, n_chars, {AS_OF}-to_days(CAST(n_chars%200 AS INTEGER)) AS at_ FROM documents), n AS (SELECT source, lang, max(at_) AS mx FROM d GROUP BY 1,2), p AS (SELECT d.*, mx>at_ AS has_newer, mx>at_ AND at_<{AS_OF}-INTERVAL 90 DAY AS purge FROM d JOIN n ON n.source=d.source AND n.lang=d.lang),
k AS (SELECT *, purge AND text NOT IN (SELECT text FROM p WHERE NOT purge) AS remove_file FROM p)"""


@query("page_versions", f"WITH {_PAGES} SELECT doc_id AS document_id, has_newer FROM p")
def page_versions(t: Tables) -> DataFrame:
    return MON.superseded_documents(stored_pages(t)).select("document_id", "has_newer")


@query("retention_plan", f"WITH {_PAGES} SELECT doc_id AS document_id, purge, remove_file FROM k")
def retention_plan(t: Tables) -> DataFrame:
    return MON.retention_plan(stored_pages(t), as_of=V.AS_OF).select("document_id", "purge", "remove_file")


@query("retention_totals", f"""WITH {_PAGES} SELECT (SELECT count(*) FROM k WHERE purge) AS documents_trimmed, (SELECT count(DISTINCT text) FROM k WHERE remove_file) AS raw_files_removed, (SELECT CAST(coalesce(sum(n),0) AS BIGINT) FROM (SELECT min(n_chars) AS n FROM k WHERE remove_file GROUP BY text)) AS bytes_freed,
 (SELECT CAST(coalesce(sum(length(text)),0) AS BIGINT) FROM k WHERE purge) AS text_characters_freed""")
def retention_totals(t: Tables) -> DataFrame:
    return MON.retention_totals(MON.retention_plan(stored_pages(t), as_of=V.AS_OF))


@query("retention_applied", f"WITH {_PAGES} SELECT doc_id AS document_id, purge AS text_gone, remove_file AS file_gone, CASE WHEN purge THEN {AS_OF} END AS purged_at FROM k")
def retention_applied(t: Tables) -> DataFrame:
    done = MON.apply_retention(MON.retention_plan(stored_pages(t), as_of=V.AS_OF), as_of=V.AS_OF)
    return done.select("document_id", F.col("text").isNull().alias("text_gone"), F.col("raw_uri").isNull().alias("file_gone"), "purged_at")


@query("recent_alerts", f"""SELECT fingerprint, kind, subject_id, open, created_at FROM (SELECT concat('old:', s_suppkey) AS fingerprint, CASE WHEN s_suppkey%2=0 THEN 'SOURCE_FAILING' ELSE 'SOURCE_STALE' END AS kind, CAST(s_suppkey AS VARCHAR) AS subject_id, s_suppkey%3<>0 AS open, {AS_OF}-to_days(CAST(s_suppkey%400 AS INTEGER)) AS created_at FROM supplier
 UNION ALL SELECT concat('seen:', {PID}), 'PRICE_SHOCK', {PID}, true, l_shipdate FROM lineitem WHERE l_linestatus='F')""")
def recent_alerts(t: Tables) -> DataFrame:
    """All announced alerts, newest first."""
    return MON.recent_alerts(alert_history(t)).select("fingerprint", "kind", "subject_id", F.col("resolved_at").isNull().alias("open"), "created_at")


@query("runs_pruned", f"WITH {_RUNS} SELECT count(*) AS kept FROM runs WHERE started_at>={AS_OF}-INTERVAL 180 DAY")
def runs_pruned(t: Tables) -> DataFrame:
    return MON.prune_log(runs(t), "started_at", 180, as_of=V.AS_OF).agg(F.count(F.lit(1)).alias("kept"))


def csv_rows(t: Tables) -> DataFrame:
    """Catalogue rows as they come out of a CSV: everything is text."""
    price = F.concat(F.lit("Rp "), F.translate(F.format_number(F.col("p_retailprice") * 10, 2), ",.", ".,"))
    return t.part.select(F.col("p_partkey").alias("line"), F.concat(F.lit(" "), "p_name").alias("Name "), price.alias("Regular_Price"), F.concat(F.lit("SKU-"), F.col("p_partkey") * 2).alias("SKU"),
                         V.category_of(F.col("p_type")).alias("category"), V.pack_text(F.col("p_size")).alias("pack_size"))


@query("csv_import_upsert", f"""SELECT CASE WHEN o.p_partkey IS NOT NULL THEN 'updated' ELSE 'created' END AS operation, count(*) AS rows, {r('(min(i.p_retailprice*10.0::DOUBLE))', 2)} AS lowest_price FROM part i LEFT JOIN part o ON o.p_partkey=i.p_partkey*2 WHERE i.p_type<>'ECONOMY' GROUP BY 1""")
def csv_import_upsert(t: Tables) -> DataFrame:
    good = csv_rows(t).filter("category <> 'OTHER'")
    merged = IMP.upsert(IMP.parse_catalogue(good), V.own_products(t))
    changed = merged.filter(F.col("operation") != "kept")
    return changed.groupBy("operation").agg(F.count(F.lit(1)).alias("rows"), round_half_up(F.min("regular_price"), 2).alias("lowest_price"))


@query("csv_import_errors", "SELECT CAST(p_partkey AS BIGINT) AS line, 'category is not in the list' AS error FROM part WHERE p_type='ECONOMY'")
def csv_import_errors(t: Tables) -> DataFrame:
    return IMP.import_errors(IMP.parse_catalogue(csv_rows(t))).select("line", "error")


def csv_files(t: Tables) -> str:
    """The catalogue as CSV files by shelf: quoted names over two lines, doubled quotes, blank lines and blank rows. Returns the folder."""
    price = F.format_string("%.2f", F.col("p_retailprice") * 10)
    size = F.col("p_size")
    name = F.concat(F.lit('"'), "p_name", F.when(size % 3 == 0, F.lit(' ""new""')).otherwise(""), F.when(size % 4 == 0, F.lit("\nsecond, line")).otherwise(""), F.lit('"'))
    row = F.concat_ws(",", name, price, F.concat(F.lit("SKU-"), F.col("p_partkey") * 2), V.category_of(F.col("p_type")))
    body = t.part.select((size % 5).alias("shelf"), "p_partkey", F.concat(row, F.when(size % 6 == 0, F.lit("\n")).otherwise(""), F.when(size % 7 == 0, F.lit("\n, ,,")).otherwise("")).alias("value"))
    header = body.select("shelf").distinct().select("shelf", F.lit(None).cast(body.schema["p_partkey"].dataType).alias("p_partkey"), F.lit("Name ,Regular_Price,SKU,category").alias("value"))
    folder = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/shelfwise/csv-{uuid.uuid4().hex}"
    shelves = header.unionByName(body).repartition("shelf").sortWithinPartitions("shelf", F.col("p_partkey").asc_nulls_first())
    shelves.select("shelf", "value").write.partitionBy("shelf").text(folder)
    return folder


@query("csv_file_errors", """SELECT CAST(shelf AS VARCHAR) AS shelf, CAST(1+rn+blank AS BIGINT) AS line, CAST(1+lines-own+1 AS BIGINT) AS file_line, 'category is not in the list' AS error
FROM (SELECT p_size%5 AS shelf, p_type, row_number() OVER w AS rn, 1+(p_size%4=0)::INT+(p_size%6=0)::INT+(p_size%7=0)::INT AS own, sum(1+(p_size%4=0)::INT+(p_size%6=0)::INT+(p_size%7=0)::INT) OVER w AS lines,
 sum((p_size%7=0)::INT) OVER w-(p_size%7=0)::INT AS blank FROM part WINDOW w AS (PARTITION BY p_size%5 ORDER BY p_partkey)) WHERE p_type='ECONOMY'""")
def csv_file_errors(t: Tables) -> DataFrame:
    errors = IMP.import_errors(IMP.parse_catalogue(IMP.read_catalogue_csv(t.spark, csv_files(t))))
    return errors.select(F.regexp_extract("source_file", r"shelf=(\d+)", 1).alias("shelf"), "line", "file_line", "error")


@query("csv_file_import", """SELECT 'all rows' AS given, 'kept' AS operation, count(*) AS rows FROM part
UNION ALL SELECT 'good rows', CASE WHEN i.p_partkey IS NULL THEN 'kept' WHEN o.p_partkey IS NULL THEN 'created' ELSE 'updated' END, count(*)
FROM (SELECT * FROM part WHERE p_type<>'ECONOMY') i FULL JOIN part o ON o.p_partkey=i.p_partkey*2 GROUP BY 2""")
def csv_file_import(t: Tables) -> DataFrame:
    parsed = stage(IMP.parse_catalogue(IMP.read_catalogue_csv(t.spark, csv_files(t))), "catalogue")
    count = lambda given, rows: IMP.upsert(rows, V.own_products(t)).groupBy("operation").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(given).alias("given"), "operation", "rows")
    return count("all rows", parsed).unionByName(count("good rows", parsed.filter("error IS NULL")))
