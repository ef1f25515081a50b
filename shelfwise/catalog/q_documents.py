"""Document, page, payload and quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import canonical_url, document_type, looks_like_shell
from ..operators import documents as DOC
from ..sources import views as V
from ..sources.tables import Tables
from .oracle import PID
from .registry import query


@query("content_dedup", "SELECT source, lower(sha256(text)) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY source, text")
def content_dedup(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "source", "text")
    return DOC.deduplicate(docs, keys=["source"], order="doc_id").select("source", "content_hash", "doc_id", "copies")


@query("document_scan", "SELECT doc_id, source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def document_scan(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(50).drop("n_chars")


@query("card_split")
def card_split(t: Tables) -> DataFrame:
    df = DOC.explode_cards(t.documents)
    return df.select("doc_id", "card_index", "chunk", "total_cards", "within_cap", F.length("card").alias("chars"), F.sha2("card", 256).alias("card_hash"))


@query("card_characters", "SELECT doc_id, CAST(length(regexp_replace(text,'\\s+','','g')) AS BIGINT) AS letters FROM documents WHERE length(trim(text))>0")
def card_characters(t: Tables) -> DataFrame:
    """Nothing is lost: the cards of a document hold all its non-blank characters."""
    letters = F.length(F.regexp_replace("card", r"\s+", ""))
    return DOC.explode_cards(t.documents).groupBy("doc_id").agg(F.sum(letters).cast("bigint").alias("letters"))


_BASE = "regexp_extract(url,'^([a-z]+://[^/?#]+)',1)"
_CANON = "concat(regexp_extract(url,'^([a-z]+://[^/?#]+)',1), coalesce(nullif(regexp_extract(url,'^[a-z]+://[^/?#]+([^?#]*)',1),''),'/'), regexp_extract(url,'(\\?[^#]*)',1))"


@query("url_canonical", f"SELECT page_id, {_CANON} AS canonical FROM pages")
def url_canonical(t: Tables) -> DataFrame:
    return t.pages.select("page_id", canonical_url("url").alias("canonical"))


@query("link_discovery", f"""SELECT page_id, concat({_BASE}, h) AS link, count(*) AS times FROM (SELECT page_id, url, regexp_replace(unnest(regexp_extract_all(html,'<a href="([^"]*)"',1)),'#.*$','') AS h FROM pages) GROUP BY 1,2""")
def link_discovery(t: Tables) -> DataFrame:
    return DOC.anchors(t.pages).filter("same_host").groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("times"))


@query("pagination_top", f"SELECT page_id, {_CANON} AS link, 1::INTEGER AS position, CAST(coalesce(nullif(regexp_extract(url,'[?&]page=([0-9]+)',1),''),'-1') AS INTEGER) AS number, true AS within_budget FROM pages")
def pagination_top(t: Tables) -> DataFrame:
    found = DOC.discover_links(t.pages)
    return found.select("page_id", "link", "position", F.coalesce("number", F.lit(-1)).alias("number"), "within_budget")


@query("merged_urls", f"""+ c AS (SELECT page_id, {_CANON} AS link, lower(regexp_extract(url,'^[a-z]+://([^/?#]+)',1)) AS host FROM pages), u AS (SELECT host, link, min(page_id) AS p FROM c GROUP BY 1,2)
SELECT host, link, CASE WHEN place<=10 THEN place ELSE 0 END::INTEGER AS place, place<=10 AS within_budget FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY p, link) AS place FROM u)""".replace("+ c AS", "WITH c AS", 1))
def merged_urls(t: Tables) -> DataFrame:
    return DOC.merge_urls(t.pages, DOC.discover_links(t.pages)).withColumn("place", F.coalesce("place", F.lit(0)))


@query("doc_type", """SELECT page_id, 'HTML' AS by_content, CASE page_id%4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'IMAGE' WHEN 2 THEN 'PDF' ELSE 'UNKNOWN' END AS mixed FROM pages""")
def doc_type(t: Tables) -> DataFrame:
    k = F.col("page_id") % 4
    url = F.when(k == 2, F.lit("https://x.example/katalog.PDF?v=1")).otherwise(F.lit("https://x.example/katalog"))
    mime = F.when(k == 0, "application/pdf; charset=x").when(k == 1, "image/png")
    return t.pages.select("page_id", document_type("url", F.lit("text/html"), F.substring("html", 1, 64)).alias("by_content"),
                          document_type(url, mime, F.lit("plain")).alias("mixed"))


@query("dynamic_shell", """SELECT page_id, CAST(length(trim(regexp_replace(regexp_replace(html,'<[^>]+>',' ','g'),'\\s+',' ','g')))<500 AS BOOLEAN) AS shell FROM pages""")
def dynamic_shell(t: Tables) -> DataFrame:
    marked = F.concat("html", F.lit("<script src='webpack.js'></script>"))
    return t.pages.select("page_id", looks_like_shell(marked).alias("shell"))


@query("promo_cards", r"""WITH p AS (SELECT page_id, replace(replace(html,'<p>','<div class="catalog-item"> Promo '),'</p>','</div>') AS h FROM pages),
b AS (SELECT page_id, unnest(x) AS block, generate_subscripts(x,1)-1 AS place FROM (SELECT page_id, regexp_extract_all(h,'(?is)<div class="catalog-item">.*?</div>') AS x FROM p)),
c AS (SELECT page_id, place, trim(regexp_replace(regexp_replace(block,'<[^>]+>',' ','g'),'\s+',' ','g')) AS card FROM b)
SELECT page_id, card, min(place)::INTEGER AS place FROM c WHERE length(card)>30 AND regexp_matches(lower(card),'rp|diskon|hemat|beli|promo|gratis|%') GROUP BY 1,2""")
def promo_cards(t: Tables) -> DataFrame:
    """Paragraphs stand in for item blocks, since the pages have none."""
    pages = t.pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", r"<p>", '<div class="catalog-item"> Promo '), "</p>", "</div>"))
    return DOC.promo_cards(pages)


def payload_rows(t: Tables) -> DataFrame:
    """One model response per order line, with one kind of fault per line number."""
    line = F.col("l_linenumber")
    df = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    price = F.concat(F.lit("Rp "), F.translate(F.format_number("l_extendedprice", 2), ",.", ".,"))
    quote = F.concat(F.lit("Promo "), "p_name", F.lit(" berlaku "), F.date_format("l_shipdate", "dd/MM/yyyy"))
    item = F.struct(F.concat_ws(" ", "p_name", V.pack_text(F.col("p_size"))).alias("product_name"), F.col("p_brand").alias("brand"), V.category_of(F.col("p_type")).alias("category"),
                    price.alias("promo_price"), F.round(F.col("l_discount") * 100, 0).alias("discount_percentage"), F.when(line != 5, quote).alias("evidence_quote"),
                    F.when(line == 3, "Jawa Barat").when(line == 6, "Sumatera").alias("geography"), F.lit("DISCOUNT").alias("promotion_type"))
    one = F.to_json(F.struct(F.array(item).alias("promotions")))
    two = F.to_json(F.struct(F.array(item, item).alias("promotions"), F.lit("Periode: 1 - 7 Juni 2000").alias("banner_date")))
    payload = (F.when(line == 1, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).when(line == 2, F.substring(one, F.lit(1), F.length(one) - 3))
               .when(line == 4, F.lit('{"promotions": {"a": 1}}')).when((line == 6) & (F.col("l_tax") == 0.0), F.lit('{"promotions": ["text", 7]}')).when(line == 7, two).otherwise(one))
    text = F.when(F.col("l_tax") == 0.08, "Promo lain").otherwise(F.concat(F.lit("Toko Jawa barat. "), quote))
    return df.select(V.promotion_key().alias("payload_id"), V.promotion_key().alias("chunk_id"), payload.alias("payload"), text.alias("chunk_text"))


def items(t: Tables) -> DataFrame:
    return DOC.payload_items(payload_rows(t).select("payload_id", "chunk_id", "payload"), default_year=2000)


_ITEMS = f"""i AS (SELECT {PID} AS payload_id, *, CASE WHEN p_size%3=0 THEN concat(p_size,' x 10 g') WHEN p_size%3=1 THEN concat(p_size*10,'g') ELSE concat('0,', lpad(CAST(p_size AS VARCHAR),2,'0'), ' kg') END AS pack,
 CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS d FROM lineitem LEFT JOIN part ON l_partkey=p_partkey WHERE l_linenumber NOT IN (2,4)),
x AS (SELECT i.*, k AS item_index FROM i JOIN (SELECT unnest([0,1]) AS k) ks ON k=0 OR l_linenumber=7 OR (l_linenumber=6 AND l_tax=0)),
y AS (SELECT *, CASE WHEN l_linenumber=6 AND l_tax=0 THEN 'Promotion item must be a JSON object' WHEN l_linenumber=5 THEN 'evidence_quote is missing' END AS reject_reason FROM x)"""


@query("payload_items", f"""WITH {_ITEMS} SELECT payload_id, item_index::INTEGER AS item_index, concat(p_name,' ',pack) AS product_name, pack AS pack_size, l_extendedprice AS promo_price,
 CASE WHEN l_linenumber=7 THEN '2000-06-01' END AS start_day, CASE WHEN l_linenumber=7 THEN '2000-06-07' END AS end_day FROM y WHERE reject_reason IS NULL""")
def payload_items(t: Tables) -> DataFrame:
    ok = items(t).filter(F.col("reject_reason").isNull())
    return ok.select("payload_id", "item_index", "product_name", "pack_size", "promo_price", F.col("start_day").cast("string").alias("start_day"), F.col("end_day").cast("string").alias("end_day"))


@query("payload_rejects", f"WITH {_ITEMS} SELECT payload_id, item_index::INTEGER AS item_index, reject_reason FROM y WHERE reject_reason IS NOT NULL")
def payload_rejects(t: Tables) -> DataFrame:
    reasons = DOC.payload_reasons(payload_rows(t).select("payload_id", "payload"))
    return reasons.filter(F.col("reject_reason").isNotNull()).select("payload_id", "item_index", "reject_reason")


@query("payload_status", f"""SELECT CASE WHEN l_linenumber=2 THEN 'INVALID_JSON' WHEN l_linenumber=4 THEN 'INVALID_SCHEMA' WHEN l_linenumber=5 OR (l_linenumber=6 AND l_tax=0) THEN 'PARTIAL_SUCCESS' ELSE 'SUCCESS' END AS status, count(*) AS payloads,
 CAST(sum(CASE WHEN l_linenumber IN (1,3) OR (l_linenumber=6 AND l_tax>0) THEN 1 WHEN l_linenumber=7 THEN 2 ELSE 0 END) AS BIGINT) AS accepted, CAST(sum(CASE WHEN l_linenumber=5 THEN 1 WHEN l_linenumber=6 AND l_tax=0 THEN 2 ELSE 0 END) AS BIGINT) AS rejected FROM lineitem GROUP BY 1""")
def payload_status(t: Tables) -> DataFrame:
    s = DOC.payload_summary(payload_rows(t))
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("payloads"), F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


@query("quote_containment", f"""WITH {_ITEMS} SELECT CASE WHEN l_tax=0.08::DOUBLE THEN 'Evidence quote is not present verbatim in source text' ELSE 'ok' END AS outcome, count(*) AS items FROM y WHERE reject_reason IS NULL GROUP BY 1""")
def quote_containment(t: Tables) -> DataFrame:
    checked = DOC.contain(items(t).filter(F.col("reject_reason").isNull()), payload_rows(t).select("chunk_id", "chunk_text"))
    return checked.groupBy(F.coalesce("quote_reason", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("items"))


@query("geography_containment", f"""WITH {_ITEMS} SELECT CASE WHEN l_linenumber=3 AND l_tax<>0.08::DOUBLE THEN 'Jawa Barat' ELSE '' END AS geography, l_linenumber=6 OR (l_linenumber=3 AND l_tax=0.08::DOUBLE) AS dropped, count(*) AS items FROM y WHERE reject_reason IS NULL GROUP BY 1,2""")
def geography_containment(t: Tables) -> DataFrame:
    checked = DOC.contain(items(t).filter(F.col("reject_reason").isNull()), payload_rows(t).select("chunk_id", "chunk_text"))
    return checked.groupBy(F.coalesce("geography", F.lit("")).alias("geography"), F.col("geography_dropped").alias("dropped")).agg(F.count(F.lit(1)).alias("items"))


@query("dry_run", f"""WITH {_ITEMS}, z AS (SELECT *, CASE WHEN reject_reason IS NOT NULL THEN 'rejected' WHEN l_tax=0.08::DOUBLE THEN 'unverifiable' WHEN p_type='ECONOMY' THEN 'invalid' ELSE 'storable' END AS stage FROM y) SELECT stage, count(*) AS items FROM z GROUP BY 1""")
def dry_run(t: Tables) -> DataFrame:
    """The whole document-to-items job, reporting only: nothing is written."""
    from ..plans.ingest import dry_run as plan
    rows = payload_rows(t)
    return plan(rows.select("payload_id", "chunk_id", "payload"), rows.select("chunk_id", "chunk_text"), default_year=2000)


def labels(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Part names as labels per brand; extracted names reorder the words, some with extra words, some unrelated."""
    parts = t.part.select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("id"), "p_name", F.col("p_retailprice").alias("price"), F.col("p_size").alias("k"))
    gold = parts.select("doc", F.col("id").alias("gold_id"), F.col("p_name").alias("product_name"), F.lit(None).cast("double").alias("promo_price"),
                        F.col("price").alias("regular_price"), F.lit(None).cast("double").alias("discount_percentage"), F.lit("DISCOUNT").alias("promotion_type"))
    words = F.split("p_name", " ")
    name = (F.when(F.col("k") % 3 == 0, F.concat_ws(" ", F.reverse(words))).when(F.col("k") % 3 == 1, F.concat(F.lit("Promo "), "p_name")).otherwise(F.concat(F.lit("other "), F.col("id"))))
    got = parts.select("doc", F.col("id").alias("item_id"), name.alias("product_name"), F.lit(None).cast("double").alias("promo_price"), F.col("price").alias("regular_price"),
                       F.lit(None).cast("double").alias("discount_percentage"), F.lit("DISCOUNT").alias("promotion_type"))
    return gold, got


_Q = """WITH p AS (SELECT p_brand AS doc, array_to_string(list_sort(string_split(p_name,' ')),' ') AS n, p_size%3<2 AS hit FROM part), g AS (SELECT doc, n, count(*) AS a, count(*) FILTER (hit) AS b FROM p GROUP BY 1,2)
SELECT doc, CAST(sum(a) AS BIGINT) AS expected, CAST(sum(a) AS BIGINT) AS extracted, CAST(sum(least(a,b)) AS BIGINT) AS matched FROM g GROUP BY 1"""


@query("extraction_quality", f"SELECT *, round(matched/extracted::DOUBLE,9) AS precision, round(matched/expected::DOUBLE,9) AS recall FROM ({_Q})")
def extraction_quality(t: Tables) -> DataFrame:
    gold, got = labels(t)
    s = DOC.score_extraction(gold, got, DOC.match_labels(gold, got))
    return s.select("doc", "expected", "extracted", "matched", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))
