"""The registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_cnn, cover_tree, feistel_shards, filter_audit, fm_index, jaccard_regions, length_histogram, lexical_search, license_diagonals, main_text, sentence_spans, warc
from .batches import renamed
from .registry import query, table


@query("op1_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = bpe.decode(bpe.encode(table(spark, folder, "documents")))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_main_text")
def main_text_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(table(spark, folder, "pages"))


@query("op3_feistel_shards")
def feistel_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return feistel_shards.shard(table(spark, folder, "documents"))


@query("op4_cover_tree_top_k", oracle="""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
          FROM v AS q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 50 = 0)
    SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
    WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""")
def cover_tree_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return cover_tree.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % cover_tree.QUERY_EVERY == 0)


@query("op5_license_diagonals")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_diagonals.scan(table(spark, folder, "documents")).drop("spans")


@query("op6_length_histogram")
def length_histogram_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    return length_histogram.histogram(length_histogram.lengths(table(spark, folder, "documents")))


@query("op7_jaccard_join", oracle=r"""
    WITH RECURSIVE d AS (
        SELECT row_number() OVER () AS rid, doc_id,
               coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    s AS (SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + least(len(w), 3) - 1), ' ') AS k
          FROM d, unnest(range(1, len(w) - least(len(w), 3) + 2)) t(i) WHERE len(w) > 0),
    z AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
    p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS o FROM s a JOIN s b ON a.k = b.k AND a.rid < b.rid GROUP BY ALL),
    l AS (SELECT x, y FROM p JOIN z u ON u.rid = x JOIN z v ON v.rid = y WHERE 100 * o >= 90 * (u.n + v.n - o)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
    SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, m.component_id
    FROM d LEFT JOIN z USING (rid) JOIN (SELECT r.x AS rid, min(q.doc_id) AS component_id FROM r JOIN d q ON q.rid = r.y GROUP BY r.x) m USING (rid)""")
def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_regions.classes(table(spark, folder, "documents"))


@query("op8_sentence_span_dedup")
def sentence_span_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sentence_spans.remove_repeats(docs)


@query("op9_byte_cnn_language")
def byte_cnn_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = byte_cnn.predict(docs.select("doc_id", "text"), byte_cnn.fit(docs))
    return renamed(found.drop("c1"), ["doc_id"], "lang_pred", "score").select("doc_id", byte_cnn.held_out().alias("held_out"), "lang_pred", "score")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op10_fm_decontamination", oracle=f"""
    WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
    bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS k
           FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) t(i) WHERE len(w) > 0),
    d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
    h AS (SELECT rid, i, n, item_id FROM (
              SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
              FROM d, (SELECT DISTINCT n FROM bw) l, unnest(range(1, len(w) - n + 2)) t(i)) JOIN bw USING (n, k)),
    p AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(0, n)) u(j) GROUP BY rid),
    s AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM h) GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN p USING (rid) LEFT JOIN s USING (rid)""")
def fm_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    found = fm_index.find_overlap(docs.select("doc_id", "text"), benchmark)
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(F.col("c0").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), "contaminated")


@query("op11_filter_audit", oracle=r"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    l AS (SELECT doc_id, max((quality IS NOT NULL AND quality = 1)::INT) AS good, max((toxic IS NOT NULL AND toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 (len(w) < 50)::INT AS a, (100 * len(list_distinct(w)) < 65 * len(w))::INT AS b,
                 (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d,
                 coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS e FROM d LEFT JOIN l USING (doc_id)),
    c AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
    f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    o AS (SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
          FROM f p, f q, f r, f s, f t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND len(list_distinct([p.bit, q.bit, r.bit, s.bit, t.bit])) = 5),
    u AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, unnest([1, 2, 3, 4, 5]) s(step)),
    r AS (SELECT part, filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS filter,
                 coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                 coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
          FROM c, u GROUP BY ALL)
    SELECT *, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM r""")
def filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op12_shared_lexical_search", oracle=f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_TERMS}, []) AS w FROM documents),
    s AS (SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
    q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
    p AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
    f AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY t, big_n),
    m AS (SELECT rid, doc_id, 25 + (75 * len(w) * big_n) // big_l AS m FROM d, s),
    x AS (SELECT item_id, rid, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
          FROM p JOIN f USING (t) JOIN q USING (t) JOIN m USING (rid) GROUP BY ALL)
    SELECT item_id, row_number() OVER o::INTEGER AS rank, doc_id, score FROM x WHERE score > 0
    WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10""")
def shared_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_warc_archives", oracle="""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex, min(page_id) OVER (PARTITION BY b) AS least FROM p)
    SELECT page_id, n::BIGINT AS payload_bytes,
           list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + (('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) % 32, 1)), 'string_agg', '') AS payload_digest,
           CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > least THEN least END AS refers_to, true AS digest_ok
    FROM h""")
def warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    records = warc.read(warc.archive(pages)).filter(F.col("record_type").isin("response", "revisit"))
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "digest_ok")
