import random
import re

from pyspark.sql import functions as F

from shelfwise.operators import documents as DOC
from shelfwise.operators import resolution as RES


def plain_cards(text, limit):
    """Straight-line packing used as the yardstick."""
    text = text.strip()
    parts = [p.strip() for p in re.split(r"(?m)^\s*(?:-{3,}|={3,}|\*{3,})\s*$", text) if p.strip()]
    if len(parts) > 1 or not text:
        return parts

    def pack(pieces, sep, extra):
        out, cur, size = [], [], 0
        for p in pieces:
            if cur and size + len(p) + extra > limit:
                out.append(sep.join(cur))
                cur, size = [], 0
            cur.append(p)
            size += len(p) + extra
        return out + ([sep.join(cur)] if cur else [])

    pieces = []
    for para in re.split(r"\n\s*\n", text):
        para = para.strip()
        if para:
            lines = [ln[i:i + limit] for ln in para.split("\n") for i in range(0, max(1, len(ln)), limit)]
            pieces += [para] if len(para) <= limit else pack(lines, "\n", 1)
    return pack(pieces, "\n\n", 0)


def test_cards_equal_the_straight_line_version(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 9)))
    texts = ["", "one", "a\n---\nb\n ===== \nc", "x" * 95]
    texts += ["".join(word() + rng.choice([" ", "\n", "\n\n", " ", " "]) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["c"] for r in df.select("doc_id", DOC.cards("text", limit=40).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_cards(t, 40), repr(t)


def test_promo_cards(spark):
    html = '<div class="catalog-item big"><b>Biskuit Kaleng</b> diskon 20% sampai akhir bulan</div><p class="item">short</p><div class="item">nothing to see here, move along please</div>'
    assert [r["card"] for r in DOC.promo_cards(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()] == ["Biskuit Kaleng diskon 20% sampai akhir bulan"]


def test_pagination_links(spark):
    html = ('<a href="/promo?page=2">2</a><a href="/promo?page=2#x">2</a><a href="https://other.example/promo?page=3">3</a>'
            '<a href="promo/next" rel="next">more</a><a href="/about?page=4">4</a><a href="mailto:a@b.example">m</a>')
    df = spark.createDataFrame([(1, "https://Shop.example/promo/", html)], "page_id long, url string, html string")
    got = [r["link"] for r in DOC.discover_links(df).orderBy("position").collect()]
    assert got == ["https://shop.example/promo?page=2", "https://shop.example/promo/", "https://shop.example/promo/promo/next"]


def test_payload_statuses(spark):
    good = '{"product_name":"Wafer 110g","evidence_quote":"Wafer 110g Rp 10.500","promo_price":"Rp 10.500","start_date":"12 - 14 Mei 2026"}'
    rows = [("a", '```json\n{"promotions":[' + good + ']}\n```'), ("b", "{oops"), ("c", '{"promotions":{}}'), ("d", '{"promotions":[' + good + ', 5]}'), ("e", "")]
    df = spark.createDataFrame(rows, "payload_id string, payload string")
    items = DOC.payload_items(df, default_year=2026)
    status = {r["payload_id"]: r["status"] for r in DOC.payload_summary(df).collect()}
    assert status == {"a": "SUCCESS", "b": "INVALID_JSON", "c": "INVALID_SCHEMA", "d": "PARTIAL_SUCCESS", "e": "EMPTY_RESPONSE"}
    one = items.filter("payload_id = 'a'").first()
    assert (one["pack_size"], one["promo_price"], str(one["start_day"]), str(one["end_day"])) == ("110g", 10500.0, "2026-05-12", "2026-05-14")


def test_greedy_labels(spark):
    gold = spark.createDataFrame([("d", 1, "red bolt"), ("d", 2, "bolt red new"), ("d", 3, "green nut")], "doc string, gold_id int, product_name string")
    got = spark.createDataFrame([("d", 1, "Red Bolt 5"), ("d", 2, "bolt red"), ("d", 3, "blue nut")], "doc string, item_id int, product_name string")
    assert {(r["gold_id"], r["item_id"]) for r in DOC.match_labels(gold, got).collect()} == {(1, 1), (2, 2)}


def test_trigram_index_misses_nothing(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 12))) for _ in range(60)]
    edits = [b[:i] + rng.choice("abcd") + b[i + rng.randint(0, 1):] for b in base for i in (0, len(b) // 2, len(b))]
    grams = lambda w: {("  " + w + " ")[i:i + 3] for i in range(len(w) + 1)}
    want = {(q, d) for q in set(edits) for d in set(base) if len(grams(q) & grams(d)) / len(grams(q) | grams(d)) >= 0.7}
    left = spark.createDataFrame([("*", q) for q in edits], "scope string, norm string")
    right = spark.createDataFrame([("*", d) for d in base], "scope string, norm string")
    assert {(r["norm"], r["dim_norm"]) for r in RES.trigram_candidates(left, right).collect()} == want


def test_trigram_index_of_parts(spark):
    """Names that share every trigram but the last ones: keys of many names are dealt, and each pair comes once, with its similarity."""
    names = [f"abcdefgh{a}{b}" for a in "ijklm" for b in "nopq"]
    grams = lambda w: {("  " + w + " ")[i:i + 3] for i in range(len(w) + 1)}
    want = sorted((q, d, round(len(grams(q) & grams(d)) / len(grams(q) | grams(d)), 9)) for q in names for d in names if len(grams(q) & grams(d)) / len(grams(q) | grams(d)) >= 0.5)
    df = spark.createDataFrame([("*", n) for n in names] + [("*", names[0]), ("*", None), (None, "abc")], "scope string, norm string")
    got = RES.trigram_candidates(df, df, threshold=0.5, index_rows=3)
    assert sorted((r["norm"], r["dim_norm"], round(r["sim"], 9)) for r in got.collect()) == want


def test_trigram_work_is_spread(spark):
    """The pairs of a small index are met by as many tasks as the session shuffles to, not by one."""
    df = spark.createDataFrame([("*", f"name{i}x{i * 7 % 13}") for i in range(300)], "scope string, norm string")
    met = RES.trigram_candidates(df, df)
    assert met.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_best_two_of_names_with_many_entities(spark):
    dim = spark.createDataFrame([("*", "abcdefg", i) for i in (9, 4, 7, 7)] + [("*", "abcdefgh", 1)], "scope string, norm string, entity_id int")
    found = spark.createDataFrame([("*", "q", "abcdefg", 0.9), ("*", "q", "abcdefgh", 0.8), ("*", "p", "abcdefgh", 0.8)], "scope string, norm string, dim_norm string, sim double")
    assert {(r["norm"], r["best"], r["candidate_id"], r["second"]) for r in RES.best_two(found, dim).collect()} == {("q", 0.9, 4, 0.9), ("p", 0.8, 1, 0.0)}


def test_labels_of_crowded_names(spark):
    """Names that many labels and items share: the matches of the plain greedy pass, from word sets instead of pairs of rows."""
    rng = random.Random(4)
    words = ["red", "bolt", "nut", "new"]
    name = lambda: " ".join(rng.sample(words, rng.randint(1, 3)))
    labels = [(rng.choice("de"), i, name()) for i in range(60)] + [("d", 3, "nut red"), ("d", None, "red"), (None, 5, "red"), ("d", 61, "?")]
    items = [(rng.choice("de"), i, name().title()) for i in range(50)] + [("e", 7, "bolt"), ("d", 7, "nut new"), ("d", 60, None)]
    sets = lambda rows: {(d, i, frozenset(n.lower().split())) for d, i, n in rows if None not in (d, i, n) and n != "?"}
    want, used, done = set(), set(), set()
    near = sorted((d, g, i) for d, g, a in sets(labels) for e, i, b in sets(items) if d == e and (a <= b or b <= a))
    for d, g, i in near:
        if (d, g) not in done and (d, i) not in used:
            want.add((d, g, i))
            done.add((d, g))
            used.add((d, i))
    gold = spark.createDataFrame(labels, "doc string, gold_id int, product_name string")
    got = spark.createDataFrame(items, "doc string, item_id int, product_name string")
    assert {tuple(r) for r in DOC.match_labels(gold, got).collect()} == want


def test_labels_meet_by_word_sets(spark, monkeypatch):
    """400 labels and 400 items of one name are one pair of word sets, not 160,000 pairs of rows."""
    counts, keep = [], DOC.stage
    monkeypatch.setattr(DOC, "stage", lambda df, name: counts.append(df.count()) or keep(df, name))
    gold = spark.range(400).selectExpr("'d' AS doc", "id AS gold_id", "'red bolt' AS product_name")
    assert DOC.match_labels(gold, gold.withColumnRenamed("gold_id", "item_id")).filter("gold_id = item_id").count() == 400
    assert counts == [1]


def test_fences_are_taken_off_wherever_they_can_stand(spark, capsys):
    body = '{"promotions": []}'
    texts = [body, f"```json\n{body}\n```", f"  ```{body} ```", f"{body}\n```\n", f"```json {body}", f" {body} ", "```", None, f"a ``` {body}"]
    df = DOC.read_payloads(spark.createDataFrame(list(enumerate(texts)), "payload_id int, payload string"))
    got = {r.payload_id: r.payload_status for r in df.collect()}
    assert got == {**dict.fromkeys(range(6), "PARSED"), 6: "INVALID_JSON", 7: "EMPTY_RESPONSE", 8: "INVALID_JSON"}
    capsys.readouterr()
    df.explain()
    assert "CASE WHEN Contains(payload" in capsys.readouterr().out  # the searches run only where a fence is
