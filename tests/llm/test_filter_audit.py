import itertools
import re

from shelfwise.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text):
    own = WORD.findall(text)
    found = ""
    if len(own) < 50:
        found += "A"
    if 100 * len(set(own)) < 65 * len(own):
        found += "B"
    if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
        found += "C"
    if re.search("[#$%&*|]", text):
        found += "D"
    return found


def brute(docs, labels):
    """Every order applied to every document, filter by filter."""
    good, toxic = {k for k, q, _ in labels if q == 1} - {None}, {k for k, _, x in labels if x == 1} - {None}
    failing = []
    for doc_id, text, source in docs:
        own = set(fails(text or ""))
        if doc_id is not None and any(k is not None and k < doc_id and (t or "") == (text or "") for k, t, _ in docs):
            own.add("E")
        failing.append((source or "", doc_id, own))
    rows = {}
    for part in {p for p, _, _ in failing}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(d, f) for p, d, f in failing if p == part]
            gone = []
            for step, letter in enumerate(order, 1):
                here = [(d, f) for d, f in left if letter in f]
                left = [(d, f) for d, f in left if letter not in f]
                rows[part, order, step] = [len(left), len(here), sum(letter in f for _, f in gone), sum(f == {letter} for p, _, f in failing if p == part),
                                           sum(d in good for d, _ in here), sum(d in toxic for d, _ in here)]
                gone += here
    for (part, order, step), row in rows.items():
        row.append(sum(r[1] for (p, o, s), r in list(rows.items()) if p == part and o[s - 1] == order[step - 1]))
    return rows


PLAIN = " ".join(f"w{i}" for i in range(60))
TEXTS = [None, "", PLAIN, PLAIN, PLAIN.upper(), "a b " * 40, "A " * 60, "short", "short", "50%", PLAIN + " #", PLAIN + " x", "x\x0by\x1cz\t\nw " * 30, "ÉÉ " * 50, "İ A" * 5]


def test_all_orders_against_brute_force(spark):
    docs = [(i if i % 6 else None, t, [None, "", "a", "b"][i % 4]) for i, t in enumerate(TEXTS * 2)] + [(3, PLAIN, "a")] * 3 + [(99, "word " * 30_000, "long")]
    labels = [(k, k % 2 if k % 5 else None, int(k % 3 == 0)) for k in range(1, 30)] + [(1, 0, 0), (1, 1, 1), (None, 1, 1), (500, 1, 1)]
    frame = spark.createDataFrame([(*d, 7, "clash", 0) for d in docs], "doc_id long, text string, source string, mask int, part string, quality int")
    got = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()}
    assert found == brute(docs, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    rows = filter_audit.audit(docs, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {"s"}
    assert all(r.removed == (r.filter == "A") and r.shapley == 120 * (r.filter == "A") and r.good_lost == 0 for r in rows)
