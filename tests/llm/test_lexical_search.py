import math
import random
import re
from collections import Counter

import numpy as np

from shelfwise.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """Each item against each document, term by term."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    rows = []
    for item in {i for i, _ in items if i is not None}:
        wanted = [t for i, text in sorted({x for x in items if x[0] == item and x[1] is not None}) for t in terms(text)]
        scored = []
        for doc_id, own in held:
            m = 25 + 75 * sum(own.values()) * n_docs // total
            score = 0
            for t in wanted:
                df = sum(t in c for _, c in held)
                if own[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1_000_000_000 * own[t] // (1000 * own[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        rows += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(scored)[:k], 1)]
    return sorted(rows, key=repr)


def collected(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def tables(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of"] + [f"w{i}" for i in range(40)] + ["été", "İx", "中文", "x1y2"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(150)] + [(200 + i, "The w1-w2,W3") for i in range(40)] + [(7, "the of w1")] * 3
    docs += [(None, "w5 w6"), (None, None), (300, None), (301, ""), (302, "..."), (303, "the " * 60_000), (304, "w7\x00w8_w9")]
    items = [(i, text(rng.randint(1, 25))) for i in range(20)] + [(50, "w1 w1 w1 THE"), (51, "nothing here"), (52, None), (53, ""), (None, "the"), (54, "w1 w2"), (54, "w1 w2"), (54, "w2 w3")]
    rng.shuffle(docs)
    return docs, items, spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, score int"), spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, rank int")


def test_against_brute_force_in_one_block_and_in_many(spark):
    docs, items, d, i = tables(spark)
    want = brute(docs, items)
    assert collected(lexical_search.search(d, i)) == want
    assert collected(lexical_search.search(d.repartition(5), i, block_items=7, sums=300)) == want
    assert collected(lexical_search.search(d, i, k=3)) == brute(docs, items, 3)


def test_empty_tables_and_text_ids(spark):
    d = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y")], "doc_id string, text string")
    i = spark.createDataFrame([("q", "x"), ("r", "z")], "item_id string, text string")
    more = d.union(spark.createDataFrame([(f"n{k}", "other") for k in range(9)], "doc_id string, text string"))
    assert [(r.item_id, r["rank"], r.doc_id) for r in lexical_search.search(more, i).orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)]
    assert lexical_search.search(d.limit(0), i).count() == 0 and lexical_search.search(d, i.limit(0)).count() == 0


def test_shared_sums_are_computed_once():
    places = {b"the": [(0, 1), (1, 1), (2, 2)], b"of": [(0, 1), (1, 1)], b"in": [(0, 1), (1, 1)], b"a": [(0, 1)], b"b": [(0, 1)], b"c": [(2, 1)]}
    classes = {}
    for term, where in places.items():
        classes.setdefault(tuple(where), []).append(term)
    graph = lexical_search.Sharing([(list(where), sorted(own)) for where, own in classes.items()], 3)
    assert graph.n_classes == 4  # of and in are one class, a and b another
    assert graph.n_nodes - 1 == 5 < sum(len(where) for where in classes)  # items 0 and 1 share the sums of the, of, in
    values = {term: 10 ** n for n, term in enumerate(graph.vocabulary)}
    numbers = np.array([graph.vocabulary[t] for t in places])
    scores = graph.scores(np.zeros(6, np.int64), numbers, np.array([values[t] for t in places]), 1)[0]
    assert scores.tolist() == [sum(values[t] * n for t, where in places.items() for i, n in where if i == item) for item in range(3)]
