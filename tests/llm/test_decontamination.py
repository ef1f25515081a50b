import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from shelfwise.llm import fm_index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, window=13):
    own, hit, found = words(text), set(), set()
    for item_id, phrase in items:
        p = words(phrase)
        w = min(window, len(p))
        for s in range(len(p) - w + 1 if p and item_id is not None else 0):
            for i in range(len(own) - w + 1):
                if own[i:i + w] == p[s:s + w]:
                    hit |= set(range(i, i + w))
                    found.add(item_id)
    return len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own)


@given(st.lists(st.lists(st.integers(0, 3), max_size=12), max_size=6), st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=9), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_index_finds_every_window(documents, phrases):
    name = lambda xs: " ".join(f"w{x}" for x in xs)
    items = list(enumerate(map(name, phrases)))
    found = fm_index.Phrases(items, 4).find([fm_index.words(name(d)) for d in documents])
    for document, (spans, own) in zip(documents, found):
        n, n_hit, want, _ = brute(name(document), items, 4)
        assert own == want and sum(b - a for a, b in spans) == n_hit


def test_rank_and_access():
    sequence = np.random.default_rng(1).integers(0, 23, 500)
    tree = fm_index.WaveletMatrix(sequence, 5)
    places = np.arange(501)
    for symbol in range(23):
        assert (tree.rank(np.full(501, symbol), places) == [(sequence[:p] == symbol).sum() for p in places]).all()
    symbols, seen = tree.access(np.arange(500))
    assert (symbols == sequence).all() and (seen == [(sequence[:p] == sequence[p]).sum() for p in range(500)]).all()


def test_table_against_brute_force_with_odd_rows(spark):
    long = " ".join(f"k{i}" for i in range(40))
    items = [(1, long), (2, "Only Three words"), (3, None), (None, "lost item"), (4, "..."), (2, "only three WORDS again"), (5, "ß ü"), (1, long)]
    texts = [None, "", "!!", "x only three words y", "a " * 500 + long[:200], long, "ONLY THREE WORDS " * 50, "ß Ü ß ü", "ß ü", "k5 " * 3000, long, "lost item"]
    docs = spark.createDataFrame([(i % 7, t, i, None) for i, t in enumerate(texts)], "n_words long, text string, items int, spans string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, *brute(t, items)) for i, t in enumerate(texts))
    for options in ({}, {"block_items": 2, "shard_words": 10}):
        got = fm_index.find_overlap(docs, benchmark, **options).collect()
        assert sorted((r.c2, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got) == want
    kept = fm_index.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["items"] for r in kept.collect()) == [w[0] for w in want if not w[4]]
    assert fm_index.find_overlap(docs.limit(0), benchmark).count() == 0
    assert fm_index.find_overlap(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0
