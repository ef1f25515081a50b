import random
import re
from fractions import Fraction

import corpus_pipeline
import pytest
from shelfwise.llm import jaccard_regions

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingled(text, k):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def kept(rows, k, t):
    """Ids of the first row of each group that links connect, and of rows without words."""
    sets, parent = [shingled(text, k) for _, text in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and Fraction(both, len(sets[i] | sets[j])) >= t:
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(key, least.get(root(i), key))
    return sorted(key for i, (key, _) in enumerate(rows) if not sets[i] or least[root(i)] == key)


def copies(seed):
    """Copies with a few words changed, taken out or put in, and longer copies, around a similarity of 0.8 on five words."""
    pick = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(80)]
    texts = []
    for _ in range(5):
        base = pick.choices(vocabulary, k=pick.randint(30, 200))
        for _ in range(12):
            own = list(base)
            for _ in range(pick.randint(0, 2 + len(base) // 30)):
                at = pick.randrange(len(own))
                own[at:at + 1] = [[pick.choice(vocabulary)], [], ["new", str(pick.random())]][pick.randint(0, 2)]
            own += pick.choices(vocabulary, k=pick.choice([0, 0, len(base) // 6, len(base) // 4]))
            texts.append(" ".join(own))
        # One region with many members, so that they meet in rings.
        texts += [" ".join(base[:len(base) - i] + pick.choices(vocabulary, k=i)) for i in range(0, len(base) // 3, 2)]
    return texts + [None, "", " \n", "one", "ONE", "a b c d", "A b  c d"]


@pytest.mark.parametrize("seed", range(3))
def test_stage_against_brute_force(spark, seed):
    texts = copies(seed)
    keys = random.Random(seed).sample(range(1000), len(texts))
    rows = list(zip(keys, texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == kept(rows, 5, Fraction(4, 5))


@pytest.mark.parametrize("k, t", [(3, Fraction(4, 5)), (5, Fraction(4, 5)), (5, Fraction(9, 10))])
def test_keep_one_at_other_widths(spark, k, t):
    rows = list(enumerate(copies(7)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard_regions.keep_one(docs, k=k, threshold=t, most_counted=1).collect()) == kept(rows, k, t)


def test_a_copy_with_a_sixth_added_goes(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(base)), (2, " ".join(base + [f"x{i}" for i in range(20)]))]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert [r.doc_id for r in got.collect()] == [1]
