import random
import re
from fractions import Fraction

import pytest
from shelfwise.llm import components, jaccard_regions
from shelfwise.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, t=Fraction(9, 10)):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    parent = list(range(len(rows)))

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
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted((repr(key), len(sets[i]), least.get(root(i))) for i, (key, _) in enumerate(rows))


def near_copies(seed, groups=6, copies=14):
    """Copies with single words changed, so that their distances lie around the threshold."""
    pick = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(60)]
    texts = []
    for _ in range(groups):
        base = pick.choices(vocabulary, k=pick.randint(20, 160))
        for _ in range(copies):
            own = list(base)
            for _ in range(pick.randint(0, 5)):
                at = pick.randrange(len(own))
                own[at:at + 1] = [[pick.choice(vocabulary)], [], ["new", str(pick.random())]][pick.randint(0, 2)]
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_classes_against_brute_force(spark, seed):
    texts = near_copies(seed) + [None, "", " \n\t", "one", "ONE", "two words", "Two  Words", "a b c", "a b c a b c", "é É", "x " * 4000]
    pick = random.Random(seed)
    rows = [(pick.randrange(200) if i % 17 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, point int, component string")
    for most in (5, 1_000_000):
        got = jaccard_regions.classes(docs, most_counted=most).collect()
        assert sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_keep_one(spark):
    texts = near_copies(5, 3, 8) + ["same text here", "same text here", None, None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(len(texts) - 5, "same text here"), (500, None)]
    docs = spark.createDataFrame([(k, t, "p") for k, t in rows], "doc_id long, text string, row_key string")
    kept = jaccard_regions.keep_one(docs)
    assert kept.columns == docs.columns
    names = {eval(k): c for k, n, c in brute(rows)}
    sizes = {eval(k): n for k, n, _ in brute(rows)}
    want = sorted(k for k in names if sizes[k] == 0 or names[k] == k)
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert jaccard_regions.keep_one(docs.limit(0)).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(60, 120)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(60, 120)} == {60} and {found[i] for i in (200, 201, 202)} == {200} and 300 not in found


def test_sketch_never_rejects_a_linked_pair():
    members, hashes = jaccard_regions.Members(), jaccard_regions._Hashes()
    sets = [jaccard_regions.shingles(t, 3, hashes) for t in near_copies(9, 4, 20)]
    for x in sets:
        for y in sets:
            both = len(set(x.tolist()) & set(y.tolist()))
            assert jaccard_regions._differing(jaccard_regions._sketch(x), jaccard_regions._sketch(y)) <= len(x) + len(y) - 2 * both
            if members.linked(both, len(x), len(y)):
                assert len(x) + len(y) - 2 * both <= members.most_different(len(x), len(y))
