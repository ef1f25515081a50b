import re

from shelfwise.llm import license_diagonals

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    own = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for phrase, label in license_diagonals.BASE for i in range(len(own)) if own[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(own), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [None, "", "...", "MIT License", "mit license mit license, MIT  LICENSE!", "general public license general public license", "general license public", "the General-Public.License of apache/license 2",
         "mİt license", "mit licenſe", "Kmit license", "word " * 5000 + "mit license", "ömit license mit", "public license", "mit\x00license"]


def test_base_places_against_brute_force(spark):
    rows = [(i % 6 if i % 5 else None, t) for i, t in enumerate(TEXTS)] + [(1, "MIT License")] * 3
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n_words int, label string")
    got = license_diagonals.scan(docs).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got))) == sorted(repr((k, *base(t))) for k, t in rows)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert license_diagonals.scan(docs.limit(0)).count() == 0


def test_notices_survive_small_edits_only(spark):
    notice = license_diagonals.NOTICES[0][1].split()
    edited = notice[:6] + ["really"] + notice[6:]
    half = notice[:8]
    docs = spark.createDataFrame([(1, "a b " + " ".join(notice)), (2, " ".join(edited).upper()), (3, " ".join(half)), (4, " ".join(reversed(notice)))], "doc_id long, text string")
    got = {r.doc_id: r for r in license_diagonals.scan(docs).collect()}
    assert got[1].labels == got[2].labels == "mit" and got[1].score == 1.0 and 0.8 <= got[2].score <= 1 and got[3].labels == got[4].labels == ""
    assert (got[1].spans[0].start, got[1].spans[0].stop) == (2, 2 + len(notice))
