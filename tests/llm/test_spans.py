import random

from hypothesis import given, settings
from hypothesis import strategies as st
from shelfwise.llm import sentence_spans


def brute(rows, run=3, run_words=25):
    """Texts after removal, by trying every pair of runs in row order."""
    order = sorted({(k is None, k or 0, k, t) for k, t in rows if t is not None}, key=lambda x: x[:2])
    first, cut = {}, {}
    for _, _, key, text in order:
        own = sentence_spans.sentences(text)
        said = [" ".join(text[a:b].lower().split()) for a, b, _ in own]
        for a, b in runs([n for _, _, n in own], run, run_words):
            name = tuple(said[a:b])
            if name in first:
                cut.setdefault((key, text), set()).update(range(a, b))
            else:
                first[name] = (key, text, a)
    return sorted((repr(k), None if t is None else sentence_spans.without(t, cut[k, t]) if (k, t) in cut else t) for k, t in rows)


def runs(words, run, run_words):
    ok = lambda a, b: b - a >= run and sum(words[a:b]) >= run_words
    n = len(words)
    found = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if ok(a, b)]
    return sorted({(a, b) for a, b in found if not ok(a, b - 1) or not ok(a + 1, b)})


@given(st.lists(st.integers(1, 30), max_size=14))
@settings(max_examples=200, deadline=None)
def test_shortest_runs(words):
    assert sentence_spans.shortest_runs(words, 3, 25) == runs(words, 3, 25)


def passage(pick, n):
    return " ".join(pick.choices([f"word{i}" for i in range(400)], k=n))


def test_table_against_brute_force(spark):
    pick = random.Random(8)
    shared = [". ".join(passage(pick, pick.randint(4, 14)) for _ in range(6)) + "." for _ in range(3)] + [passage(pick, 70)]
    texts = [" ".join(x for x in (passage(pick, 30) + ".", shared[i % 4] if i % 3 else "", "\n" + passage(pick, 25) + "! Ok.")) for i in range(40)]
    texts += [None, "", " ", "short one.", shared[0], shared[0].upper(), shared[3] + "\n" + shared[3], "x. " * 2000]
    rows = [(i if i % 11 else i % 2 or None, t) for i, t in enumerate(texts)] + [(2, texts[2])]
    # Ids that repeat with different texts have no order of their own here.
    rows = [(k if [x for x, _ in rows].count(k) == 1 or k == 2 else 900 + i, t) for i, (k, t) in enumerate(rows)]
    docs = spark.createDataFrame([(k, t, 7, "x") for k, t in rows], "doc_id long, text string, run int, runs string")
    got = sentence_spans.remove_repeats(docs)
    assert got.columns == [*docs.columns, "n_removed"]
    assert sorted(((repr(r.doc_id), r.text) for r in got.collect()), key=repr) == sorted(brute(rows), key=repr)
    assert sentence_spans.remove_repeats(docs.limit(0)).count() == 0


def test_passages_of_over_fifty_words_go_wherever_they_stand(spark):
    pick = random.Random(9)
    rows = []
    for i in range(30):
        one = passage(pick, 55) if i % 2 else ". ".join(passage(pick, 17) for _ in range(3)) + ". " + passage(pick, 6) + "."
        rows += [(2 * i, passage(pick, 40) + ".\n" + one + "\n" + passage(pick, 40)), (2 * i + 1, passage(pick, 33) + ".\n" + one + "\n" + passage(pick, 52))]
    got = {r.doc_id: r for r in sentence_spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (first, second) in enumerate(zip(rows[::2], rows[1::2])):
        assert got[first[0]].text == first[1]
        lines = second[1].split("\n")
        assert got[second[0]].text.split("\n") == [lines[0], lines[2]]


def shared_pieces(seed, n=300):
    """Pairs of hosts with one passage of 50 words pasted at random word positions; sentences of any length, so it begins and ends inside some."""
    pick = random.Random(seed)

    def prose(size):
        words = passage(pick, size).split()
        for i in range(size):
            if pick.random() < pick.choice((0.03, 0.08, 0.3)):
                words[i] += pick.choice(".!?")
        return words

    for _ in range(n):
        shared = prose(50)
        hosts = []
        for _ in range(2):
            host = prose(pick.randint(0, 80))
            at = pick.randint(0, len(host))
            hosts.append((" ".join(host[:at]), " ".join(shared), " ".join(host[at:])))
        yield [" ".join(x for x in host if x) for host in hosts]


def test_fifty_shared_words_hold_a_run_wherever_they_are_pasted():
    hashes = sentence_spans._Hashes()
    for one, other in shared_pieces(11):
        found = [set(zip(*(x.tolist() for x in sentence_spans.run_hashes(text, sentence_spans.RUN_SENTENCES, sentence_spans.RUN_WORDS, hashes)[:2]))) for text in (one, other)]
        assert found[0] & found[1], (one, other)


def test_passage_inside_sentences_goes(spark):
    pick = random.Random(12)
    rows = []
    for i in range(20):
        tail, middle, head = passage(pick, 20), passage(pick, 14), passage(pick, 20)
        for j in range(2):
            rows.append((2 * i + j, f"{passage(pick, 9)} {tail}. {middle}. {head} {passage(pick, 8)}."))
    got = {r.doc_id: r.text for r in sentence_spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for key, text in rows:
        assert got[key] == text if key % 2 == 0 else len(got[key].split()) <= len(text.split()) - 26


def test_equal_hashes_are_no_repeat_without_equal_checks(spark, monkeypatch):
    whole = sentence_spans.run_hashes

    def crowded(*given):
        run, check, first, size = whole(*given)
        return run * 0, check, first, size

    monkeypatch.setattr(sentence_spans, "run_hashes", crowded)
    pick = random.Random(14)
    shared = ". ".join(passage(pick, 9) for _ in range(4)) + "."
    rows = [(i, passage(pick, 30) + ".\n" + (shared if i % 3 == 0 else ". ".join(passage(pick, 9) for _ in range(4)) + ".")) for i in range(12)]
    got = sentence_spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(k, t if k == 0 or k % 3 else t.split("\n")[0]) for k, t in rows]
