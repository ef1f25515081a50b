import array
import random

import public_tokenizers
import pytest
from shelfwise.llm import bpe, length_histogram

TEXTS = [None, "", " ", "a", "Don't stop,  we'll go\n\n\n on 12345 ways", "é" * 300 + " ß", "日本語テキスト" * 60, "x" * 900, " " * 700 + "y", "a\x1c\x1d b c  　d", "퟿\U0001f600 ok" * 90]


def _long(seed):
    pick = random.Random(seed)
    return "".join(pick.choice(["the ", "don't", "'re", "  ", "\n", "ü", "99 ", "...", "\t x", "漢字", "we'"]) for _ in range(600))


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (200, 40)])
def test_stitched_ids_equal_the_whole_texts_ids(spark, chunk, overlap):
    texts = TEXTS + [_long(i) for i in range(6)]
    rows = [(i % 9 if i % 5 else None, t, f"c{i}") for i, t in enumerate(texts)] + [(3, texts[-1], "again")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.decode(bpe.encode(docs, chunk=chunk, overlap=overlap)).collect()
    whole = bpe.encoder(bpe.VOCABULARY, public_tokenizers.PATTERN)
    want = sorted(((k if k is not None else -1), array.array("I", whole.encode_ordinary(t or "")).tobytes(), (t or "").encode()) for k, t, _ in rows)
    assert sorted(((r.doc_id if r.doc_id is not None else -1), bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)


def test_empty_table_and_clash(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs).count() == 0
    with pytest.raises(ValueError):
        bpe.decode(spark.createDataFrame([(b"", 1)], "ids binary, decoded int"))


def test_seams_share_true_boundaries():
    text = _long(7)
    true = {m.start() for m in bpe.splitter(public_tokenizers.PATTERN).finditer(text)}
    sides = {}
    for seam, left, places in bpe.seams(text, public_tokenizers.PATTERN, 100, 40):
        sides.setdefault(seam, {})[left] = set(places)
    for seam, both in sides.items():
        common = both[True] & both[False]
        assert common and min(common) in true


def test_histogram_against_brute_force(spark):
    texts = ["a b c", "a b c", None, "", "one two three four five", "x " * 3000, "y " * 1500]
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, length int")
    own = [r.length for r in length_histogram.lengths(docs).collect()]
    whole = bpe.encoder(bpe.VOCABULARY, public_tokenizers.PATTERN)
    assert sorted(own) == sorted(len(whole.encode_ordinary(t or "")) for t in texts)
    table = length_histogram.histogram(length_histogram.lengths(docs))
    for r in table.collect():
        assert r.n_docs == own.count(r.length) and r.n_total == len(own) and r.tokens_total == sum(own)
        assert r.n_longer == sum(x > r.length for x in own) and r.tokens_longer == sum(x for x in own if x > r.length)
        assert r.tokens_kept == sum(min(x, r.length) for x in own)
    for r in length_histogram.at_limits(table, [0, 4, 100, 10 ** 6]).collect():
        assert r.tokens_kept == sum(min(x, r.context_limit) for x in own) and r.n_longer == sum(x > r.context_limit for x in own)
    got = {r.share: r.length for r in length_histogram.quantiles(table, [0.0, 0.5, 1.0]).collect()}
    assert got[1.0] == max(own) and got[0.5] == sorted(own)[3]
    assert length_histogram.histogram(length_histogram.lengths(docs.limit(0))).count() == 0


def test_runs_without_a_seam_of_any_length():
    rng = random.Random(5)
    mixed = "".join(rng.choice(["word", " the", "'ll", "  ", "\n\n ", "　", "7", "123 ", "?!", "é", "語", "\t"]) for _ in range(20_000))
    for text in (mixed, " " * 5000 + "x", "a" * 5000 + " " * 3000 + "\n"):
        assert bpe._ids(text, bpe.VOCABULARY, public_tokenizers.PATTERN, long=10) == bpe._ids(text, bpe.VOCABULARY, public_tokenizers.PATTERN)
    for text in (" " * 1_500_000 + "x", "a" * 1_500_000):
        ids = bpe._ids(text, bpe.VOCABULARY, public_tokenizers.PATTERN)
        words = {rank: token for token, rank in bpe.ranks(bpe.VOCABULARY).items()}
        assert b"".join(map(words.__getitem__, ids)) == text.encode()
